import pytest

from tillspark.session import shared_path, shuffle_settings, stage


def test_paths_lie_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_path(spark, "x"), shared_path(spark, "x")
    assert one != two and one.startswith(root) and two.startswith(root)


def test_staged_tables_have_no_history(spark):
    staged = stage(spark.range(10).selectExpr("id", "id % 3 AS k"), "t")
    assert staged.count() == 10
    assert "Range" not in staged._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size, parts", [(10**9, "200"), (100 * 10**12, "476838")])
def test_shuffle_settings_grow_with_the_table(size, parts):
    assert shuffle_settings(size)["spark.sql.shuffle.partitions"] == parts
