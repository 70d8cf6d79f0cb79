"""Work per task that follows from the rows, not from the size of the table."""

import re

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import QUERIES
from tillspark.plans import training

ITEM = ("series_gap_total", "price_summary", "feature_precheck", "lowest_products",
        "top_products", "worst_gaps", "detect_gaps", "training_precheck")


def below(plan: str, first: str) -> str:
    """The part of a plan that feeds the lowest shuffle by ``first``."""
    lines = plan.splitlines()
    at = max(k for k, line in enumerate(lines) if re.search(first, line))
    return "\n".join(lines[at:])


@pytest.mark.parametrize("name", ITEM)
def test_the_parts_of_item_follow_the_lines(spark, sf, name, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_A_PART", 1_000)
    parts = fx.parts_of(spark, sf)
    assert parts == -(-fx.table(spark, sf, "lineitem").count() // 1_000) > 4
    plan = plan_of(QUERIES[name](spark, sf))
    assert "hashpartitioning(product_id#" in plan
    shuffles = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), (\w+)", plan)
    rows = [s for s in shuffles if "product_id" in s[0]]
    assert rows and {(int(n), why) for _, n, why in rows} == {(parts, "REPARTITION_BY_NUM")}


def test_lines_are_neither_combined_nor_shuffled_before_their_cells(spark, sf, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_A_PART", 1_000)
    under = below(plan_of(fx.item(spark, sf)), r"Exchange hashpartitioning\(date")
    assert "HashAggregate" not in under and "SortMergeJoin" not in under
    assert len(re.findall("Exchange hashpartitioning", under)) == 1


def test_small_parts_give_the_same_rows(spark, sf, monkeypatch):
    whole = fx.item(spark, sf).collect()
    monkeypatch.setattr(fx, "ROWS_A_PART", 100)
    order = lambda rows: sorted(map(str, rows))
    assert order(fx.item(spark, sf).collect()) == order(whole)


def test_a_forest_pass_leaves_room_for_the_other_tasks(spark):
    rows = spark.range(200).selectExpr(
        "date_add(date'2024-01-01', cast(id as int)) AS date", "xxhash64(id) AS key",
        "cast(id % 7 as double) AS label", "cast(id % 7 as double) AS x")
    model = training._fit(training.RandomForestRegressor, {"numTrees": 2, "maxDepth": 3, "seed": 1},
                          rows, ["x"])
    # Four tasks of an executor share some 3.6 GB for all their work.
    assert 4 * model.stages[-1].getMaxMemoryInMB() <= 1_200


def test_torn_keys_take_one_shuffle_and_no_join(spark, sf, monkeypatch):
    monkeypatch.setattr(fx, "ROWS_A_PART", 1_000)
    plan = plan_of(fx.resolved(spark, sf))
    assert "Join" not in plan
    assert len(re.findall("Exchange ", plan)) == 1
    report = QUERIES["cleaning_report"](spark, sf)
    report.collect()
    assert "Reused" in plan_of(report)


def test_torn_keys_are_left_out_with_all_their_rows(spark, tmp_path):
    import datetime as dt
    at = lambda *a: dt.datetime(*a)
    # order, part, supplier, quantity, price, day; orders are no multiples of 83, 89, 97, 101
    rows = [(1, 1, 1, 2.0, 8.0, at(2024, 1, 1)), (1, 1, 1, 3.0, 12.0, at(2024, 1, 1)),  # differ
            (2, 2, 1, 2.0, 8.0, at(2024, 1, 1)), (2, 2, 1, 2.0, 8.0, at(2024, 1, 1)),  # copies
            (3, 3, 1, 5.0, 5.0, None), (3, 3, 1, 6.0, 6.0, None),  # no day, no key
            (97, 4, 1, 1.0, 1.0, at(2024, 1, 1)), (97, 4, 1, 2.0, 2.0, at(2024, 1, 2))]  # bad day
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, "
                          "l_quantity double, l_extendedprice double, l_shipdate timestamp"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fx.resolved(spark, str(tmp_path))
    assert got.columns == fx.dirty(spark, str(tmp_path)).columns
    assert sorted(r.product_id for r in got.collect()) == ["P2", "P2", "P3", "P3", "P4", "P4"]


def test_short_ways_read_text_as_the_long_ones(spark):
    from tillspark import functions as fn
    texts = ["5", "0", "00", "05", "5\n", "5.0", " 5", "-5", "+5", "123456789012345",
             "1234567890123456", "", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "n string")
    assert [r[0] for r in got.select(fn.plain_number(got, "n")).collect()] == [
        "5", "0", "0", "5", "5", "5", "5", "-5", "5", "123456789012345",
        "1234567890123456", "", "x", None]
    days = ["2024-02-29", "2023-02-29", "2024-13-01", "0000-01-01", "2024-1-1", "2024-01-01\n",
            " 2024-01-01", "2024-01-01x", "12024-01-01", "not-a-date", "1582-10-10", None]
    got = spark.createDataFrame([(t,) for t in days], "date string")
    for r in got.select("date", fn.to_date(got).cast("string").alias("a"), F.try_to_date(
            "date", "yyyy-MM-dd").cast("string").alias("b")).collect():
        assert r.a == r.b, r


def test_predictions_are_scored_once(spark):
    rows = spark.range(400).selectExpr(
        "date_add(date'2024-01-01', cast(id as int)) AS date", "'P' AS product_id",
        "id % 7 AS sales_quantity", "cast(id % 7 as double) AS lag_1",
        "1.0D AS lag_7", "2.0D AS lag_28", "3.0D AS rolling_mean_7")
    report = training.train_baseline(rows, params={"maxIter": 3})
    table = report.tables["test_predictions"]
    assert "ArrowEvalPython" not in plan_of(table)
    assert table.count() == report.sizes["test"]


def test_lines_of_a_series_are_not_shuffled_for_their_region(spark, sf):
    plan = plan_of(fx.series(spark, sf))
    assert not re.search(r"Exchange hashpartitioning\(l_suppkey", plan)
