"""The shape of the physical plans, and results under skew."""

import math
import re

import pytest
from conftest import days, plan_of
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.oracles import ORACLES
from checks.queries import QUERIES
from tillspark import sources
from tillspark.operators import analytics, clean, features, inspect
from tillspark.plans import jobs
from tillspark.session import shared_path

# Queries that write files or fit models while they are built.
EAGER = {"ingest_sales", "sink_roundtrip", "requests_from_csv", "requests_from_json",
         "prepare_subset"}


@pytest.fixture(scope="module")
def table(spark, sf):
    """A clean dense table at rest."""
    path = shared_path(spark, "dense")
    sources.write_parquet(fx.dense_clean(spark, sf), path)
    return sources.read_sales_parquet(spark, path)


def count(plan, pattern):
    return len(re.findall(pattern, plan))


def test_features_take_one_exchange_and_one_sort(table):
    plan = plan_of(features.build_features(table, validate=False)[0])
    assert count(plan, "Exchange ") == 1
    assert count(plan, r"[+-] Sort ") == 1


def test_a_filter_on_the_series_reaches_the_scan(table):
    out, _ = features.build_features(table, validate=False)
    plan = plan_of(out.where("product_id = 'ECONOMY'").select("date", "lag_7"))
    assert "EqualTo(product_id,ECONOMY)" in plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {
        "date", "product_id", "store_id", "sales_quantity"}


def test_bucketed_tables_need_no_exchange(spark, table):
    sources.write_series_table(table, "dense_by_series", 4)
    stored = spark.table("dense_by_series")
    assert "Exchange" not in plan_of(features.build_features(stored, validate=False)[0])
    assert "Exchange" not in plan_of(clean.flag_outliers(stored.drop("outlier_flag")))
    spark.sql("DROP TABLE dense_by_series")


def test_cleaning_takes_one_exchange_per_shuffle_key(table):
    raw = table.drop("is_gap_fill", "outlier_flag")
    plan = plan_of(clean.clean_sales(raw, fill_date_gaps=True))
    assert count(plan, "Exchange ") == 2  # all columns for copies, then the series
    assert "Join" not in plan


def test_event_report_reads_the_table_once(table):
    plan = plan_of(analytics.event_analysis(table))
    assert count(plan, "FileScan") == 1


@pytest.mark.parametrize("name", sorted(set(ORACLES) - EAGER))
def test_no_query_crosses_or_calls_python(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in plan


def test_queries_and_oracles_agree_on_names():
    assert set(ORACLES) <= set(QUERIES)
    weak = set(QUERIES) - set(ORACLES)
    assert weak == {"train_baseline", "feature_importance", "test_predictions", "tune_grid",
                    "compare_models", "score_batch", "score_stream", "prediction_log"}


# ---- one product holds most rows --------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """A product in 40 stores next to ten small ones in one store each."""
    rows = []
    for s in range(40):
        for i, d in enumerate(days("2024-01-01", 15)):
            rows.append((d, "HOT", f"S{s:02d}", (s * 5 + i * 3) % 11, 1.0 + (s + i // 4) % 3))
    for p in range(10):
        for i, d in enumerate(days("2024-01-01", 15)):
            rows.append((d, f"P{p}", "S00", (p + i) % 4, 2.0 + (i // 5) * (p % 2)))
    return spark.createDataFrame(
        rows, "date date, product_id string, store_id string, sales_quantity bigint, "
        "price double"), rows


def test_price_profile_of_a_hot_product(skewed):
    df, rows = skewed
    got = {r.product_id: r for r in analytics.price_profile(df).collect()}
    hot = sorted((s, d, p, q) for d, i, s, q, p in rows if i == "HOT")
    assert got["HOT"].n_price_changes == sum(
        a[2] != b[2] for a, b in zip(hot, hot[1:]))
    n = len(hot)
    mp, mq = sum(h[2] for h in hot) / n, sum(h[3] for h in hot) / n
    corr = sum((h[2] - mp) * (h[3] - mq) for h in hot) / math.sqrt(
        sum((h[2] - mp) ** 2 for h in hot) * sum((h[3] - mq) ** 2 for h in hot))
    assert got["HOT"].within_product_corr == pytest.approx(corr, abs=1e-4)


def test_price_changes_of_a_hot_product(skewed):
    df, rows = skewed
    per = {}
    for d, i, s, q, p in sorted(rows, key=lambda r: (r[1], r[0], r[2])):
        per.setdefault(i, []).append(p)
    want = sum(sum(a != b for a, b in zip(v, v[1:])) for v in per.values()) / len(per)
    assert inspect.avg_price_changes(df).first()[0] == pytest.approx(want, abs=1e-4)


def test_copies_of_one_row_collapse_before_the_shuffle(spark, skewed):
    df, rows = skewed
    copies = df.where("product_id = 'HOT' AND store_id = 'S00' AND date = '2024-01-01'")
    many = df.unionByName(copies.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(5000))))
                          .drop("_i"))
    out = clean.exact_dedup(many)
    assert out.count() == len(rows)
    plan = plan_of(out)
    partial = plan.index("Exchange")
    assert plan.count("HashAggregate") == 2 and plan.rindex("HashAggregate") > partial


# ---- jobs end to end ---------------------------------------------------------------

def test_jobs_from_raw_files_to_features(spark, sf, tmp_path):
    raw, days = tmp_path / "raw", 365
    wide = fx.wide(spark, sf).select(*sources.wide.ID_COLUMNS,
                                     *[f"d_{i}" for i in range(1, days + 1)])
    sources.write_csv(wide.coalesce(1), str(raw / "sales_train_evaluation.csv"))
    sources.write_csv(fx.wide_calendar(spark, sf), str(raw / "calendar.csv"))
    # Every week gets a price, so that the series have no gaps.
    weeks = F.sequence(F.lit(fx.FIRST_WEEK), F.lit(fx.FIRST_WEEK + days // 7))
    dense = wide.select(
        "store_id", "item_id", F.explode(weeks).alias("wm_yr_wk"), F.lit(2.5).alias("sell_price"))
    sources.write_csv(dense, str(raw / "sell_prices.csv"))

    sold = jobs.prepare(spark, str(raw), str(tmp_path / "sales"), "CA_1", "FOODS", 4)
    assert sold.count() == 4 * days
    result, tables = jobs.first_look(spark, str(tmp_path / "sales"))
    assert result.is_valid and tables["coverage"].first().max_days == days
    report = jobs.clean_table(spark, str(tmp_path / "sales"), str(tmp_path / "clean"))
    assert (report.output_rows, report.total_missing_days) == (4 * 365, 0)
    names = jobs.reports(spark, str(tmp_path / "clean"), str(tmp_path / "reports"))
    assert {"summary", "price_analysis", "category_analysis"} <= set(names)
    assert spark.read.json(str(tmp_path / "reports/summary")).first().total_rows == 4 * days
    made, gaps = jobs.feature_table(spark, str(tmp_path / "clean"), str(tmp_path / "features"))
    missing = {r.feature: r.n_missing for r in gaps.collect()}
    assert len(made) == 34
    assert [missing[f"lag_{k}"] for k in (1, 7, 14, 28)] == [4, 28, 56, 112]
