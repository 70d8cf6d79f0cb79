import datetime as dt
import math
import statistics

import pytest
from conftest import days
from pyspark.sql import functions as F

from tillspark.functions import exact_quantiles
from tillspark.operators import analytics as an
from tillspark.operators import inspect
from tillspark.schema import AnalyticsInputError

SCHEMA = ("date date, product_id string, product_name string, category string, "
          "sales_quantity bigint, price double, snap_day int, holiday int, "
          "event_name string, store_id string, is_gap_fill int, outlier_flag int")


@pytest.fixture(scope="module")
def frame(spark):
    """Two products over Monday to Thursday: 10, 0, 20, 10 and 5, 5, 0, 10."""
    data = []
    for pid, cat, sales, price in (("P1", "FOODS", [10, 0, 20, 10], [2.0, 2.0, 4.0, 4.0]),
                                   ("P2", "HOUSEHOLD", [5, 5, 0, 10], [3.0] * 4)):
        for i, d in enumerate(days("2024-01-01", 4)):
            data.append((d, pid, pid, cat, sales[i], price[i], int(i == 0), int(i == 2),
                         "SuperBowl" if i == 2 else "none", "S1", 0,
                         int(pid == "P1" and i == 2)))
    return spark.createDataFrame(data, SCHEMA).cache()


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_guards(spark, frame):
    with pytest.raises(AnalyticsInputError, match="empty"):
        an.check_analytics_input(frame.limit(0))
    with pytest.raises(AnalyticsInputError, match="missing required columns"):
        an.daily_sales(frame.drop("product_id"))
    with pytest.raises(AnalyticsInputError, match="outlier_flag"):
        an.outlier_summary(frame.drop("outlier_flag"))
    with pytest.raises(AnalyticsInputError, match="price"):
        an.price_profile(frame.drop("price"))
    with pytest.raises(AnalyticsInputError, match="category"):
        an.category_analysis(frame.drop("category"))


def test_gap_rows_do_not_count(frame):
    gap = frame.limit(1).withColumns({"is_gap_fill": F.lit(1), "sales_quantity": F.lit(999)})
    got = an.dataset_summary(frame.unionByName(gap)).first()
    assert (got.total_units_sold, got.total_rows) == (60, 8)


def test_summary(frame):
    assert an.dataset_summary(frame).first().asDict() == {
        "total_rows": 8, "total_products": 2, "total_units_sold": 60,
        "date_start": dt.date(2024, 1, 1), "date_end": dt.date(2024, 1, 4), "n_dates": 4,
        "avg_daily_demand": 15.0, "zero_sales_pct": 25.0, "outlier_flag_count": 1}


def test_daily_sales(frame):
    got = an.daily_sales(frame, (2,)).collect()
    assert [r.total_units for r in got] == [15, 5, 20, 20]
    assert [r.ma_2 for r in got] == [None, 10.0, 12.5, 20.0]


def test_weeks_and_months(frame):
    assert [tuple(r) for r in an.weekly_sales(frame).collect()] == [(dt.date(2024, 1, 1), 60)]
    assert [tuple(r) for r in an.monthly_sales(frame).collect()] == [(dt.date(2024, 1, 1), 60)]


def test_products(frame):
    assert [r.product_id for r in an.top_products(frame, 2).collect()] == ["P1", "P2"]
    assert [r.product_id for r in an.top_products(frame, 1, lowest=True).collect()] == ["P2"]
    got = by(an.product_metrics(frame), "product_id")
    assert got["P1"].zero_sales_pct == got["P2"].zero_sales_pct == 25.0
    assert (got["P1"].total_units, got["P1"].outlier_count) == (40, 1)
    assert got["P1"].product_name == "P1"


def test_product_without_sales_has_no_cv(frame):
    got = an.product_metrics(frame.withColumn("sales_quantity", F.lit(0).cast("bigint")))
    assert [r.cv for r in got.collect()] == [None, None]


def test_events(frame):
    got = by(an.event_analysis(frame), "event")
    assert set(got) == {"holiday", "snap_day", "SuperBowl"}
    holiday, bowl = got["holiday"], got["SuperBowl"]
    assert (holiday.observations, holiday.avg_units, holiday.median_units) == (2, 10.0, 10.0)
    assert holiday.pct_vs_baseline == pytest.approx((10 / (40 / 6) - 1) * 100, rel=1e-3)
    assert (bowl.event_type, bowl.observations) == ("named_event", 2)
    assert bowl.baseline_avg_units == pytest.approx(40 / 6, rel=1e-3)


def test_event_tables_without_events(frame):
    plain = frame.drop("snap_day", "holiday", "event_name")
    assert an.event_analysis(plain).isEmpty()
    one_sided = frame.withColumn("holiday", F.lit(0))
    assert "holiday" not in by(an.event_flags(one_sided), "event")
    always = frame.withColumn("event_name", F.lit("Fair"))
    assert by(an.named_events(always), "event")["Fair"].pct_vs_baseline is None


def test_strongest_events(frame):
    got = an.strongest_events(frame).collect()
    assert [(r.direction, r.event) for r in got] == [
        ("positive", "SuperBowl"), ("negative", "SuperBowl")]


def test_outliers(frame):
    got = an.outlier_summary(frame).first()
    assert (got.total_flagged, got.on_holiday_days, got.on_snap_day_days) == (1, 1, 0)
    assert got.pct_on_event_days == 100.0
    assert got.pct_of_all_rows_on_event_days == 50.0
    assert got.flagged_pct_of_rows == 12.5
    assert [tuple(r) for r in an.outliers_by_product(frame).collect()] == [("P1", 1)]
    assert [tuple(r) for r in an.outliers_by_event(frame).collect()] == [("SuperBowl", 1)]


def test_prices(frame):
    got = by(an.price_profile(frame), "product_id")
    assert (got["P1"].n_price_changes, got["P2"].n_price_changes) == (1, 0)
    assert got["P1"].within_product_corr is None and got["P2"].within_product_corr is None
    assert an.price_summary(frame).first().products_with_computable_within_corr == 0
    assert "confounded" in an.PRICE_NOTE


def test_price_profile_against_plain_python(spark):
    """Several stores: changes run on across stores, moments combine."""
    data, flat = [], []
    for s in range(3):
        for i, d in enumerate(days("2024-01-01", 20)):
            price, q = 1.0 + (s * 7 + i * 3) % 5 / 4, (i * 5 + s) % 9
            if (i + s) % 6 == 0:
                price = None
            data.append((d, "P", "P", "C", q, price, 0, 0, "none", f"S{s}", 0, 0))
            if price is not None:
                flat.append((price, q))
    got = an.price_profile(spark.createDataFrame(data, SCHEMA)).first()
    steps = sum(a[0] != b[0] for a, b in zip(flat, flat[1:]))
    n = len(flat)
    mp, mq = sum(p for p, _ in flat) / n, sum(q for _, q in flat) / n
    cov = sum((p - mp) * (q - mq) for p, q in flat)
    corr = cov / math.sqrt(sum((p - mp) ** 2 for p, _ in flat)
                           * sum((q - mq) ** 2 for _, q in flat))
    assert got.n_price_changes == steps
    assert got.within_product_corr == pytest.approx(corr, abs=1e-4)
    assert got.avg_price == pytest.approx(mp, abs=1e-3)


def test_constant_prices_have_no_correlation(frame):
    flat = frame.withColumn("price", F.lit(2.0))
    got = an.price_profile(flat, min_obs=2).collect()
    assert [r.within_product_corr for r in got] == [None, None]
    assert an.price_summary(flat, 2).first().pooled_correlation is None


def test_weekdays(frame):
    got = an.day_of_week(frame).collect()
    assert [r.day_of_week for r in got] == list(an.DAY_NAMES)
    week = {r.day_of_week: r for r in got}
    assert week["Monday"].total_units == 15
    assert week["Thursday"].avg_daily_total_units == 20.0
    assert (week["Sunday"].n_dates, week["Sunday"].total_units) == (0, 0)


def test_categories(frame):
    got = by(an.category_analysis(frame), "category")
    assert set(got) == {"FOODS", "HOUSEHOLD"}
    assert (got["FOODS"].total_units, got["FOODS"].units_share_pct) == (40, 66.67)
    assert an.category_analysis(frame.withColumn("category", F.lit("FOODS"))).count() == 1


def test_rows_without_a_product_are_left_out(frame):
    extra = frame.limit(1).withColumn("product_id", F.lit(None).cast("string"))
    got = an.product_metrics(frame.unionByName(extra))
    assert {r.product_id for r in got.collect()} == {"P1", "P2"}


def test_growth(spark):
    data = [(d, "P", 1 if d.year == 2020 else 2) for d in days("2020-01-01", 731)]
    df = spark.createDataFrame(data, "date date, product_id string, sales_quantity bigint")
    months = [r.total_units for r in an.monthly_sales(df).collect()]
    want = sum(months[-13:-1]) / sum(months[1:13]) - 1
    assert an.demand_growth(df).first().growth_pct == pytest.approx(want * 100, abs=0.06)


# ---- first look at raw data ------------------------------------------------------

def test_describe(frame):
    got = by(inspect.describe_measures(frame), "measure")
    sales = got["sales_quantity"]
    assert (sales["count"], sales["min"], sales["q25"], sales["q50"], sales["q75"],
            sales["max"]) == (8, 0.0, 3.75, 7.5, 10.0, 20.0)
    assert got["price"]["mean"] == 3.0


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_exact_quantiles_against_plain_python(spark, n):
    values = [((i * 7919) % 1009) / 8 - 30 for i in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double")
    hist = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = exact_quantiles(hist, ["k"], "v", "n", probs).first()
    ordered = sorted(values)
    for name, p in probs.items():
        pos = p * (n - 1)
        lo, hi = ordered[math.floor(pos)], ordered[math.ceil(pos)]
        assert got[name] == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))


def test_days_per_product(frame):
    got = inspect.days_per_product(frame.where("product_id = 'P1' OR holiday = 1")).first()
    assert (got.min_days, got.median_days, got.max_days, got.total_days) == (1, 2, 4, 4)


def test_price_steps_over_missing_prices_count_nothing(spark):
    prices = [2.0, None, 3.0, 3.0, 4.0]
    df = spark.createDataFrame(
        [(d, "P", "S", p) for d, p in zip(days("2024-01-01", 5), prices)],
        "date date, product_id string, store_id string, price double")
    assert inspect.avg_price_changes(df).first()[0] == 1.0
    twice = df.unionByName(df)
    assert inspect.avg_price_changes(twice).first()[0] == 1.0


def test_flag_lift(frame):
    got = by(inspect.flag_lift(frame), "flag")
    assert (got["holiday"].frequency, got["holiday"].avg_on) == (0.25, 10.0)
    assert got["holiday"].lift_pct == 50.0


def test_event_frequency(frame):
    raw = frame.withColumn("event_name", F.when(
        F.col("event_name") != "none", F.col("event_name")))
    assert [tuple(r) for r in inspect.event_frequency(raw).collect()] == [
        ("SuperBowl", 2, 10.0, 50.0)]


def test_deviation_of_fractional_demand(spark):
    sales = [1e6 + x for x in (0.1, 0.4, 0.9, 0.2, 0.2)]
    rows = [(d, "P", s, q) for s in ("S1", "S2") for d, q in zip(days("2024-01-01", 5), sales)]
    df = spark.createDataFrame(
        rows, "date date, product_id string, store_id string, sales_quantity double")
    got = an.product_metrics(df).first()
    assert got.std_daily_units == round(statistics.stdev(sales * 2), 3)
    assert got.avg_daily_units == round(statistics.fmean(sales), 3)
