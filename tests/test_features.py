import random
import statistics

import pytest
from conftest import days
from pyspark.sql import functions as F

from tillspark.operators import features as ft
from tillspark.schema import FeatureInputError

SCHEMA = ("date date, product_id string, sales_quantity bigint, price double, "
          "store_id string, event_name string, holiday int, snap_day int")


@pytest.fixture
def series(spark):
    def make(sales, product="P1", start="2024-01-01", price=None):
        n = len(sales)
        price = price or [2.0] * n
        return spark.createDataFrame(
            [(d, product, q, p, "S1", "none", 0, 0)
             for d, q, p in zip(days(start, n), sales, price)], SCHEMA)

    return make


def values(df, name, product=None):
    if product:
        df = df.where(F.col("product_id") == product)
    return [r[0] for r in df.orderBy("date").select(name).collect()]


def test_calendar_of_a_known_date(series):
    got = ft.calendar_features(series([1], start="2024-03-15")).first().asDict()
    assert {k: got[k] for k in ft.calendar_columns(F.col("date"))} == {
        "year": 2024, "month": 3, "quarter": 1, "week_of_year": 11, "day_of_month": 15,
        "day_of_week": 4, "day_of_year": 75, "is_weekend": 0, "is_month_start": 0,
        "is_month_end": 0}


def test_weekends_and_month_ends(series):
    assert values(ft.calendar_features(series([1] * 4, start="2024-01-05")),
                  "is_weekend") == [0, 1, 1, 0]
    turn = ft.calendar_features(series([1] * 3, start="2024-01-31"))
    assert values(turn, "is_month_end") == [1, 0, 0]
    assert values(turn, "is_month_start") == [0, 1, 0]
    assert values(turn, "month") == [1, 2, 2]


def test_lags(series):
    out = ft.lag_features(series([10, 20, 30, 40, 50]), (1, 3))
    assert values(out, "lag_1") == [None, 10, 20, 30, 40]
    assert values(out, "lag_3") == [None, None, None, 10, 20]


def test_series_do_not_mix(series):
    df = series([100, 200, 300], "A").unionByName(series([7, 8, 9], "B"))
    assert values(ft.lag_features(df, (1,)), "lag_1", "B") == [None, 7, 8]
    prices = series([1, 1], "A", price=[10.0, 10.0]).unionByName(
        series([1, 1], "B", price=[2.0, 2.0]))
    assert values(ft.price_features(prices), "price_change", "B") == [None, 0.0]


def test_rolling_mean_excludes_today(series):
    out = ft.rolling_features(series([1, 2, 3, 4, 5]), (3,), ())
    assert values(out, "rolling_mean_3") == [None, None, None, 2.0, 3.0]


def test_a_spike_is_invisible_on_its_day(series):
    out = ft.rolling_features(series([1, 1, 1, 1000]), (3,), ())
    assert values(out, "rolling_mean_3")[3] == 1.0
    assert values(out, "rolling_max_3") == [None, None, None, 1.0]


def test_rolling_min_max_std(series):
    out = ft.rolling_features(series([10, 20, 30, 40]), (2,), ())
    assert values(out, "rolling_min_2")[2] == 10
    assert values(out, "rolling_max_2")[2] == 20
    assert values(out, "rolling_std_2")[2] == pytest.approx(statistics.stdev([10, 20]))


def test_rolling_median(series):
    out = ft.rolling_features(series(list(range(1, 11))), (), (3, 4))
    assert values(out, "rolling_median_3")[3] == 2.0
    assert values(out, "rolling_median_4")[4] == 2.5


def test_expanding_mean(series):
    out = ft.expanding_mean(series([10, 20, 30, 40]))
    assert values(out, "expanding_mean") == [None, 10.0, 15.0, 20.0]


def test_price_features(series):
    out = ft.price_features(series([1] * 4, price=[2.0, 2.0, 4.0, 4.0]), 2)
    assert values(out, "price_change") == [None, 0.0, 2.0, 0.0]
    assert values(out, "price_pct_change") == [None, 0.0, 1.0, 0.0]
    assert values(out, "rolling_price_mean_2") == [None, None, 2.0, 3.0]


def test_price_change_in_percent_bridges_missing_prices(series):
    out = ft.price_features(series([1] * 4, price=[2.0, None, 3.0, None]), 2)
    assert values(out, "price_pct_change") == [None, 0.0, 0.5, 0.0]
    assert values(out, "price_change") == [None, None, None, None]


def test_a_missing_event_counts_as_named(series):
    df = series([1, 1, 1]).withColumn("event_name", F.expr(
        "CASE day(date) WHEN 1 THEN 'none' WHEN 2 THEN 'Easter' END"))
    assert values(ft.event_features(df), "has_named_event") == [0, 1, 1]


def test_missing_sales_blank_the_following_windows(series):
    df = series([1, 2, 3, 4, 5, 6]).withColumn(
        "sales_quantity", F.when(F.dayofmonth("date") != 2, F.col("sales_quantity")))
    out, _ = ft.build_features(df, (1,), (2,), (2,), 2)
    assert values(out, "rolling_mean_2") == [None, None, None, None, 3.5, 4.5]
    assert values(out, "rolling_median_2") == [None, None, None, None, 3.5, 4.5]
    assert values(out, "expanding_mean") == [None, 1.0, 1.0, 2.0, 8 / 3, 13 / 4]


def test_warm_up_stays_missing(series):
    df = series(list(range(40)), "A").unionByName(series(list(range(40)), "B"))
    out, names = ft.build_features(df, (1, 7), (7,), (), 7)
    missing = {r.feature: r.n_missing
               for r in ft.feature_null_report(out, names).collect()}
    assert out.count() == 80
    assert (missing["lag_1"], missing["lag_7"], missing["rolling_mean_7"]) == (2, 14, 14)


def test_default_job(series):
    df = series(list(range(30))).withColumn("event_name", F.when(
        F.dayofmonth("date") == 6, "SuperBowl").otherwise("none"))
    out, names = ft.build_features(df)
    assert out.count() == 30 and len(names) == 34
    assert values(out, "has_named_event") == [int(i == 5) for i in range(30)]
    assert values(out, "event_name")[5] == "SuperBowl"
    assert names[:10] == list(ft.calendar_columns(F.col("date")))
    assert {"lag_28", "rolling_std_28", "rolling_median_7", "price_change"} <= set(names)


def test_against_plain_python(series):
    random.seed(3)
    sales = [random.randint(0, 50) for _ in range(60)]
    out, _ = ft.build_features(series(sales))
    for w in (7, 14, 28):
        for name, fn in (("mean", statistics.mean), ("std", statistics.stdev),
                         ("min", min), ("max", max)):
            want = [None if t < w else fn(sales[t - w:t]) for t in range(60)]
            assert values(out, f"rolling_{name}_{w}") == pytest.approx(want)
    for w in (7, 28):
        want = [None if t < w else statistics.median(sales[t - w:t]) for t in range(60)]
        assert values(out, f"rolling_median_{w}") == pytest.approx(want)


@pytest.mark.parametrize("changed", [10, 29, 35])
def test_no_feature_sees_today_or_later(series, changed):
    before = [(i * 7) % 11 for i in range(40)]
    after = before[:changed] + [999] * (40 - changed)
    one, names = ft.build_features(series(before))
    two, _ = ft.build_features(series(after))
    upto = F.col("date") <= days("2024-01-01", 40)[changed]
    cols = ["date", *names]
    assert one.where(upto).select(*cols).exceptAll(two.where(upto).select(*cols)).isEmpty()


def test_wrong_input_is_refused(series, spark):
    df = series([1, 2, 3, 4])
    with pytest.raises(FeatureInputError, match="duplicate"):
        ft.build_features(df.unionByName(df.limit(1)))
    with pytest.raises(FeatureInputError, match="continuous"):
        ft.build_features(df.where("date <> '2024-01-03'"))
    with pytest.raises(FeatureInputError, match="Missing required"):
        ft.build_features(df.drop("sales_quantity"))
    with pytest.raises(FeatureInputError, match="empty"):
        ft.build_features(df.limit(0))
    with pytest.raises(FeatureInputError, match="must be a date"):
        ft.build_features(df.withColumn("date", F.col("date").cast("string")))


def test_wrong_settings_are_refused(series):
    df = series([1, 2, 3])
    for lags in ((-1, 7), (0,)):
        with pytest.raises(FeatureInputError, match="positive integers"):
            ft.build_features(df, lags)
    with pytest.raises(FeatureInputError, match=">= 2"):
        ft.build_features(df, windows=(1,))


def test_optional_columns_may_be_absent(series):
    out, names = ft.build_features(series([1, 2, 3]).drop("price", "event_name", "store_id"))
    assert "price_change" not in names and "has_named_event" not in names
    assert values(out, "lag_1") == [None, 1, 2]


def fractional(spark, sales, start="2024-01-01"):
    return spark.createDataFrame(
        [(d, "P1", "S1", q) for d, q in zip(days(start, len(sales)), sales)],
        "date date, product_id string, store_id string, sales_quantity double")


def test_rolling_figures_of_fractions_do_not_drift(spark):
    sales = [1e9] * 5 + [0.4] * 8 + [0.1, 0.7]
    out = ft.rolling_features(fractional(spark, sales), (7,), (7,))
    assert values(out, "rolling_mean_7")[12] == 0.4
    assert values(out, "rolling_std_7")[12] == 0.0
    want = statistics.stdev([0.4] * 6 + [0.1])
    assert values(out, "rolling_std_7")[14] == pytest.approx(want, rel=1e-12)
    assert values(out, "rolling_median_7")[14] == 0.4


def test_rolling_figures_of_random_fractions(spark):
    rng = random.Random(4)
    sales = [rng.choice([rng.random(), 1e6 + rng.random(), None, float("nan")])
             if i < 40 else rng.random() for i in range(120)]
    out = ft.rolling_features(fractional(spark, sales), (7, 14), ())
    for w in (7, 14):
        mean, std = values(out, f"rolling_mean_{w}"), values(out, f"rolling_std_{w}")
        for i in range(len(sales)):
            last = [x for x in sales[max(0, i - w):i] if x is not None and x == x]
            if len(last) < w:
                assert mean[i] is None and std[i] is None
            else:
                assert mean[i] == pytest.approx(statistics.fmean(last), rel=1e-12)
                assert std[i] == pytest.approx(statistics.stdev(last), rel=1e-9)


def test_features_of_fractional_demand(spark):
    table, names = ft.build_features(fractional(spark, [i / 10 for i in range(40)]))
    row = table.orderBy(F.desc("date")).first()
    last = [i / 10 for i in range(32, 39)]
    assert row.rolling_mean_7 == pytest.approx(statistics.fmean(last))
    assert row.rolling_std_7 == pytest.approx(statistics.stdev(last))
    assert row.rolling_max_7 == 3.8
