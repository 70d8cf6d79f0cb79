import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillspark import sources
from tillspark.__main__ import main as command
from tillspark.operators import validate
from tillspark.operators.scoring import validate_requests
from tillspark.plans import jobs
from tillspark.schema import DataQualityError, RequestError

WIDE = "item_id string, cat_id string, store_id string, state_id string, " \
       "d_1 bigint, d_2 bigint, d_3 bigint"


@pytest.fixture(scope="module")
def raw(spark):
    wide = spark.createDataFrame(
        [("A", "FOODS", "CA_1", "CA", 1, 2, 3), ("B", "FOODS", "CA_1", "CA", 9, 0, 0),
         ("C", "FOODS", "CA_1", "CA", 0, 1, 0), ("A", "FOODS", "TX_1", "TX", 4, 4, 4),
         ("H", "HOBBIES", "CA_1", "CA", 50, 50, 50)], WIDE)
    calendar = spark.createDataFrame(
        [("d_1", "2011-01-29", 11101, None, 1, 0), ("d_2", "2011-01-30", 11101, "SuperBowl", 0, 1),
         ("d_3", "2011-02-05", 11102, None, 0, 0)],
        "d string, date string, wm_yr_wk int, event_name_1 string, snap_CA int, snap_TX int")
    prices = spark.createDataFrame(
        [("CA_1", "A", 11101, 2.005), ("CA_1", "A", 11102, 2.5), ("CA_1", "B", 11102, 1.0),
         ("TX_1", "A", 11101, 7.0)],
        "store_id string, item_id string, wm_yr_wk int, sell_price double")
    return wide, calendar, prices


def test_preparation_of_one_store(raw):
    got = sources.prepare_subset(*raw, "CA_1", "FOODS", 2).orderBy("product_id", "date").collect()
    assert [(r.product_id, r.date, r.sales_quantity, r.price, r.snap_day, r.holiday, r.event_name)
            for r in got] == [
        ("A", dt.date(2011, 1, 29), 1, 2.0, 1, 0, None),
        ("A", dt.date(2011, 1, 30), 2, 2.0, 0, 1, "SuperBowl"),
        ("A", dt.date(2011, 2, 5), 3, 2.5, 0, 0, None),
        ("B", dt.date(2011, 2, 5), 0, 1.0, 0, 0, None)]


def test_preparation_of_all_stores(raw):
    got = sources.prepare_subset(*raw, None, None, None)
    snaps = {(r.product_id, r.date.day): r.snap_day
             for r in got.where("store_id = 'TX_1'").collect()}
    assert snaps == {("A", 29): 0, ("A", 30): 1}
    assert got.count() == 6


def test_unknown_store_raises(raw):
    with pytest.raises(ValueError, match="no rows"):
        sources.prepare_subset(*raw, "ZZ_9", "FOODS")


def test_totals_treat_missing_days_as_nothing(raw):
    wide = raw[0].withColumn("d_2", F.lit(None).cast("bigint"))
    got = {(r.item_id, r.store_id): r.total_units for r in sources.row_totals(wide).collect()}
    assert got[("A", "CA_1")] == 4


def test_raw_files(spark, raw, tmp_path):
    with pytest.raises(FileNotFoundError, match="no sales file"):
        sources.read_raw_files(spark, str(tmp_path))
    wide, calendar, prices = raw
    sources.write_csv(wide, str(tmp_path / "sales_train_validation.csv"))
    with pytest.raises(FileNotFoundError, match="calendar"):
        sources.read_raw_files(spark, str(tmp_path))
    sources.write_csv(calendar, str(tmp_path / "calendar.csv"))
    sources.write_csv(prices, str(tmp_path / "sell_prices.csv"))
    again = sources.read_raw_files(spark, str(tmp_path))
    want = sources.prepare_subset(*raw, "CA_1", "FOODS", 2)
    got = sources.prepare_subset(*again, "CA_1", "FOODS", 2)
    assert got.schema == want.schema
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_raw_files_with_line_breaks(spark, raw, tmp_path):
    wide, calendar, prices = raw
    broken = calendar.withColumn("event_name_1", F.regexp_replace("event_name_1", "Bowl", "\nBowl"))
    for table, name in ((wide, "sales_train_validation"), (broken, "calendar"),
                        (prices, "sell_prices")):
        sources.write_csv(table, str(tmp_path / f"{name}.csv"))
    again = sources.read_raw_files(spark, str(tmp_path), multi_line=True)
    assert again[1].count() == calendar.count() < sources.read_raw_files(
        spark, str(tmp_path))[1].count()
    out = str(tmp_path / "out")
    command(["prepare", str(tmp_path), out, "--store", "CA_1", "--multi-line", "--master", "local"])
    names = {r.event_name for r in sources.read_sales_parquet(spark, out).collect()}
    assert "Super\nBowl" in names


def test_missing_marks_in_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("date,product_id,sales_quantity,price,store_id\n"
                    "2024-01-01,P1,3,NA,S1\n2024-01-02,None,nan,2.5,S1\n")
    raw = sources.read_sales_csv(spark, str(path))
    assert set(dict(raw.dtypes).values()) == {"string"}
    got = sources.read_sales_csv(spark, str(path), parse=True).orderBy("date").collect()
    assert [tuple(r) for r in got] == [
        (dt.date(2024, 1, 1), "P1", 3, None, "S1"), (dt.date(2024, 1, 2), None, None, 2.5, "S1")]


def test_requests_from_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("date, product_id,price,lag_1,rolling_mean_7,snap_day,other\n"
                    "2024-01-01,P1,2.5,12,,1,x\n2024-01-02,P2,3.0,oops,4.5,,y\n")
    got = sources.read_requests_csv(spark, str(path)).orderBy("date").collect()
    assert [(r.product_id, r.price, r.snap_day, r.holiday,
             [tuple(f) for f in r.features]) for r in got] == [
        ("P1", 2.5, 1, None, [("lag_1", 12.0)]),
        ("P2", 3.0, None, None, [("lag_1", None), ("rolling_mean_7", 4.5)])]


def test_csv_without_a_required_column(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("date,product_id\n2024-01-01,P1\n")
    with pytest.raises(RequestError, match="price"):
        sources.read_requests_csv(spark, str(path))


@pytest.mark.parametrize("line", ["2024-01-02,P2", "2024-01-02,P2,1.0,5,9"])
def test_ragged_csv_fails(spark, tmp_path, line):
    path = tmp_path / "r.csv"
    path.write_text(f"date,product_id,price,lag_1\n2024-01-01,P1,2.5,12\n{line}\n")
    requests = sources.read_requests_csv(spark, str(path))
    for df in (requests, requests.select("date")):
        with pytest.raises(Exception, match="MALFORMED"):
            df.collect()


def test_requests_from_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '[{"date":"2024-01-01","product_id":"P1","price":2.5,'
        '"features":[{"name":"lag_1","value":null}]},'
        '{"date":"2024-01-02","product_id":"P2","price":3.0}]')
    got = sources.read_requests_json(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.product_id, r.features and [tuple(f) for f in r.features]) for r in got] == [
        ("P1", [("lag_1", None)]), ("P2", None)]


def test_requests_wrapped_and_over_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"requests": [\n {"date":"2024-01-01","product_id":"P1",\n"price":2.5,"snap_day":1.0},\n'
        '{"date":"2024-01-02","product_id":"P2","price":3.0,"snap_day":"x"}]}')
    (tmp_path / "b.json").write_text(
        '[\n {"date":"2024-01-03","product_id":"P3","price":1,"holiday":0.7}\n]')
    got = sources.read_requests_json(spark, str(tmp_path), whole_files=True)
    checked = validate_requests(got, []).orderBy("date").collect()
    assert [(r.product_id, list(r.reasons)) for r in checked] == [
        ("P1", []), ("P2", ["bad_snap_day"]), ("P3", ["bad_holiday"])]


def test_flags_of_csv_requests_are_checked_before_any_cast(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("date,product_id,price,snap_day\n2024-01-01,P1,2.5,0.7\n"
                    "2024-01-02,P2,1,99999999999\n2024-01-03,P3,1,yes\n2024-01-04,P4,1,1.0\n")
    checked = validate_requests(sources.read_requests_csv(spark, str(path)), [])
    assert [(r.product_id, list(r.reasons)) for r in checked.orderBy("date").collect()] == [
        ("P1", ["bad_snap_day"]), ("P2", ["bad_snap_day"]), ("P3", ["bad_snap_day"]), ("P4", [])]


# ---- validation -----------------------------------------------------------------------

SALES = "date string, product_id string, sales_quantity string, price string, store_id string"


def test_valid_data_passes(spark):
    df = spark.createDataFrame([("2024-01-01", "P", "1", "2.0", "S"),
                                ("2024-01-02", "P", "2", "2.0", "S")], SALES)
    result = validate.validate_sales(df)
    assert result.is_valid
    assert result.summary().startswith("0 errors, ")
    assert any("Optional columns" in w for w in result.warnings)


def test_every_finding_is_reported(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "P", "1", "2.0", "S"), ("2024-01-01", "P", "1", "2.0", "S"),
         ("bad", "P", "x", "-1", "S"), (None, "P", None, None, "S"),
         ("2024-01-09", None, "-4", "0", "S")], SALES)
    result = validate.validate_sales(df)
    text = result.summary()
    assert not result.is_valid
    for part in ("2 rows have unparseable", "1 rows have non-numeric", "1 rows have negative",
                 "1 duplicate rows", "2 rows have zero/negative price", "1 rows have no product",
                 "Column 'price' is 20.0% missing"):
        assert part in text, part
    assert "missing days" not in text


def test_gaps_are_warned_about(spark):
    df = spark.createDataFrame([("2024-01-01", "P", "1", "2.0", "S"),
                                ("2024-01-05", "P", "2", "2.0", "S")], SALES)
    assert "3 missing days" in validate.validate_sales(df).summary()


def test_missing_columns_and_empty_data(spark):
    df = spark.createDataFrame([("2024-01-01", "P", "1", "2.0", "S")], SALES)
    assert "Missing required columns" in validate.validate_sales(df.drop("store_id")).summary()
    assert "empty" in validate.validate_sales(df.limit(0)).summary()


def test_sparse_columns_are_exempt(spark):
    df = spark.createDataFrame([("2024-01-01", "P", "1", "2.0", "S")], SALES).withColumn(
        "event_name", F.lit(None).cast("string"))
    assert "event_name" not in {r["column"] for r in validate.missing_fraction(df).collect()}


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    file = tmp_path / "plain.csv"
    file.write_text('date,product_id,store_id,sales_quantity\n'
                    '2024-01-01,"Nut ""big"", 5cm",s1,3\n2024-01-02,"two\nlines",s1,4\n')
    back = sources.read_sales_csv(spark, str(file), multi_line=True)
    assert [(r.product_id, r.store_id, r.sales_quantity) for r in back.orderBy("date").collect()] \
        == [('Nut "big", 5cm', "s1", "3"), ("two\nlines", "s1", "4")]
    sources.write_csv(back, str(tmp_path / "out"))
    again = sources.read_sales_csv(spark, str(tmp_path / "out"), multi_line=True)
    assert sorted(again.collect()) == sorted(back.collect())


def test_raw_cells_without_a_number_are_counted(spark, tmp_path):
    (tmp_path / "sales_train_evaluation.csv").write_text(
        "item_id,cat_id,store_id,state_id,d_1,d_2,d_3\n"
        "A,FOODS,CA_1,CA,3.0,x,4\nB,FOODS,CA_1,CA,,1d,5\n")
    (tmp_path / "calendar.csv").write_text(
        "d,date,wm_yr_wk,event_name_1,snap_CA\nd_1,2024-01-01,1,,0\n"
        "d_2,2024-01-02,1,,1\nd_3,2024-01-08,2,,zero\n")
    (tmp_path / "sell_prices.csv").write_text(
        "store_id,item_id,wm_yr_wk,sell_price\nCA_1,A,1,2.5\nCA_1,B,2,3\nCA_1,A,2,free\n")
    wide, calendar, prices = sources.read_raw_files(spark, str(tmp_path))
    assert [(r.d_1, r.d_2, r.d_3) for r in wide.orderBy("item_id").collect()] == [
        (3, None, 4), (None, None, 5)]
    found = {r.file: (r.n_rows, r.n_cells, r.n_unreadable)
             for r in sources.unreadable_cells(spark, str(tmp_path)).collect()}
    assert found == {"sales": (2, 5, 2), "calendar": (3, 6, 1), "prices": (3, 6, 1)}
    # A has a price in week 1 of two days, B in week 2 of one.
    assert jobs.preparation_counts(spark, str(tmp_path)) == {
        "unreadable_sales": 2, "unreadable_calendar": 1, "unreadable_prices": 1,
        "n_cells": 6, "n_prelaunch": 3}
    assert sources.prepare_subset(wide, calendar, prices).count() == 3
    with pytest.raises(DataQualityError, match="sales: no number in 2 of 5"):
        jobs.prepare(spark, str(tmp_path), str(tmp_path / "out"))


def test_prelaunch_count_equals_the_dropped_rows(raw):
    wide, calendar, prices = raw
    counted = sources.prelaunch_count(wide, calendar, prices).first()
    dated = sources.join_calendar(sources.melt_wide(wide), calendar, "CA")
    priced = sources.join_weekly_price(dated, prices)
    assert counted.n_cells == priced.count()
    assert counted.n_prelaunch == priced.where("sell_price IS NULL").count()
    none = sources.prelaunch_count(wide.limit(0), calendar, prices).first()
    assert (none.n_cells, none.n_prelaunch) == (0, 0)
