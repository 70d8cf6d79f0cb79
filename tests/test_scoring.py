import random

import pytest
from pyspark.sql import functions as F
from pyspark.ml.regression import GBTRegressor
from pyspark.ml import PipelineModel

from tillspark.operators import scoring
from conftest import plan_of
from tillspark.__main__ import main as command
from tillspark.plans import jobs, training
from tillspark.schema import REQUEST_SCHEMA, RequestError
from tillspark.streaming import append_log, read_log, score_stream

FEATURES = ["price", "snap_day", "holiday", "has_named_event", "year", "month",
            "day_of_week", "is_weekend", "lag_1", "lag_7", "rolling_mean_7"]


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    rng, data = random.Random(0), []
    for _ in range(300):
        x = [rng.random() * 10 for _ in FEATURES]
        data.append((*x, 2 * x[8] + x[1] + rng.gauss(0, 0.5)))
    train = spark.createDataFrame(data, ", ".join(f"{f} double" for f in FEATURES) + ", y double")
    encoder = training.fit_encoder(train, FEATURES)
    tree = GBTRegressor(featuresCol="features_vec", labelCol="y", maxIter=3, seed=0).fit(
        encoder.transform(train))
    path = str(tmp_path_factory.mktemp("models") / "best")
    training.save_bundle(spark, path, PipelineModel(stages=[*encoder.stages, tree]),
                         FEATURES, "FixedBoosting")
    return training.load_bundle(spark, path)


@pytest.fixture
def requests(spark):
    """Valid requests; each dict overrides fields of one of them."""

    def make(*overrides):
        base = {"date": "2016-03-01", "product_id": "FOODS_3_090", "price": 3.48,
                "snap_day": 1, "holiday": 0, "has_named_event": 0,
                "features": [("lag_1", 12.0), ("lag_7", 9.0), ("rolling_mean_7", 10.5)]}
        rows = [tuple({**base, **o}[f] for f in REQUEST_SCHEMA.fieldNames()) for o in overrides]
        return spark.createDataFrame(rows, REQUEST_SCHEMA)

    return make


@pytest.mark.parametrize("over, reason", [
    ({"date": "2016-13-45"}, "not_a_date"), ({"date": "March 1st"}, "bad_date_format"),
    ({"date": "20160301"}, "bad_date_format"), ({"date": None}, "bad_date_format"),
    ({"date": "2016-02-30"}, "not_a_date"),
    ({"product_id": ""}, "empty_product"), ({"product_id": None}, "empty_product"),
    ({"price": None}, "price_not_positive"), ({"price": -2.5}, "price_not_positive"),
    ({"price": 0.0}, "price_not_positive"), ({"snap_day": 2}, "bad_snap_day"),
    ({"holiday": -1}, "bad_holiday"), ({"has_named_event": 7}, "bad_has_named_event"),
    ({"features": [("lag_1", 5.0), ("lag_1", 7.0)]}, "duplicate_feature"),
    ({"features": [("not_a_feature", 1.0)]}, "unknown_feature"),
])
def test_one_reason_each(requests, over, reason):
    df = requests(over, {})
    got = scoring.rejected_requests(df, FEATURES).collect()
    assert [r.reasons for r in got] == [[reason]]
    assert scoring.valid_requests(df, FEATURES).count() == 1


def test_all_reasons_are_given(requests):
    got = scoring.validate_requests(requests(
        {"price": -1.0, "product_id": "", "features": [("", 1.0)]}), FEATURES).first()
    assert got.reasons == ["empty_product", "price_not_positive", "empty_feature_name",
                           "unknown_feature"]


def test_feature_row(requests):
    df = requests({}, {"product_id": "Q", "snap_day": None, "features": None},
                  {"product_id": "R", "features": [("month", 99.0), ("lag_1", None),
                                                   ("price", None)]})
    got = {r.product_id: r for r in scoring.request_features(df, FEATURES).collect()}
    full, bare, over = got["FOODS_3_090"], got["Q"], got["R"]
    assert (full.x_year, full.x_month, full.x_day_of_week, full.x_is_weekend) == (2016, 3, 1, 0)
    assert (full.x_price, full.x_snap_day, full.x_lag_1, full.x_rolling_mean_7) == (
        3.48, 1.0, 12.0, 10.5)
    assert (bare.x_snap_day, bare.x_lag_1) == (0.0, None)
    assert (over.x_month, over.x_lag_1, over.x_price) == (99.0, None, None)


def test_batch(requests, bundle):
    df = requests(*[{"product_id": f"P{i}"} for i in range(3)])
    got = scoring.score_batch(df, bundle).collect()
    assert [r.product_id for r in got] == ["P0", "P1", "P2"]
    assert len({r.predicted_sales for r in got}) == 1
    assert {r.model_type for r in got} == {"FixedBoosting"}
    again = scoring.score_batch(df, bundle).collect()
    assert [r.predicted_sales for r in again] == [r.predicted_sales for r in got]


def test_predictions_are_never_negative(requests, bundle):
    df = requests({"features": [("lag_1", -50.0), ("lag_7", -50.0)]}, {"features": []})
    assert all(r.predicted_sales >= 0 for r in scoring.score_batch(df, bundle).collect())


def test_bad_batches_are_refused(requests, bundle):
    with pytest.raises(RequestError, match="empty"):
        scoring.score_batch(requests({}).limit(0), bundle)
    with pytest.raises(RequestError, match="1 of 2.*price_not_positive"):
        scoring.score_batch(requests({}, {"price": -1.0}), bundle)


def test_split_mode_keeps_the_rejected(requests, bundle):
    got = scoring.score_batch(requests({}, {"price": -1.0}), bundle, mode="SPLIT")
    rows = {r.status: r for r in got.collect()}
    assert rows["success"].predicted_sales > 0 and rows["success"].reasons == []
    assert rows["error"].predicted_sales is None
    assert rows["error"].reasons == ["price_not_positive"]


def test_columns_of_the_request_are_echoed(requests, bundle):
    df = requests({}).withColumns({"ticket": F.lit(7), "lag_1": F.lit("mine")})
    got = scoring.score_batch(df, bundle).first()
    assert (got.ticket, got.lag_1) == (7, "mine")


def test_stream_equals_batch_and_restarts(spark, requests, bundle, tmp_path):
    df = requests(*[{"product_id": f"P{i}", "price": 1.0 + i if i else -1.0} for i in range(6)])
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.write.json(src)

    def run():
        score_stream(spark, src, bundle, out, state).awaitTermination()
        return spark.read.parquet(out).select("product_id", "status", "predicted_sales")

    want = scoring.score_batch(df, bundle, mode="SPLIT").select(
        "product_id", "status", "predicted_sales")
    got = run()
    assert got.count() == 6
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    requests({"product_id": "LATE"}).write.mode("append").json(src)
    again = run()
    assert again.count() == 7
    assert again.where("product_id = 'LATE' AND status = 'success'").count() == 1


def test_log_shows_the_newest_first(spark, requests, bundle, tmp_path):
    path = str(tmp_path / "log")
    for i, over in enumerate(({"product_id": "OLD"}, {"product_id": "NEW", "price": -1.0})):
        scored = scoring.score_batch(requests(over), bundle, mode="SPLIT")
        append_log(scored, path, F.to_timestamp(F.lit(f"2024-01-0{i + 1} 00:00:00")))
    got = read_log(spark, path).collect()
    assert [(r.label, r.status, r.prediction is None) for r in got] == [
        ("NEW 2016-03-01", "error", True), ("OLD 2016-03-01", "success", False)]
    assert read_log(spark, path, 1).count() == 1


def test_limit_reads_the_newest_days_only(spark, requests, bundle, tmp_path):
    path = str(tmp_path / "log")
    for day in range(1, 6):
        scored = scoring.score_batch(requests({"product_id": f"D{day}"}, {"product_id": "X"}), bundle)
        append_log(scored, path, F.to_timestamp(F.lit(f"2024-01-0{day} 08:00:00")))
    append_log(scoring.score_batch(requests({"product_id": "UNDATED"}), bundle), path,
               F.lit(None).cast("timestamp"))
    got = read_log(spark, path, 3)
    assert [r.label.split()[0] for r in got.collect()] == ["D5", "X", "D4"]
    read = [f for f in got.inputFiles()]
    assert read and plan_of(got).count("PartitionFilters: [isnotnull(day") == 1
    assert "2024-01-04" in plan_of(got)
    assert [r.label for r in read_log(spark, path, 11).collect()][-1].startswith("UNDATED")
    assert read_log(spark, path, 100).count() == read_log(spark, path).count() == 11


def test_scoring_commands(spark, requests, tmp_path, capsys):
    model, src, out, log = (str(tmp_path / n) for n in ("model", "in", "out", "log"))
    training.save_bundle(spark, model, training.formula_model("lag_1 * 2 - price"), FEATURES,
                         "Formula")
    requests({}, {"price": -1.0}).write.json(src)
    with pytest.raises(RequestError):
        jobs.score(spark, src, out, model)
    assert jobs.score(spark, src, out, model, split=True, log=log) == {"success": 1, "error": 1}
    assert {r.predicted_sales for r in spark.read.parquet(out).collect()} == {20.52, None}
    assert read_log(spark, log).count() == 2
    stream = jobs.score_arrivals(spark, src, f"{out}-stream", model)
    assert {r.predicted_sales for r in stream.collect()} == {20.52, None}
    assert jobs.score_arrivals(spark, src, f"{out}-stream", model).count() == 2
    with pytest.raises(SystemExit):
        command(["score", src, out])
    assert "needs --model" in capsys.readouterr().err
