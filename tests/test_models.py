import datetime as dt
import json
import random
from unittest.mock import MagicMock

import pytest
from conftest import days
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tillspark.operators import metrics, split
from tillspark.operators.features import build_features
from tillspark.plans import training
from tillspark.schema import ModelBundleError, TrainingInputError
from tillspark.session import stage

FAST = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}


@pytest.fixture(scope="module")
def featured(spark):
    """Two series of 90 days with weekly demand, through the feature job."""
    rng, data = random.Random(0), []
    for pid in ("A", "B"):
        for d in days("2024-01-01", 90):
            q = 10 + 6 * (d.weekday() >= 5) + rng.randint(0, 2)
            data.append((d, pid, pid, "FOODS", q, 2.5, int(d.day <= 10), 0, "none", "S1", 0, 0))
    raw = spark.createDataFrame(
        data, "date date, product_id string, product_name string, category string, "
        "sales_quantity bigint, price double, snap_day int, holiday int, event_name string, "
        "store_id string, is_gap_fill int, outlier_flag int")
    return stage(build_features(raw)[0], "featured")


@pytest.fixture(scope="module")
def baseline(featured):
    return training.train_baseline(featured, params=FAST)


@pytest.fixture(scope="module")
def comparison(featured):
    return training.compare_models(
        featured, grid={"maxDepth": [2, 3]}, base_params={"maxIter": 2, "stepSize": 0.3},
        forest_params={"numTrees": 3, "maxDepth": 4}, fixed_params=FAST, n_splits=2)


# ---- split --------------------------------------------------------------------

def test_splits_are_in_order_and_whole(featured):
    got = {r.split: r for r in split.split_boundaries(featured).collect()}
    assert got["train"].end_date < got["validation"].start_date
    assert got["validation"].end_date < got["test"].start_date
    assert [got[s].n_dates for s in split.SPLITS] == [62, 14, 14]
    labelled = split.chronological_split(featured)
    days_per = {r.split: r.n for r in labelled.groupBy("split").agg(
        F.count_distinct("date").alias("n")).collect()}
    assert days_per == {"train": 62, "validation": 14, "test": 14}
    assert labelled.where("split = 'train'").agg(F.max("date")).first()[0] \
        == got["train"].end_date


def test_wrong_fractions(featured):
    with pytest.raises(TrainingInputError, match="split fractions"):
        split.chronological_split(featured, 0.8, 0.3)
    with pytest.raises(TrainingInputError, match="A split is empty"):
        split.split_ranges(featured.where("date < '2024-01-03'"))


def test_feature_choice(featured):
    chosen = split.select_features(featured)
    assert not set(chosen) & set(split.NOT_FEATURES)
    assert {"lag_1", "rolling_mean_7", "is_weekend", "price_change"} <= set(chosen)
    with pytest.raises(TrainingInputError, match="No usable"):
        split.select_features(featured.select("date", "outlier_flag"))


def test_folds_expand_over_dates(featured):
    got = split.date_folds(featured, 3).collect()
    assert [r.n_train_dates for r in got] == [24, 46, 68]
    assert [r.n_valid_dates for r in got] == [22, 22, 22]
    for r in got:
        assert r.train_end + dt.timedelta(days=1) == r.valid_start
    assert got[-1].valid_end == dt.date(2024, 3, 30)


def test_input_checks(featured, spark):
    check = split.check_training_input
    with pytest.raises(TrainingInputError, match="empty"):
        check(featured.limit(0))
    with pytest.raises(TrainingInputError, match="target"):
        check(featured.drop("sales_quantity"))
    with pytest.raises(TrainingInputError, match="duplicate"):
        check(featured.unionByName(featured.limit(1)))
    with pytest.raises(TrainingInputError, match="engineered features"):
        check(featured.drop("lag_1", "lag_7"))
    with pytest.raises(TrainingInputError, match="must be a date"):
        check(featured.withColumn("date", F.col("date").cast("string")))
    with pytest.raises(TrainingInputError, match="must be numeric"):
        check(featured.withColumn("sales_quantity", F.lit("x")))


# ---- metrics -------------------------------------------------------------------

def test_known_errors(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 3.0), (3.0, 3.0, 4.0)],
                               "y double, good double, off double")
    assert metrics.evaluate(df, "y", "good").first().asDict() == {
        "mae": 0.0, "rmse": 0.0, "r2": 1.0}
    got = metrics.evaluate(df, "y", "off").first()
    assert (got.mae, got.rmse, got.r2) == (1.0, 1.0, -0.5)


def test_constant_target(spark):
    df = spark.createDataFrame([(2.0, 2.0, 3.0), (2.0, 2.0, 3.0)], "y double, a double, b double")
    assert metrics.evaluate(df, "y", "a").first().r2 == 1.0
    assert metrics.evaluate(df, "y", "b").first().r2 == 0.0


# ---- one model -----------------------------------------------------------------

def test_baseline(baseline, featured):
    assert baseline.tables["test_predictions"].columns == ["date", "product_id", "actual", "predicted"]
    assert baseline.tables["test_predictions"].count() == baseline.sizes["test"] == 28
    assert sum(baseline.sizes.values()) == 180
    assert set(baseline.scores) == {"validation", "test"}
    assert all(set(m) == {"mae", "rmse", "r2"} for m in baseline.scores.values())
    naive = metrics.evaluate(featured.where(F.col("date") >= "2024-03-17"),
                             "sales_quantity", "lag_1").first()
    assert baseline.scores["test"]["rmse"] < naive.rmse


def test_importance_is_ranked_and_complete(baseline):
    got = baseline.tables["importance"].collect()
    assert {r.feature for r in got} == set(baseline.features)
    weights = [r.importance for r in got]
    assert weights == sorted(weights, reverse=True)


def test_equal_seeds_give_equal_models(baseline, featured):
    again = training.train_baseline(featured, params=FAST)
    assert again.scores == baseline.scores


def test_another_estimator(featured):
    got = training.train_baseline(featured, params={"maxDepth": 2},
                                  estimator=DecisionTreeRegressor)
    assert got.settings == {"maxDepth": 2}
    assert got.tables["test_predictions"].count() == 28


def test_saved_files(spark, baseline, tmp_path):
    training.save_training(spark, baseline, str(tmp_path))
    bundle = training.load_bundle(spark, f"{tmp_path}/baseline_model")
    assert bundle.feature_names == baseline.features
    assert bundle.metadata["target"] == "sales_quantity"
    assert {"metrics", "trained_at", "params"} <= set(bundle.metadata)
    read = spark.read.option("header", True).csv
    assert read(f"{tmp_path}/feature_importance").count() == len(baseline.features)
    assert read(f"{tmp_path}/test_predictions").count() == 28


def test_bundles_that_cannot_be_used(spark, tmp_path):
    with pytest.raises(ModelBundleError, match="no model bundle"):
        training.load_bundle(spark, f"{tmp_path}/none")
    spark.createDataFrame([(json.dumps({"model_type": "x"}),)], "value string") \
        .write.text(f"{tmp_path}/half/metadata")
    with pytest.raises(ModelBundleError, match="feature_names"):
        training.load_bundle(spark, f"{tmp_path}/half")


# ---- comparison -----------------------------------------------------------------

def test_comparison(comparison):
    table = comparison.tables["comparison"].collect()
    assert {r.model for r in table} == {training.TUNED, training.FOREST, training.FIXED}
    assert all(r.training_time_seconds >= 0 for r in table)
    best = max(table, key=lambda r: r.validation_r2)
    assert comparison.name == best.model
    assert (comparison.settings is not None) == (best.model == training.TUNED)
    assert comparison.dropped_rows == 56
    assert sum(comparison.sizes.values()) == 180 - 56
    assert comparison.tables["test_predictions"].count() == comparison.sizes["test"]


def test_best_settings_are_saved_only_for_the_tuned_model(spark, comparison, tmp_path):
    for name, params in ((training.TUNED, {"maxDepth": 3}), (training.FOREST, None)):
        comparison.name, comparison.settings = name, params
        training.save_comparison(spark, comparison, f"{tmp_path}/{name}")
        assert (tmp_path / name / "best_params").exists() == (params is not None)
        assert training.load_bundle(spark, f"{tmp_path}/{name}/best_model").model_type == name
    got = json.loads(spark.read.text(f"{tmp_path}/{training.TUNED}/best_params").first()[0])
    assert got == {"maxDepth": 3}


def test_winner_rule(spark):
    table = spark.createDataFrame(
        [("A", 0.5, 0.99, 0), ("B", 0.9, 0.10, 1), ("C", 0.9, 0.50, 2)],
        "model string, validation_r2 double, test_r2 double, position int")
    assert training.select_winner(table) == "B"
    with pytest.raises(TrainingInputError, match="empty"):
        training.select_winner(table.limit(0))


def test_grid_is_capped(featured):
    big = {"maxIter": [1, 2, 3, 4, 5], "maxDepth": [2, 3, 4, 5, 6]}
    with pytest.raises(TrainingInputError, match="maximum"):
        training.tune_boosting(featured, [], big)
    assert len(training.grid_points(training.BOOSTING_GRID)) == 12


def test_missing_values_lie_below_the_training_minimum(spark):
    df = spark.createDataFrame([(3.0, 1), (None, 2), (5.0, 3)], "f double, g int")
    vectors = [r[0].toArray().tolist() for r in
               training.fit_encoder(df, ["f", "g"]).transform(df).select("features_vec").collect()]
    assert vectors == [[3.0, 1.0], [2.0, 2.0], [5.0, 3.0]]


def test_queries_fit_the_full_settings(monkeypatch):
    """No registered query passes settings of its own to the jobs."""
    from checks import queries

    asked = []

    def job(*args, **settings):
        asked.append((len(args), settings))
        raise InterruptedError
    for name in ("train_baseline", "tune_boosting", "compare_models"):
        monkeypatch.setattr(training, name, job)
    monkeypatch.setattr(training, "training_rows", lambda *_: None)
    monkeypatch.setattr(queries.split, "select_features", lambda _: [])
    monkeypatch.setattr(queries.fx, "staged_features", lambda *_: MagicMock())
    for fit in (queries._baseline.__wrapped__, queries.tune_grid, queries.compare_models,
                queries._bundle.__wrapped__):
        with pytest.raises(InterruptedError):
            fit(None, "sf")
    assert asked == [(1, {}), (2, {}), (1, {}), (1, {})]
