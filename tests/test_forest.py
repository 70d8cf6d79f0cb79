"""The forest: Spark ML's tree where nothing is drawn, both ways of growing, draws."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tillspark.plans import boosting, forest, training
from tillspark.plans.forest import ForestSettings, fit_forest

SHAPE = "date date, label double, key bigint, a double, b double, c double"
NAMES = ["a", "b", "c"]


def table(spark, rows):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(day + dt.timedelta(days=k % 40), float(y), hash((k, 7)) * 2654435761 % 2**62, a, b, c)
         for k, (y, a, b, c) in enumerate(rows)], SHAPE)


@pytest.fixture(scope="module")
def noisy(spark):
    """At most 20 values a feature, so that every one of them is a bin."""
    rng, rows = random.Random(4), []
    for _ in range(1500):
        a, b, c = (float(rng.randint(0, n)) for n in (19, 5, 11))
        rows.append((10 * (a > 7) + 3 * b + c * (b > 2) + 40 * rng.random() ** 3,
                     None if rng.random() < 0.1 else a, b, c))
    return table(spark, rows)


def test_a_comparison_fits_its_forest_without_spark_ml(noisy, monkeypatch):
    """Spark ML shuffles a full histogram for each of a deep forest's nodes."""
    monkeypatch.setattr(training, "_fit", lambda *_: pytest.fail("Spark ML was asked"))
    model = training._fit_forest({**training.FOREST_PARAMS, "numTrees": 3}, noisy, NAMES)
    assert model.settings == ForestSettings(3, 16, 2) and len(model.trees) == 3


def test_parameters_that_only_spark_ml_has_go_there(noisy):
    model = training._fit_forest({"numTrees": 2, "maxDepth": 2, "leafCol": "leaf"}, noisy, NAMES)
    assert model.stages[-1].getNumTrees == 2


def test_without_draws_it_is_the_tree_of_spark_ml(noisy):
    for more in ({"maxDepth": 4}, {"maxDepth": 9, "minInstancesPerNode": 7},
                 {"maxDepth": 9, "minInfoGain": 2.0}):
        params = {"numTrees": 1, "bootstrap": False, "seed": 1, **more}
        want = training._fit(RandomForestRegressor, params, noisy, NAMES)
        got = fit_forest(noisy, NAMES, ForestSettings(**params))
        both = want.transform(noisy).withColumnRenamed("prediction", "want")
        assert got.transform(both).where(F.abs(F.col("want") - F.col("prediction")) > 1e-3).isEmpty()
        assert len(got.trees[0].feature) >= want.stages[-1].totalNumNodes > 20


def test_rows_in_place_or_in_one_task_give_the_same_trees(noisy, monkeypatch):
    s = ForestSettings(numTrees=5, maxDepth=9, minInstancesPerNode=2)
    predicted = lambda m: m.transform(noisy).orderBy("key").select("prediction").collect()
    whole = fit_forest(noisy, NAMES, s)
    want = predicted(whole)
    monkeypatch.setattr(boosting, "SMALL_TABLE", 100)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    monkeypatch.setattr(forest, "TREES_AT_ONCE", 2)
    for small in (40, 5000):
        monkeypatch.setattr(boosting, "SMALL_NODE", small)
        parts = fit_forest(noisy.repartition(3), NAMES, s)
        assert predicted(parts) == want
        assert [len(t.feature) for t in parts.trees] == [len(t.feature) for t in whole.trees]
        assert parts.importances() == pytest.approx(whole.importances())


def test_weights_follow_poisson_and_features_are_drawn_evenly():
    key = np.arange(200_000, dtype=np.uint64)
    got = forest.weights(key, ForestSettings(), 3)
    assert np.bincount(got)[:4] / len(key) == pytest.approx([0.368, 0.368, 0.184, 0.061], abs=0.005)
    assert abs(np.corrcoef(got, forest.weights(key, ForestSettings(), 4))[0, 1]) < 0.01
    once = forest.weights(key, ForestSettings(bootstrap=False, subsamplingRate=0.3), 0)
    assert set(once) == {0, 1} and once.mean() == pytest.approx(0.3, abs=0.005)
    s = ForestSettings(numTrees=9)
    picked = forest.drawn(np.arange(1, 9000, dtype=np.uint64), s, 0, 37)
    assert picked.shape[1] == 13 and (np.diff(picked, axis=1) > 0).all()
    share = np.bincount(picked.ravel(), minlength=37) / len(picked)
    assert share == pytest.approx([13 / 37] * 37, abs=0.03)
    width = {k: ForestSettings(numTrees=9, featureSubsetStrategy=k).features_a_node(37)
             for k in ("all", "onethird", "sqrt", "log2", "5", "0.5")}
    assert list(width.values()) == [37, 13, 7, 6, 5, 19]


def test_rows_of_one_key_are_drawn_one_by_one(spark):
    rows = table(spark, [(k % 2, float(k % 2), 0.0, 0.0) for k in range(400)])
    s = ForestSettings(numTrees=8, maxDepth=1)
    model = fit_forest(rows.withColumns({"key": F.lit(5).cast("bigint"), "date": F.lit(
        dt.date(2024, 1, 1))}), ["a"], s)
    assert all(len(t.feature) == 3 and sorted(t.value[1:]) == pytest.approx([0, 1], abs=1e-4)
               for t in model.trees)


def test_ends_of_bins_lie_between_values():
    assert forest.cuts_of(np.array([1.0, 1.0, 2.0, 5.0]), 32) == [1.5, 3.5]
    assert forest.cuts_of(np.array([3.0, 3.0]), 32) == []
    many = forest.cuts_of(np.arange(1000.0), 32)
    assert len(many) == 31 and many[15] == pytest.approx(499.5)


def test_saved_forest_predicts_the_same(spark, noisy, tmp_path):
    model = fit_forest(noisy, NAMES, ForestSettings(numTrees=3, maxDepth=6))
    training.save_bundle(spark, f"{tmp_path}/f", model, NAMES, training.FOREST)
    again = training.load_bundle(spark, f"{tmp_path}/f").model
    want, got = (m.transform(noisy).select("prediction").collect() for m in (model, again))
    assert want == got and again.settings == model.settings
    assert sum(again.importances()) == pytest.approx(1.0)


def test_little_data(spark):
    one = table(spark, [(3, 1.0, None, 0.0)])
    model = fit_forest(one, ["a", "b"], ForestSettings(numTrees=2, bootstrap=False))
    assert model.transform(one).first().prediction == 3.0
    assert fit_forest(one.limit(0), ["a", "b"], ForestSettings(numTrees=2)).transform(
        one).first().prediction == 0.0
