"""Boosted trees: both ways of growing them, missing values, leaf-wise growth."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.plans import boosting
from tillspark.plans.boosting import Settings, fit_many

SHAPE = "date date, label double, key bigint, a double, b double, c double"


def table(spark, rows):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame(
        [(day + dt.timedelta(days=k % 40), float(y), hash((k, 7)) * 2654435761 % 2**62, a, b, c)
         for k, (y, a, b, c) in enumerate(rows)], SHAPE)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(1500):
        a, b, c = rng.random(), float(rng.randint(0, 5)), rng.gauss(0, 1)
        rows.append((10 * (a > 0.4) + 3 * b + c * (b > 2) + rng.random(),
                     None if rng.random() < 0.1 else a, b, c))
    return table(spark, rows)


SETTINGS = [Settings(maxIter=6, maxDepth=4, subsamplingRate=0.8, columnRate=0.7),
            Settings(maxIter=4, maxDepth=None, maxLeaves=9, l2=0.0, minLeafRows=20),
            Settings(maxIter=5, maxDepth=3, last=dt.date(2024, 1, 20))]
SPANS = {2: (dt.date(2024, 1, 21), dt.date(2024, 2, 9))}


def test_rows_in_place_or_in_one_task_give_the_same_trees(noisy, monkeypatch):
    whole = fit_many(noisy, ["a", "b", "c"], SETTINGS, SPANS, (2, 5))
    monkeypatch.setattr(boosting, "SMALL_TABLE", 100)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 200)
    monkeypatch.setattr(boosting, "CHECKPOINT_EVERY", 2)
    for small in (30, 600):
        monkeypatch.setattr(boosting, "SMALL_NODE", small)
        parts = fit_many(noisy.repartition(3), ["a", "b", "c"], SETTINGS, SPANS, (2, 5))
        assert [m.trees for m in parts.models] == [m.trees for m in whole.models]
        assert parts.errors == whole.errors
    assert {len(m.trees) for m in whole.models} == {4, 5, 6}


def test_errors_and_prefixes_follow_from_the_predictions(noisy):
    fitted = fit_many(noisy, ["a", "b", "c"], SETTINGS[2:], {0: SPANS[2]}, (2, 5))
    late = noisy.where(F.col("date") > "2024-01-20")
    for n in (2, 5):
        got = fitted.models[0].first(n).transform(late).agg(
            F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2))).first()[0]
        assert got == pytest.approx(fitted.errors[0, n], rel=1e-6)


def test_missing_values_go_where_they_belong(spark):
    """Missing rows resemble the high ones, then the low ones."""
    for high in (True, False):
        rows = [(0, 1.0, 0.0, 0.0)] * 50 + [(8, 2.0, 0.0, 0.0)] * 50
        rows += [(8 if high else 0, None, 0.0, 0.0)] * 30
        data = table(spark, rows)
        model = fit_many(data, ["a"], [Settings(maxIter=1, stepSize=1.0, maxDepth=1,
                                                l2=0.0)]).models[0]
        feature, cut, left, *_ = model.trees[0][0]
        assert (feature, cut, bool(left)) == (0, 1, not high)
        assert model.transform(data).where(
            F.abs(F.col("label") - F.col("prediction")) > 1e-4).count() == 0


def test_best_leaf_first_finds_a_deep_narrow_tree(spark):
    """A staircase takes a deep path that a tree of depth three can't hold."""
    rows = [(2.0 ** k, float(k), 0.0, 0.0) for k in range(10) for _ in range(30)]
    data = table(spark, rows)
    deep = Settings(maxIter=1, stepSize=1.0, maxDepth=None, maxLeaves=10, l2=0.0, minLeafRows=20)
    flat = Settings(maxIter=1, stepSize=1.0, maxDepth=3, l2=0.0)
    error = {}
    for name, s in (("deep", deep), ("flat", flat)):
        model = fit_many(data, ["a"], [s]).models[0]
        error[name] = model.transform(data).agg(F.max(F.abs(
            F.col("label") - F.col("prediction")))).first()[0]
        leaves = sum(node[0] < 0 for node in model.trees[0])
        assert leaves <= 10
    assert error["deep"] < 0.01 < error["flat"]


def test_a_split_is_the_best_of_all(noisy):
    """The first split against every split of every feature, one by one."""
    model = fit_many(noisy, ["a", "b", "c"], [Settings(maxIter=1, maxDepth=1)]).models[0]
    rows = noisy.select("label", "a", "b", "c").collect()
    y = np.array([r.label for r in rows]) - model.base
    best = -1.0
    for k, c in enumerate("abc"):
        values = np.array([np.nan if r[c] is None else r[c] for r in rows])
        bins = boosting._binned(values, np.array(model.edges[k]))
        for cut in range(1, bins.max() + 1):
            for left in (True, False):
                side = np.where(bins == 0, left, bins <= cut)
                if 0 < side.sum() < len(y):
                    gain = sum(y[p].sum() ** 2 / (p.sum() + 1.0) for p in (side, ~side))
                    best = max(best, gain - y.sum() ** 2 / (len(y) + 1.0))
    assert model.gains[0][0] == pytest.approx(best, rel=1e-4)


def test_saved_model_predicts_the_same(spark, noisy, tmp_path):
    model = fit_many(noisy, ["a", "b", "c"], SETTINGS[:1]).models[0]
    model.save(spark, str(tmp_path / "m"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    want, got = (m.transform(noisy).select("prediction").collect() for m in (model, again))
    assert want == got and sum(model.importances()) == pytest.approx(1.0)


def test_little_data(spark):
    one = table(spark, [(3, 1.0, None, 0.0)])
    assert fit_many(one, ["a", "b"], [Settings(maxIter=2)]).models[0].transform(one).first() \
        .prediction == 3.0
    none = fit_many(one.limit(0), ["a", "b"], [Settings(maxIter=2)]).models[0]
    assert none.transform(one).first().prediction == 0.0


def test_models_fitted_for_their_errors_alone_leave_their_trees_behind(noisy, monkeypatch):
    whole = fit_many(noisy, ["a", "b", "c"], SETTINGS[::-1], {0: SPANS[2]}, (2, 5))
    for most in (boosting.SMALL_TABLE, 100):
        monkeypatch.setattr(boosting, "SMALL_TABLE", most)
        got = fit_many(noisy, ["a", "b", "c"], SETTINGS[::-1], {0: SPANS[2]}, (2, 5), 1)
        assert got.errors == whole.errors and not got.models[0].trees
        assert [m.trees for m in got.models[1:]] == [m.trees for m in whole.models[1:]]
