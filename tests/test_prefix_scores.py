"""Scores of all prefixes from one row, against the same model on masked copies."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from coursebeacon.operators.scaling import every_prefix
from coursebeacon.plans import prefix_scores, train
from coursebeacon.plans.evaluate import weekly_metrics, weekly_scores
from coursebeacon.schemas import METRICS, week_columns


@pytest.fixture(scope="module")
def learners(spark):
    rng = random.Random(2)
    rows = []
    for i in range(240):
        weeks = [None if rng.random() < 0.02 else round(rng.random() * (1 + (i % 2) * (k / 10)), 3) for k in range(20)]
        rows.append((f"u{i}", i % 2, *weeks, *[round(rng.random() * 10, 2) for _ in METRICS]))
    columns = ["student_uid string", "label int", *[f"{c} double" for c in week_columns()], *[f"{m} double" for m in METRICS]]
    return spark.createDataFrame(rows, ", ".join(columns)).cache()


def check(learners, score):
    assert score.weekly_model is not None
    rows = every_prefix(learners)
    want = {(r.student_uid, r.week): r.prob_pass for r in score(rows).select("student_uid", "week", "prob_pass").collect()}
    found = weekly_scores(learners, model=score)
    got = {(r.student_uid, r.week): r.score for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 240 * 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len({round(v, 6) for v in got.values()}) > 20
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()


def test_network(learners):
    check(learners, train.train_sequence(learners, maxIter=8)[1])


def test_boosted_trees(learners):
    check(learners, train.train_boosting(learners, maxIter=6)[1])


def test_linear_model_and_others(learners):
    baselines = train.train_baselines(learners)
    check(learners, baselines["logistic_regression"])
    forest = weekly_metrics(learners, model=baselines["random_forest"])  # not known: masked copies
    assert forest.count() == 20
    with pytest.raises(ValueError):
        prefix_scores.prefix_scores(learners, baselines["random_forest"].weekly_model, ["student_uid"])
    with pytest.raises(ValueError):
        prefix_scores.prefix_scores(learners.drop(*METRICS), baselines["logistic_regression"].weekly_model, ["student_uid"])
    empty = prefix_scores.prefix_scores(learners.filter(F.lit(False)), baselines["logistic_regression"].weekly_model, ["student_uid"])
    assert empty.count() == 0


def test_numbers_of_trees_share_a_fit(learners, monkeypatch):
    estimator = GBTClassifier(labelCol="label", weightCol="class_weight", seed=42)
    grid = (ParamGridBuilder().addGrid(estimator.maxIter, [2, 5]).addGrid(estimator.subsamplingRate, [0.7, 1.0])
            .addGrid(estimator.maxDepth, [2]).build())
    fits, fit_one = [], GBTClassifier.fit

    def counted(self, data, parameters=None):
        fits.append(parameters)
        return fit_one(self, data, parameters)

    monkeypatch.setattr(GBTClassifier, "fit", counted)
    together = train.tune(learners, estimator, grid)
    n_together = len(fits)
    monkeypatch.setattr(train, "_same_path", lambda _, grid: [[i] for i in range(len(grid))])
    alone = train.tune(learners, estimator, grid)
    assert together.scores == pytest.approx(alone.scores, abs=1e-9)
    assert n_together <= 3 and together.bestModel.getNumTrees == alone.bestModel.getNumTrees


def test_the_default_grid_takes_eight_fits():
    estimator = GBTClassifier(labelCol="label")
    assert [len(places) for places in train._same_path(estimator, train.boosting_grid(estimator))] == [3] * 8
    linear = LogisticRegression()
    grid = ParamGridBuilder().addGrid(linear.maxIter, [1, 2]).build()
    assert train._same_path(linear, grid) == [[0], [1]]
