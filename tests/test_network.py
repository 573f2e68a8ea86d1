"""The network fitted by numpy tasks, against Spark's own fit."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from coursebeacon.plans import network, train
from coursebeacon.schemas import week_columns

LAYERS = [3, 5, 4, 2]
SCHEMA = StructType([StructField("features", VectorUDT()), StructField("label", IntegerType())])


def table(spark, n=600, label=lambda x: int(x[0] + x[1] * x[2] > 0.8)):
    rng = random.Random(4)
    rows = [[rng.random() for _ in range(3)] for _ in range(n)]
    return spark.createDataFrame([(Vectors.dense(x), label(x)) for x in rows], SCHEMA).repartition(3)


def cross_entropy(model, rows):
    p = [(r.probability[r.label]) for r in model.transform(rows).select("probability", "label").collect()]
    return -np.log(p).mean()


def estimator(**more):
    return MultilayerPerceptronClassifier(labelCol="label", **{"layers": LAYERS, "maxIter": 40, "seed": 7, **more})


def test_loss_and_gradient_are_those_of_the_network(spark):
    rows = table(spark)
    start = network._with_weights(spark, estimator())
    blocks = network._blocks(rows, estimator(), 3)
    assert blocks.map(len).sum() == 600
    evaluate = network._loss(blocks, 600, LAYERS)
    loss, gradient = evaluate(start.weights.toArray())
    assert loss == pytest.approx(cross_entropy(start, rows), rel=1e-5)
    weights, rng = start.weights.toArray(), np.random.default_rng(1)
    for _ in range(3):
        way = rng.normal(size=len(weights))
        up, down = evaluate(weights + 1e-2 * way)[0], evaluate(weights - 1e-2 * way)[0]
        assert gradient @ way == pytest.approx((up - down) / 2e-2, rel=0.02, abs=1e-3)


def test_fit_is_as_good_as_the_librarys(spark):
    rows = table(spark).cache()
    own, library = network.fit_network(rows, estimator()), estimator().fit(rows)
    assert network._with_weights(spark, estimator()).weights == estimator(maxIter=0).fit(rows).weights
    assert cross_entropy(own, rows) < 1.1 * cross_entropy(library, rows) + 0.02
    assert own.getMaxIter() == 40 and not own.hasSummary and not own.isDefined(own.initialWeights)
    again = network.fit_network(rows, estimator(initialWeights=own.weights, maxIter=0))
    assert np.allclose(again.weights.toArray(), own.weights.toArray())


def test_fit_of_the_weekly_sequence_passes_rows_in_numpy(spark, monkeypatch):
    weeks = [round(0.05 * k, 2) for k in range(20)]
    rows = spark.createDataFrame([(f"u{i}", i % 2, *[w * (i % 2) for w in weeks]) for i in range(40)],
                                 ["student_uid", "label", *week_columns()])
    passes = []
    loss = network._loss

    def counted(blocks, n, layers):
        evaluate = loss(blocks, n, layers)
        return lambda flat: passes.append(n) or evaluate(flat)

    monkeypatch.setattr(network, "_loss", counted)
    model, score = train.train_sequence(rows, maxIter=10)
    assert len(passes) > 5 and set(passes) == {40}  # all rows in each
    assert list(model.getLayers()) == [20, 64, 32, 2] and score(rows).filter("prob_pass is null").count() == 0


@pytest.mark.parametrize("label", [2, -1, None])
def test_labels_that_are_no_class(spark, label):
    rows = table(spark, 30, lambda x: label if x[0] > 0.5 else 1)
    with pytest.raises(ValueError, match="labels"):
        network.fit_network(rows, estimator())


def test_features_that_are_no_numbers(spark):
    rows = table(spark, 20).union(spark.createDataFrame([(Vectors.dense([float("nan"), 0, 0]), 1)], SCHEMA))
    with pytest.raises(ValueError, match="not a number"):
        network.fit_network(rows, estimator())


def test_other_solvers_are_the_librarys(spark):
    rows = table(spark, 60)
    found = network.fit_network(rows, estimator(solver="gd", maxIter=2))
    assert found.hasSummary and found.transform(rows).filter(F.col("prediction").isNull()).count() == 0


def test_steps_follow_a_bent_valley():
    def valley(x):
        a, b = x[0] - 1.0, x[1] - x[0] ** 2
        return a * a + 100 * b * b, np.array([2 * a - 400 * x[0] * b, 200 * b])

    assert np.allclose(network.minimise(valley, np.array([-1.2, 1.0]), 100, 1e-12), [1.0, 1.0], atol=1e-4)
    seen = []
    network.minimise(lambda x: seen.append(1) or valley(x), np.array([-1.2, 1.0]), 0, 1e-12)
    assert len(seen) == 1
