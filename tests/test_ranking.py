import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursebeacon.operators import ranking
from coursebeacon.operators.ordered import exact_quantiles, running_totals

TIES = [(0.9, 1), (0.8, 0), (0.8, 1), (0.4, 1), (0.3, 0), (0.2, 0), (0.2, 1)]


def brute(points):
    """Average precision, ROC area and Brier straight from their definitions."""
    P = sum(y for _, y in points)
    N = len(points) - P
    ap = last = 0.0
    for cut in sorted({p for p, _ in points}, reverse=True):
        tp = sum(y for p, y in points if p >= cut)
        ap += (tp / P - last) * tp / sum(1 for p, _ in points if p >= cut) if P else 0
        last = tp / P if P else 0
    wins = sum((a > b) + 0.5 * (a == b) for a, y in points if y for b, z in points if not z)
    return ap, wins / (P * N) if P * N else None, sum((p - y) ** 2 for p, y in points) / len(points)


def measure(spark, groups):
    rows = [(g, float(p), y) for g, points in groups.items() for p, y in points]
    scored = spark.createDataFrame(rows, "g string, score double, label int")
    h = ranking.score_histogram(scored, ["g"])
    joined = ranking.ranking_metrics(h, ["g"]).join(ranking.score_totals(h, ["g"]), "g")
    return {r["g"]: r for r in joined.collect()}, h


def test_ties_one_class_and_random_groups(spark):
    rng = random.Random(5)
    groups = {
        "ties": TIES,
        "one_class": [(p, 0) for p, _ in TIES],
        "hot": [(0.25, i % 3 == 0) for i in range(60)] + [(rng.random(), rng.random() < 0.5) for _ in range(40)],
        "random": [(round(rng.random(), 2), rng.random() < 0.3) for _ in range(200)],
    }
    groups = {g: [(p, int(y)) for p, y in pts] for g, pts in groups.items()}
    got, h = measure(spark, groups)
    assert math.isclose(got["ties"]["auc_pr"], 0.747024, abs_tol=1e-6)
    assert math.isclose(got["ties"]["auc_roc"], 2 / 3, abs_tol=1e-6)
    for g, points in groups.items():
        ap, roc, brier = brute(points)
        assert math.isclose(got[g]["auc_pr"], ap, abs_tol=1e-12), g
        assert math.isclose(got[g]["brier"], brier, abs_tol=1e-9), g
        assert got[g]["auc_roc"] is None if roc is None else math.isclose(got[g]["auc_roc"], roc, abs_tol=1e-12)
    # turning score and label around keeps ROC area and Brier score
    turned = ranking.by_mode(h, ["pass", "risk"])
    areas = {(r["g"], r["mode"]): r for r in ranking.ranking_metrics(turned, ["g", "mode"]).collect()}
    totals = {(r["g"], r["mode"]): r for r in ranking.score_totals(turned, ["g", "mode"]).collect()}
    for g in ("ties", "hot", "random"):
        assert math.isclose(areas[g, "pass"]["auc_roc"], areas[g, "risk"]["auc_roc"], abs_tol=1e-12)
        assert math.isclose(totals[g, "pass"]["brier"], totals[g, "risk"]["brier"], abs_tol=1e-12)
        risk = brute([(1 - p, 1 - y) for p, y in groups[g]])
        assert math.isclose(areas[g, "risk"]["auc_pr"], risk[0], abs_tol=1e-12)


def test_brier_is_null_outside_the_unit_interval(spark):
    got, _ = measure(spark, {"x": [(1.5, 1), (0.5, 0)]})
    assert got["x"]["brier"] is None


def test_missing_values_do_not_vanish(spark):
    schema = "g string, score double, label int"
    row = ranking.score_histogram(spark.createDataFrame([("a", 0.5, None), ("a", 0.5, 1)], schema), ["g"]).first()
    assert (row["pos"], row["neg"]) == (1, 1)
    for bad in ((None, 1), (0.5, 2), (float("nan"), 0)):
        with pytest.raises(Exception, match="neither 0 nor 1"):
            ranking.score_histogram(spark.createDataFrame([("a", *bad)], schema), ["g"]).collect()


def test_rounding_is_optional(spark):
    rows = spark.createDataFrame([("a", 0.12345, 1), ("a", 0.12349, 0)], "g string, score double, label int")
    assert ranking.score_histogram(rows, ["g"]).count() == 2
    assert ranking.score_histogram(rows, ["g"], digits=3).first()["p"] == 0.123


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_across_buckets(spark, descending):
    rng = random.Random(1)
    keys = rng.sample(range(-500, 5000), 300)
    rows = [("g", k, rng.randint(0, 9)) for k in keys]
    df = spark.createDataFrame(rows, "g string, k bigint, n bigint")
    got = {r["k"]: r["cum_n"] for r in running_totals(df, ["g"], "k", ["n"], F.floor(F.col("k") / 100), descending).collect()}
    total = 0
    for _, k, n in sorted(rows, key=lambda r: r[1], reverse=descending):
        total += n
        assert got[k] == total


def test_quantiles_match_linear_interpolation(spark):
    rng = random.Random(2)
    values = {"a": [rng.uniform(-5, 90) for _ in range(101)], "b": [1.0, 2.0], "c": [7.5], "d": [-1e300, 1e13, 1e13 + 2]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    for r in exact_quantiles(df, "v", ["g"], probs).collect():
        want = np.quantile(values[r["g"]], probs)
        assert np.allclose([r["q0"], r["q25"], r["q50"], r["q75"], r["q100"]], want, rtol=1e-9)


def test_confusion_and_reliability(spark):
    df = spark.createDataFrame([("g", p, y) for p, y in TIES], "g string, score double, label int")
    r = ranking.confusion_counts(df, ["g"], cut=0.4).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 1, 1, 2)
    assert math.isclose(r["f1"], 0.75) and math.isclose(r["accuracy"], 5 / 7)
    curve = {x["bin"]: x for x in ranking.reliability_curve(ranking.score_histogram(df, ["g"]), ["g"]).collect()}
    assert curve[8]["n"] == 2 and curve[8]["observed_rate"] == 0.5 and math.isclose(curve[8]["mean_score"], 0.8)


def test_guard_needs_five_of_each_class(spark):
    rows = [("ok", 0.1, i % 2) for i in range(10)] + [("few", 0.1, int(i < 4)) for i in range(10)]
    h = ranking.score_histogram(spark.createDataFrame(rows, "g string, score double, label int"), ["g"])
    got = {r["g"]: r["calibratable"] for r in ranking.enough_of_both(h, ["g"]).collect()}
    assert got == {"ok": True, "few": False}
