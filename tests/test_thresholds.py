import math
import random

import pytest
from pyspark.sql import functions as F

from coursebeacon.operators.ranking import rates, score_histogram
from coursebeacon.operators.thresholds import Strategy, grid_index, grid_value, select_thresholds, threshold_sweep

GRID = [i * 0.01 for i in range(101)]


def naive(points, strategy, parameter):
    """The lowest grid point that is best, by testing every row at every point."""
    best, chosen = None, 0.5
    P = sum(y for _, y in points)
    for theta in GRID:
        tp = sum(1 for p, y in points if p >= theta and y)
        fp = sum(1 for p, y in points if p >= theta and not y)
        precision = tp / (tp + fp) if tp + fp else 0.0
        if strategy == "f1":
            value = 2 * tp / (P + tp + fp) if P + tp + fp else 0.0
        elif strategy == "cost":
            value = tp - parameter * fp
        else:
            if precision < parameter:
                continue
            value = tp / P if P else 0.0
        if best is None or value > best:
            best, chosen = value, theta
    return chosen


def test_grid_is_i_times_a_hundredth(spark):
    rows = spark.range(101).select(grid_value(F.col("id")).alias("t")).collect()
    assert [r["t"] for r in rows] == GRID and GRID[94] == 0.9400000000000001 and GRID[100] == 1.0


def test_grid_edges(spark):
    edges = [0.0, 0.35, 35 * 0.01, 0.94, 94 * 0.01, 0.999, 1.0, 1.7, -0.1] + GRID + [math.nextafter(g, -1) for g in GRID]
    df = spark.createDataFrame([(e,) for e in edges], "p double")
    for r in df.select("p", grid_index(F.col("p")).alias("i")).collect():
        assert r["i"] == max([i for i, g in enumerate(GRID) if g <= r["p"]], default=-1), r["p"]


@pytest.mark.parametrize("name,parameter", [("f1", None), ("precision_floor", 0.75), ("cost", 2.5), ("precision_floor", 2.0)])
def test_strategies_match_row_by_row_search(spark, name, parameter):
    rng = random.Random(3)
    groups = {
        "random": [(round(rng.random(), 3), int(rng.random() < 0.4)) for _ in range(150)],
        "useful": [(round(min(1, max(0, rng.gauss(0.3 + 0.3 * y, 0.2))), 2), y) for y in [0, 1] * 80],
        "constant": [(0.056, i % 2) for i in range(20)],
        "no_positive": [(round(rng.random(), 2), 0) for _ in range(20)],
    }
    rows = [(g, float(p), y) for g, pts in groups.items() for p, y in pts]
    h = score_histogram(spark.createDataFrame(rows, "g string, score double, label int"), ["g"])
    sweep = threshold_sweep(h, ["g"])
    got = {r["g"]: r for r in select_thresholds(sweep, ["g"], Strategy(name, parameter)).collect()}
    for g, points in groups.items():
        theta = naive(points, name, parameter)
        assert got[g]["theta"] == theta, (g, name)
        assert got[g]["tp"] == sum(1 for p, y in points if p >= theta and y)
        assert got[g]["fp"] == sum(1 for p, y in points if p >= theta and not y)


def test_published_rates(spark):
    # fixed values: TP, FP, positives -> precision, recall, F1 as published for the last week
    published = [(3077, 2872, 3077, 0.5172, 1.0, 0.6818), (789, 190, 3077, 0.8059, 0.2564, 0.3891),
                 (2682, 2288, 2872, 0.5396, 0.9338, 0.6840), (0, 0, 2872, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(published, "tp bigint, fp bigint, p bigint, a double, b double, c double")
    for r in df.select("*", *rates("tp", "fp", F.col("p"))).collect():
        assert [round(r[x], 4) for x in ("precision", "recall", "f1")] == [r["a"], r["b"], r["c"]]
