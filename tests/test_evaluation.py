import math
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from coursebeacon.operators.blending import apply_blend, best_weight, blend_search, common_predictions
from coursebeacon.operators.calibration import apply_isotonic, calibrate_weekly, calibration_points, fit_isotonic, fit_platt
from coursebeacon.operators.proxy import proxy_scores
from coursebeacon.operators.scaling import ClickScaler, every_prefix, mask_future, scaler_table
from coursebeacon.operators.splitting import split_sizes, with_exact_split, with_split
from coursebeacon.plans.evaluate import VARIANTS, evaluate_variants, weekly_metrics, weekly_scores, winners
from coursebeacon.schemas import week_columns

WEEKS = 4


def table(spark, n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.randint(0, 1)
        rows.append((f"u{i}", y, *[float(rng.randint(0, 20) + 6 * y) for _ in range(WEEKS - 1)], 5.0))
    columns = ", ".join(f"{c} double" for c in week_columns(WEEKS))
    return spark.createDataFrame(rows, f"student_uid string, label int, {columns}"), rows


def test_scaler_fit_store_and_constant_weeks(spark):
    df, rows = table(spark)
    stored = scaler_table(df, WEEKS)
    assert ClickScaler.of_table(stored, WEEKS) == ClickScaler.fit(df, WEEKS)
    scaled = ClickScaler.fit(df, WEEKS).transform(df)
    r = scaled.agg(F.min("w0_clicks"), F.max("w0_clicks"), F.max("w3_clicks")).first()
    assert tuple(r) == (0.0, 1.0, 0.0)
    zeros = df.withColumn("w0_clicks", F.lit(0.0))
    assert scaler_table(zeros, WEEKS).filter("week = 0").first()["max"] == 1.0
    assert ClickScaler.fit(df, WEEKS).table(spark).count() == WEEKS


def test_stored_scaler_is_checked_and_falls_back(spark):
    df, _ = table(spark, 6)
    stored = scaler_table(df, WEEKS)
    partial = ClickScaler.of_table(stored.filter("week <> 1"), WEEKS)
    assert partial.ranges[1] is None and partial.table(spark).count() == WEEKS - 1
    r = partial.transform(df).agg(F.min("w1_clicks"), F.max("w1_clicks")).first()
    assert tuple(r) == (0.0, 1.0)  # the column's own range
    for bad in (stored.union(stored.filter("week = 0")), stored.withColumn("week", F.col("week") - 1)):
        with pytest.raises(ValueError, match="one row for each week"):
            ClickScaler.of_table(bad, WEEKS)


def test_masking_comes_before_scaling(spark):
    df, _ = table(spark, 5)
    scaler = ClickScaler(((10.0, 20.0),) * WEEKS)
    masked = scaler.transform(mask_future(df, 1, WEEKS)).first()
    assert masked["w3_clicks"] == -1.0  # -min / (max - min), not 0
    every = every_prefix(df, WEEKS)
    assert every.count() == 5 * WEEKS
    assert every.filter("week = 0").agg(F.max("w1_clicks")).first()[0] == 0.0


def test_proxy_is_the_scaled_mean_of_seen_weeks(spark):
    df, rows = table(spark)
    got = {(r["student_uid"], r["week"]): r["score"] for r in proxy_scores(df, ["student_uid"], WEEKS).collect()}
    for t in range(WEEKS):
        means = {r[0]: sum(r[2:3 + t]) / (t + 1) for r in rows}
        lo, hi = min(means.values()), max(means.values())
        assert all(math.isclose(got[u, t], (m - lo) / (hi - lo), abs_tol=1e-12) for u, m in means.items())


def test_variants_agree_with_single_runs_and_hold_invariants(spark):
    df, _ = table(spark)
    log = {(r["variant"], r["week"]): r for r in evaluate_variants(weekly_scores(df, max_weeks=WEEKS)).collect()}
    assert len(log) == len(VARIANTS) * WEEKS
    for r in log.values():
        assert r["tp"] + r["fp"] == r["warn_count"]
        assert r["theta_t"] in [i * 0.01 for i in range(101)]
    for t in range(WEEKS):
        assert math.isclose(log["pass_f1", t]["auc_roc"], log["risk_f1", t]["auc_roc"], abs_tol=1e-12)
        assert math.isclose(log["pass_f1", t]["brier"], log["risk_cost", t]["brier"], abs_tol=1e-12)
    single = {r["week"]: r for r in weekly_metrics(df, max_weeks=WEEKS, mode="risk", threshold="cost", fp_cost=2.5).collect()}
    for t, r in single.items():
        assert all(r[c] == log["risk_cost", t][c] for c in ("theta_t", "tp", "fp", "f1"))
        assert math.isclose(r["auc_pr"], log["risk_cost", t]["auc_pr"], abs_tol=1e-12)  # order of a sum
    assert winners(evaluate_variants(weekly_scores(df, max_weeks=WEEKS))).count() == 4


def test_unknown_labels(spark):
    df, _ = table(spark)
    real = df.select("student_uid", "label").filter("student_uid <> 'u0'")
    zero = weekly_metrics(df, real, max_weeks=WEEKS).filter("week = 0").first()
    dropped = weekly_metrics(df, real, max_weeks=WEEKS, unknown_label="drop").filter("week = 0").first()
    assert zero["brier"] != dropped["brier"]


def test_platt_is_the_penalised_logistic_fit(spark):
    rng = random.Random(0)
    rows = [(rng.random(), float(rng.random() < 0.5), float(rng.randint(1, 3))) for _ in range(200)]
    points = [(0, p, int(w * t), int(w * (1 - t))) for p, t, w in rows]
    points += [(1, 0.1, 0, 5), (1, 0.9, 5, 0), (2, 0.3, 4, 0)]  # a week that can be told apart, one of one class only
    fits = fit_platt(spark.createDataFrame(points, "week int, p double, pos long, neg long"))
    assert set(fits) == {0, 1} and fits[1][0] > 0
    a, b = fits[0]
    x = y = 0.0  # Newton's method on the same objective
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for p, t, w in rows:
            q = 1 / (1 + math.exp(-(x * p + y)))
            g0 += w * (q - t) * p
            g1 += w * (q - t)
            v = w * q * (1 - q)
            h00, h01, h11 = h00 + v * p * p, h01 + v * p, h11 + v
        g0, h00 = g0 + x, h00 + 1.0
        det = h00 * h11 - h01 * h01
        x, y = x - (h11 * g0 - h01 * g1) / det, y - (h00 * g1 - h01 * g0) / det
    assert math.isclose(a, x, abs_tol=1e-9) and math.isclose(b, y, abs_tol=1e-9)


def pool(points):
    """Neighbouring levels that fall are pooled until none does: [first p, last p, value]."""
    levels = []
    for p, pos, neg in sorted(points):
        levels.append([p, p, pos, pos + neg])
        while len(levels) > 1 and levels[-2][2] * levels[-1][3] >= levels[-1][2] * levels[-2][3]:
            _, last, s, n = levels.pop()
            levels[-1][1:] = [last, levels[-1][2] + s, levels[-1][3] + n]
    return [(a, b, s / n) for a, b, s, n in levels]


def test_isotonic_is_the_pooled_fit(spark):
    rng = random.Random(4)
    points = {w: [(rng.random() ** (w + 1) * (1 if w else 1e-3), rng.randint(0, 3), rng.randint(1, 3)) for _ in range(150)] for w in range(4)}
    points[3] = [(0.5, 2, 1)]
    rows = [(w, *x) for w, xs in points.items() for x in xs]
    table = spark.createDataFrame(rows, "week int, p double, pos long, neg long").repartition(7)
    knots = fit_isotonic(table)
    found = {}
    for r in knots.collect():
        found.setdefault(r["week"], []).append((r["p"], r["fitted"]))
    asked = [(w, rng.random() * 1.2 - 0.1) for w in range(4) for _ in range(60)] + [r[:2] for r in rows]
    got = {(r["week"], r["p"]): r["fitted"] for r in apply_isotonic(spark.createDataFrame(asked, "week int, p double"), knots).collect()}
    for w, xs in points.items():
        levels = pool(xs)
        expected = sorted({(p, v) for a, b, v in levels for p in (a, b)})
        assert [x for knot in sorted(found[w]) for x in knot] == pytest.approx([x for knot in expected for x in knot])
        for p in (p for week, p in asked if week == w):
            low, high = [k for k in expected if k[0] <= p], [k for k in expected if k[0] >= p]
            if not low or not high:
                want = (low or high)[-1 if low else 0][1]
            else:
                (x0, y0), (x1, y1) = low[-1], high[0]
                want = y0 if x1 == x0 else y0 + (p - x0) / (x1 - x0) * (y1 - y0)
            assert got[w, p] == pytest.approx(want)


def test_isotonic_runs_through_ranges(spark):
    """Python is called by partition, in batches that add to one hull, not once per week and step of the score."""
    rng = random.Random(5)
    points = [(rng.random(), rng.randint(0, 3), rng.randint(1, 3)) for _ in range(500)]
    table = spark.createDataFrame([(0, *x) for x in points], "week int, p double, pos long, neg long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        knots = fit_isotonic(table)
        found = sorted((r["p"], r["fitted"]) for r in knots.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = sorted({(p, v) for a, b, v in pool(points) for p in (a, b)})
    assert [x for knot in found for x in knot] == pytest.approx([x for knot in expected for x in knot])
    assert knots._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1


def test_exact_split_orders_the_edge_only(spark):
    """The same rows as ordering whole labels by hash and key; nulls stay out, repeated keys count each."""
    rows = [(f"u{i % 900}", int(i % 3 == 0), i % 2) for i in range(1500)] + [(None, 1, 0), ("x", None, 0)]
    df = spark.createDataFrame(rows, "student_uid string, label int, week int")
    got = with_exact_split(df, 0.3, "s", label=["week", "label"])
    assert got.columns == ["week", "label", "student_uid", "split"]
    plan = with_exact_split(df, 0.3, "s", label=["week", "label"], written=True)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "row_number" in line and "Window" in line)
    below = plan.splitlines()[plan.splitlines().index(window):]
    assert any("_range" in line and "= _last" in line for line in below)
    for week in range(2):
        for label in range(2):
            mine = [u for u, y, w in rows if u is not None and y == label and w == week]
            order = sorted(mine, key=lambda u: (int(hashlib.md5(f"{u}|s".encode()).hexdigest()[:8], 16), u))
            test = [r["student_uid"] for r in got.filter(f"week = {week} AND label = {label} AND split = 'test'").collect()]
            assert len(test) == round(0.3 * len(mine)) and set(test) == set(order[: len(test)])
    assert got.count() == 1500


def test_calibration_share_is_exact(spark):
    rows = [(f"u{i}", None if i % 10 == 0 else int(i % 3 == 0), w, i / 100) for w in range(2) for i in range(100)]
    points = calibration_points(spark.createDataFrame(rows, "student_uid string, label int, week int, score double"))
    sums = {r["week"]: (r["a"], r["b"]) for r in points.groupBy("week").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).collect()}
    assert sums == {0: (9, 21), 1: (9, 21)}


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_calibration_keeps_order_and_skips_thin_weeks(spark, method):
    rng = random.Random(9)
    rows = [(f"u{i}", int(rng.random() < i / 300), 0, i / 300) for i in range(300)]
    rows += [(f"u{i}", 0, 1, 0.4) for i in range(20)]  # one class only: stays as it is
    rows += [(f"v{i}", int(i < 4), 2, 0.4 + i / 100) for i in range(20)]  # too few of one class
    scored = spark.createDataFrame(rows, "student_uid string, label int, week int, score double")
    out = calibrate_weekly(scored, method)
    assert out.columns == scored.columns
    got = {(r["student_uid"], r["week"]): r["score"] for r in out.collect()}
    assert [got[f"v{i}", 2] for i in range(20)] == [0.4 + i / 100 for i in range(20)]
    assert len(got) == 340 and {got[f"u{i}", 1] for i in range(20)} == {0.4}
    week0 = [got[f"u{i}", 0] for i in range(300)]
    assert all(b >= a - 1e-12 for a, b in zip(week0, week0[1:])) and 0 <= week0[0] and week0[-1] <= 1
    with pytest.raises(ValueError):
        calibrate_weekly(scored, "beta")


def test_split_is_disjoint_complete_and_exact_when_asked(spark):
    df = spark.range(1000).selectExpr("concat('u', id) as student_uid", "int(id % 4 = 0) as label")
    sizes = {r["split"]: r["n_rows"] for r in split_sizes(with_split(df)).collect()}
    assert sum(sizes.values()) == 1000 and 150 < sizes["test"] < 250
    exact = with_exact_split(df)
    counts = {(r["label"], r["split"]): r["count"] for r in exact.groupBy("label", "split").count().collect()}
    assert counts == {(0, "test"): 150, (0, "train"): 600, (1, "test"): 50, (1, "train"): 200}


def test_blend_search_and_apply(spark):
    rng = random.Random(6)
    ids = [(f"u{i}", int(rng.random() < 0.5)) for i in range(80)]
    real = spark.createDataFrame(ids, "student_uid string, label int")
    schema = "student_uid string, predicted_label int, prob_pass double"
    good = spark.createDataFrame([(u, y, 0.5 + (y - 0.5) * 0.8 * rng.random()) for u, y in ids], schema)
    noise = spark.createDataFrame([(u, 0, rng.random()) for u, _ in ids[:-1]] + [(ids[-1][0], 0, None)], schema)
    common = common_predictions(real, good, noise)
    assert common.count() == 79
    search = blend_search(common)
    best = best_weight(search).first()
    assert best["weight"] == 0.8 and best["auc_roc"] > 0.9
    applied = apply_blend(good, noise, best_weight(search)).collect()
    assert len(applied) == 80 and set(applied[0].asDict()) == {"student_uid", "predicted_label", "prob_pass"}
    same = blend_search(common.withColumn("p_b", F.col("p_a")))
    assert best_weight(same).first()["weight"] == 0.2  # earliest weight wins a tie
