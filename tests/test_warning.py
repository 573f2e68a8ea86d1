import math

from pyspark.sql import functions as F

from coursebeacon.operators import metric_log, overview, whatif
from coursebeacon.operators.enrolments import attach_labels, attach_predictions, ensure_label
from coursebeacon.operators.scenario import SCENARIOS, apply_scenario, scenario_named
from coursebeacon.operators.warning import ADVICE, advice, explain_at_risk, mark_at_risk, ranked_at_risk, warning_kpis
from coursebeacon.plans.early_warning import early_warning
from coursebeacon.schemas import METRICS

SCHEMA = ("student_uid string, total_clicks bigint, n_submitted bigint, mean_score double, completion double, "
          "active_weeks bigint, label int")


def learners(spark):
    return spark.createDataFrame([
        ("good", 20000, 10, 90.0, 1.0, 20, 1), ("weak", 100, 1, 30.0, 0.0, 2, 0),
        ("mid", 8000, 8, 75.0, 0.8, 15, 1), ("blank", 15000, 9, 80.0, None, 18, 1),
    ], SCHEMA)


def test_missing_prediction_never_marks_but_low_index_does(spark):
    p = spark.createDataFrame([("good", 0, 0.02), ("mid", 1, 0.9)], "student_uid string, predicted_label int, prob_pass double")
    joined = attach_predictions(learners(spark), p)
    marked = {r["student_uid"]: r for r in mark_at_risk(joined).collect()}
    assert marked["weak"]["prob_risk"] == 0.5 and marked["weak"]["at_risk"]
    assert marked["good"]["at_risk"] and not marked["mid"]["at_risk"]
    none = attach_predictions(learners(spark), None)
    assert {r["student_uid"]: r["at_risk"] for r in mark_at_risk(none).collect()} == {
        "good": False, "weak": True, "mid": False, "blank": False}


def test_list_puts_riskiest_first_and_unknown_last(spark):
    df = learners(spark).withColumn("prob_risk", F.when(F.col("student_uid") == "good", 0.99)
                                    .when(F.col("student_uid") == "mid", 0.95))
    ranked = [r["student_uid"] for r in ranked_at_risk(mark_at_risk(df)).collect()]
    assert ranked == ["good", "mid", "weak"]
    assert [r["student_uid"] for r in ranked_at_risk(mark_at_risk(df), 1).collect()] == ["good"]


def test_kpis_and_empty_table(spark):
    r = warning_kpis(mark_at_risk(learners(spark))).first()
    assert r["at_risk_pct"] == 25.0 and r["predicted_pass_pct"] == 75.0
    empty = warning_kpis(mark_at_risk(learners(spark).filter("false"))).first()
    assert tuple(empty) == (None, None, None)


def test_explanation_and_advice(spark):
    marked = mark_at_risk(learners(spark))
    rows = {r["factor"]: r for r in explain_at_risk(marked).collect()}
    assert set(rows) == set(METRICS) and {r["student_uid"] for r in rows.values()} == {"weak"}
    mean = (20000 + 100 + 8000 + 15000) / 4
    assert math.isclose(rows["total_clicks"]["impact"], (100 - mean) / mean * 100 * 0.15)
    a = advice(marked).first()
    assert a["factor"] == "completion" and a["advice"] == ADVICE["completion"]


def test_zero_class_mean_leaves_the_factor_out(spark):
    marked = mark_at_risk(learners(spark).withColumn("completion", F.lit(0.0)))
    row = [r for r in explain_at_risk(marked).collect() if r["factor"] == "completion"][0]
    assert row["deviation_pct"] is None and row["impact"] is None
    # clicks -99.1 % * 0.15, submissions -85.7 % * 0.2, score -56.4 % * 0.3
    assert advice(marked).first()["factor"] == "n_submitted"


def test_report_reads_the_latest_threshold(spark):
    log = spark.createDataFrame([(18, 1, 0.2), (19, 1, 0.9), (19, 2, 0.4)], "week int, timestamp int, theta_t double")
    p = spark.createDataFrame([("mid", 1, 0.55)], "student_uid string, predicted_label int, prob_pass double")
    report = early_warning(learners(spark), p, log)
    flagged = {r["student_uid"] for r in report.ranked.collect()}
    assert flagged == {"good", "weak", "mid", "blank"}  # 0.45 and the neutral 0.5 both reach 0.4
    assert {r["student_uid"] for r in early_warning(learners(spark), p).ranked.collect()} == {"weak"}
    assert spark.range(1).select(metric_log.latest_threshold(log.filter("false"))).first()[0] == 0.94


def test_labels(spark):
    test = spark.createDataFrame([("a",), ("b",)], "student_uid string")
    real = spark.createDataFrame([("a", 1)], "student_uid string, label int")
    assert {r["student_uid"]: r["label"] for r in attach_labels(test, real).collect()} == {"a": 1, "b": 0}
    assert attach_labels(test, real, "drop").count() == 1
    assert ensure_label(test).first()["label"] == 0 and ensure_label(test, real).columns[-1] == "label"


def test_baseline_scenario_still_clips_its_cohort(spark):
    df = spark.createDataFrame([("u", 500, 12, 50.0, 0.5, 37, 1)], SCHEMA)
    everyone = apply_scenario(df, "baseline", fraction=1.0).first()
    assert (everyone["n_submitted"], everyone["active_weeks"], everyone["total_clicks"]) == (10, 20, 500)
    nobody = apply_scenario(df, "baseline", fraction=0.0).first()
    assert (nobody["n_submitted"], nobody["active_weeks"]) == (12, 37)


def test_scenario_changes_and_bounds(spark):
    df = spark.createDataFrame([("u", 100, 1, 2.0, 0.1, 1, 1)], SCHEMA).withColumn("w0_clicks", F.lit(0.9))
    r = apply_scenario(df, "late_dropout", fraction=1.0).first()
    assert (r["total_clicks"], r["n_submitted"], r["mean_score"], r["completion"], r["active_weeks"]) == (50, 0, 0, 0, 0)
    r = apply_scenario(df, "exam_season", fraction=1.0, noise=0.03).first()
    assert r["w0_clicks"] == 1.0 and math.isclose(r["completion"], 0.15)
    assert len(SCENARIOS) == 5 and scenario_named("holiday").fraction == 0.15


def test_presets_and_learner_simulation(spark):
    requests = whatif.preset_requests(learners(spark).filter("student_uid = 'weak'"))
    rows = {r["preset"]: r for r in requests.collect()}
    drop = rows["drop_risk"]
    assert [drop[f"in_{m}"] for m in METRICS] == [50, 0, 25, 0, 0]
    exam = rows["exam_season"]
    assert [exam[f"in_{m}"] for m in METRICS] == [125, 2, 33, 5, 3]
    result = whatif.simulate_learner(requests, risk_threshold=0.06).collect()
    assert all(r["alert"] and math.isclose(r["prob_pass"] + r["prob_risk"], 1.0) for r in result)
    delta = {r["metric"]: r for r in whatif.twin_delta(requests.filter("preset = 'exam_season'"), ["preset"]).collect()}
    assert math.isclose(delta["completion"]["delta_pct"], 5.0) and math.isclose(delta["n_submitted"]["delta_pct"], 10.0)


def test_class_view(spark):
    df = learners(spark)
    r = overview.class_kpis(df).first()
    assert (r["n_learners"], r["pass_rate"], r["mean_score"]) == (4, 75.0, 68.75)
    gap = overview.simulated_pass_rate(df, 10, 20).first()
    assert (gap["simulated_pass_rate"], gap["twin_gap"]) == (90.0, 15.0)
    sim = whatif.class_whatif(df, whatif.Sliders(total_clicks=-50))
    averages = {x["metric"]: x for x in overview.class_averages(sim).collect()}
    assert averages["total_clicks"]["simulated_mean"] == averages["total_clicks"]["real_mean"] / 2
    bins = overview.histogram(df, "total_clicks", "label").collect()
    assert sum(b["n"] for b in bins) == 4 and max(b["bin"] for b in bins) == 29
    same = overview.histogram(df.withColumn("x", F.lit(3.0)), "x", "label").collect()
    assert {b["bin"] for b in same} == {0}
    weights = {x["label"]: x["weight"] for x in overview.class_weights(df).collect()}
    assert weights == {0: 2.0, 1: 4 / 6}
    assert {round(x["class_weight"], 6) for x in overview.with_class_weight(df).collect()} == {2.0, round(4 / 6, 6)}
    assert overview.snapshot_means(df.drop("completion")).first()["mean_completion"] == 0.0
    table = overview.confusion_table(df.withColumn("predicted_label", F.lit(1))).collect()
    assert {(x["label"], x["predicted_fail"], x["predicted_pass"]) for x in table} == {(0, 0, 1), (1, 0, 3)}


def test_log_queries(spark):
    log = spark.createDataFrame(
        [("a", 0, 1, 0.5, 3, 1), ("a", 0, 2, 0.6, 1, 4), ("a", 19, 3, 0.9, 5, 5)],
        "run string, week int, timestamp int, f1 double, tp int, fp int")
    last = {r["week"]: r["f1"] for r in metric_log.latest_per(log, ["week"], "timestamp").collect()}
    assert last == {0: 0.6, 19: 0.9}
    assert metric_log.latest_row(log, ["week", "timestamp"]).first()["f1"] == 0.9
    assert {tuple(r) for r in metric_log.max_hits_per_week(log).collect()} == {(0, 3, 4), (19, 5, 5)}
    stages = {r["stage"]: r["f1"] for r in metric_log.stage_means(log, ["run"], ["f1"]).collect()}
    assert stages["late"] == 0.9 and math.isclose(stages["early"], 0.55) and math.isclose(stages["all"], 2 / 3)
    dirty = log.withColumn("week", F.when(F.col("timestamp") == 2, "?").otherwise(F.col("week").cast("string")))
    assert sorted(r["week"] for r in metric_log.with_week(dirty).collect()) == [0, 1, 2]
    assert sorted(r["week"] for r in metric_log.with_week(log).collect()) == [0, 0, 19]
    series = metric_log.log_series(log, "week", ["f1", "tp", "absent"])
    assert {r["series"] for r in series.collect()} == {"f1", "tp"}
    runs = metric_log.union_runs({"x": log.drop("run"), "y": None})
    assert {r["run"] for r in runs.collect()} == {"x"}
    tie = spark.createDataFrame([("p", 0, 0.7, 0.5, 0.5, 9), ("q", 1, 0.7, 0.6, 0.5, 9)],
                                "variant string, ordinal int, auc_pr double, precision double, f1 double, fp int")
    best = {r["criterion"]: r["variant"] for r in metric_log.best_variants(tie).collect()}
    assert best == {"highest_auc_pr": "p", "highest_precision": "q", "highest_f1": "p", "fewest_fp": "p"}
