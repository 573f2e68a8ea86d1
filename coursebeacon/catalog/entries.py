"""The registered queries: name -> (spark, folder) -> DataFrame.

Doubles are rounded after the last operation, because the two engines add in different orders.
"""

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.catalog.presets import CLASS_SLIDERS, CORRELATION, FLOOR, LOG_FP_COST
from coursebeacon.functions.learning_index import fallback_probability, learning_index
from coursebeacon.functions.scalars import label_at
from coursebeacon.operators import activity, assessments, blending, calibration, enrolments, metric_log, overview
from coursebeacon.operators import ranking, scaling, scenario, splitting, thresholds, warning, whatif
from coursebeacon.operators.features import Inputs, feature_table, model_dataset
from coursebeacon.plans import evaluate, incremental, rebuild, train
from coursebeacon.plans.early_warning import early_warning
from coursebeacon.plans.prepare import Prepared, prepare
from coursebeacon.schemas import METRICS, PREDICTIONS, STATUS, WHATIF_HISTORY, week_columns
from coursebeacon.session import staged, staged_path, work_path
from coursebeacon.sources import readers, relational, sinks
from coursebeacon.sources.memo import MemoisedScan
from coursebeacon.streaming import activity as stream_activity
from coursebeacon.streaming import batch_store, event_windows, learner_state, runner, running_alerts, twin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    chosen = [c for c in doubles if only is None or c in only]
    return df.withColumns({c: F.round(c, digits) for c in chosen})


def row_rounded(df: DataFrame) -> DataFrame:
    """Values of single rows, computed alike in both engines; a coarse rounding would meet ties."""
    return rounded(df, 9)


def _features(spark: SparkSession, folder: str, join_keys: str = "student", given: Inputs | None = None) -> DataFrame:
    return feature_table(given or relational.inputs(spark, folder), join_keys)


def _prepared(spark: SparkSession, folder: str, given: Inputs | None = None) -> Prepared:
    return prepare(given or relational.inputs(spark, folder))


def _learners(spark: SparkSession, folder: str, given: Inputs | None = None) -> DataFrame:
    """Features with the index and a closed-form pass probability in place of a trained model."""
    return _features(spark, folder, given=given).withColumns(
        {"learning_index": learning_index(), "prob_pass": fallback_probability()}
    )


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    learners = _learners(spark, folder).withColumn("prob_risk", F.lit(1.0) - F.col("prob_pass"))
    return warning.mark_at_risk(learners, index_column="learning_index")


def _predictions(learners: DataFrame) -> DataFrame:
    return learners.select("student_uid", label_at("prob_pass").alias("predicted_label"), "prob_pass")


def _second_predictions(learners: DataFrame) -> DataFrame:
    clicks = F.col("total_clicks").cast("double")
    p = clicks / (clicks + F.lit(2000.0))
    return learners.select("student_uid", label_at(p).alias("predicted_label"), p.alias("prob_pass"))


def _scores(spark: SparkSession, folder: str, given: Inputs | None = None) -> DataFrame:
    return evaluate.weekly_scores(_prepared(spark, folder, given).test)


def _histogram(spark: SparkSession, folder: str, given: Inputs | None = None) -> DataFrame:
    return ranking.by_mode(ranking.score_histogram(_scores(spark, folder, given), ["week"]), ["pass", "risk"])


def _log(spark: SparkSession, folder: str, given: Inputs | None = None) -> DataFrame:
    return evaluate.evaluate_variants(_scores(spark, folder, given))


# --- calendar and weekly activity ---------------------------------------------------------------

@query
def course_calendar(spark, folder):
    vle = relational.student_vle(relational.order_lines(spark, folder))
    return activity.course_calendar(vle, relational.student_info(spark, folder))


@query
def week_index(spark, folder):
    i = relational.inputs(spark, folder)
    calendar = activity.course_calendar(i.student_vle, i.student_info)
    return activity.with_week_index(i.student_vle, calendar).groupBy(
        "code_module", "code_presentation", "week_idx"
    ).agg(F.count("*").alias("n_rows"), F.sum("sum_click").alias("sum_click"))


def _weekly(spark, folder, join_keys="student"):
    i = relational.inputs(spark, folder)
    return activity.weekly_clicks(i.student_vle, i.student_info, enrolments.enrolments(i.student_info), join_keys)


@query
def weekly_clicks(spark, folder):
    return _weekly(spark, folder)


@query
def weekly_clicks_strict(spark, folder):
    return _weekly(spark, folder, "enrolment")


@query
def weekly_matrix(spark, folder):
    return activity.weekly_matrix(_weekly(spark, folder))


@query
def active_weeks(spark, folder):
    return activity.active_weeks(_weekly(spark, folder))


# --- enrolments, assessments, features ------------------------------------------------------------

@query
def label_enrolment(spark, folder):
    return enrolments.enrolments(relational.student_info(spark, folder)).select(
        "student_uid", "id_student", "code_module", "code_presentation", "final_result", "label")


@query
def distinct_learners(spark, folder):
    return enrolments.known_learners(relational.student_info(spark, folder))


@query
def assessment_features(spark, folder):
    scored = relational.student_assessment(relational.order_lines(spark, folder))
    profile, keys = assessments.score_profile(scored, relational.assessments(spark, folder))
    owners = enrolments.enrolments(relational.student_info(spark, folder))
    return row_rounded(owners.join(profile, keys).select("student_uid", "n_submitted", "mean_score"))


@query
def course_totals(spark, folder):
    return assessments.course_totals(relational.assessments(spark, folder))


FEATURE_COLUMNS = ["student_uid", "label", "has_clicks", "n_submitted", "mean_score", "total_clicks",
                   "active_weeks", "n_assessments", "completion"]


@query
def feature_table_(spark, folder):
    return row_rounded(_features(spark, folder).select(*FEATURE_COLUMNS))


@query
def feature_table_strict(spark, folder):
    return row_rounded(_features(spark, folder, "enrolment").select(*FEATURE_COLUMNS))


@query
def model_dataset_(spark, folder):
    return row_rounded(model_dataset(_features(spark, folder)).select(
        "student_uid", "label", "final_result", *week_columns(), "n_submitted", "mean_score",
        "total_clicks", "active_weeks", "n_assessments"))


# --- scaling and split ------------------------------------------------------------------------------

@query
def click_scaler(spark, folder):
    return scaling.scaler_table(model_dataset(_features(spark, folder)))


@query
def scaled_weekly(spark, folder):
    scaled = _prepared(spark, folder).dataset
    return scaled.select("student_uid", F.posexplode(F.array(*week_columns())).alias("week", "scaled"))


@query
def split_sizes(spark, folder):
    return splitting.split_sizes(splitting.with_split(model_dataset(_features(spark, folder))))


@query
def split_members(spark, folder):
    return splitting.with_split(model_dataset(_features(spark, folder))).select("student_uid", "split")


@query
def exact_split(spark, folder):
    rows = model_dataset(_features(spark, folder)).select("student_uid", "label")
    return splitting.with_exact_split(rows).select("student_uid", "label", "split")


@query
def real_labels(spark, folder):
    return _prepared(spark, folder).real


@query
def aligned_labels(spark, folder):
    p = _prepared(spark, folder)
    return enrolments.attach_labels(p.dataset, p.real).select("student_uid", "label")


@query
def masked_prefix(spark, folder):
    masked = scaling.mask_future(_prepared(spark, folder).test, 9)
    return masked.select("student_uid", *week_columns())


# --- index, risk, class view -------------------------------------------------------------------------

@query
def learning_index_(spark, folder):
    return row_rounded(_learners(spark, folder).select("student_uid", "learning_index"))


@query
def fallback_probability_(spark, folder):
    return row_rounded(_learners(spark, folder).select(
        "student_uid", "prob_pass", (F.lit(1.0) - F.col("prob_pass")).alias("prob_risk")))


@query
def at_risk(spark, folder):
    """Flagship: the ranked at-risk list from the index alone."""
    return row_rounded(warning.ranked_at_risk(warning.mark_at_risk(_features(spark, folder))))


@query
def at_risk_predicted(spark, folder):
    return row_rounded(warning.ranked_at_risk(_marked(spark, folder)))


@query
def at_risk_top(spark, folder):
    return row_rounded(warning.ranked_at_risk(_marked(spark, folder), 100))


@query
def warning_kpis(spark, folder):
    return rounded(warning.warning_kpis(_marked(spark, folder)))


@query
def class_kpis(spark, folder):
    return rounded(overview.class_kpis(_features(spark, folder)))


@query
def explain_at_risk(spark, folder):
    return row_rounded(warning.explain_at_risk(_marked(spark, folder)))


@query
def advice(spark, folder):
    return row_rounded(warning.advice(_marked(spark, folder)))


@query
def label_metric_means(spark, folder):
    simulated = whatif.class_whatif(_features(spark, folder), CLASS_SLIDERS)
    return rounded(overview.label_metric_means(simulated, "learning_index", "sim_learning_index"))


@query
def class_averages(spark, folder):
    return rounded(overview.class_averages(whatif.class_whatif(_features(spark, folder), CLASS_SLIDERS)))


@query
def confusion(spark, folder):
    learners = _learners(spark, folder)
    return overview.confusion_table(learners.withColumn("predicted_label", label_at("prob_pass")))


@query
def threshold_grid_edges(spark, folder):
    """The sweep over scores that lie exactly on the grid."""
    orders = relational._read(spark, folder, "orders")
    scored = orders.select(
        thresholds.grid_value(F.col("o_orderkey") % 101).alias("score"),
        (F.col("o_custkey") % 2).cast("int").alias("label"), (F.col("o_orderkey") % 3).cast("int").alias("week"),
    )
    histogram = ranking.by_mode(ranking.score_histogram(scored, ["week"]), ["pass", "risk"])
    return rounded(thresholds.threshold_sweep(histogram, ["mode", "week"]).drop("positives"), only=["precision", "recall", "f1"])


@query
def confusion_rates(spark, folder):
    return rounded(ranking.confusion_counts(_learners(spark, folder), ["code_module"], score="prob_pass"))


@query
def index_histogram(spark, folder):
    return row_rounded(overview.histogram(_learners(spark, folder), "learning_index", "label"))


@query
def index_quartiles(spark, folder):
    return rounded(overview.box_plot(_learners(spark, folder), "learning_index"))


@query
def metric_correlation(spark, folder):
    return rounded(overview.metric_correlation(_learners(spark, folder), *CORRELATION, by="label"))


@query
def class_weights(spark, folder):
    train = splitting.with_split(model_dataset(_features(spark, folder))).filter("split = 'train'")
    return rounded(overview.class_weights(train))


@query
def predictions_joined(spark, folder):
    learners = _learners(spark, folder)
    predictions = _predictions(learners.filter("has_clicks"))
    return row_rounded(enrolments.attach_predictions(learners.drop("prob_pass"), predictions).select(
        "student_uid", "predicted_label", "prob_pass", "prob_risk"))


# --- weekly evaluation --------------------------------------------------------------------------------

@query
def proxy_scores(spark, folder):
    return rounded(_scores(spark, folder).select("student_uid", "week", "score"), 9)


@query
def average_precision_weekly(spark, folder):
    return rounded(ranking.ranking_metrics(_histogram(spark, folder), ["mode", "week"]).drop("auc_roc"))


@query
def roc_auc_weekly(spark, folder):
    return rounded(ranking.ranking_metrics(_histogram(spark, folder), ["mode", "week"]).drop("auc_pr"))


@query
def brier_weekly(spark, folder):
    return rounded(ranking.score_totals(_histogram(spark, folder), ["mode", "week"]))


def _sweep(spark, folder):
    return thresholds.threshold_sweep(_histogram(spark, folder), ["mode", "week"])


@query
def threshold_sweep(spark, folder):
    return rounded(_sweep(spark, folder).drop("positives"), only=["precision", "recall", "f1"])


def _thresholds(spark, folder, strategy):
    picked = thresholds.select_thresholds(_sweep(spark, folder), ["mode", "week"], strategy)
    return rounded(picked.drop("theta_idx"), only=["precision", "recall", "f1"])


@query
def threshold_f1(spark, folder):
    return _thresholds(spark, folder, thresholds.Strategy("f1"))


@query
def threshold_precision_floor(spark, folder):
    return _thresholds(spark, folder, thresholds.Strategy("precision_floor", FLOOR))


@query
def threshold_cost(spark, folder):
    return _thresholds(spark, folder, thresholds.Strategy("cost", LOG_FP_COST))


@query
def weekly_metrics_pass(spark, folder):
    p = _prepared(spark, folder)
    return rounded(evaluate.weekly_metrics(p.test, p.real))


@query
def weekly_metrics_risk(spark, folder):
    p = _prepared(spark, folder)
    return rounded(evaluate.weekly_metrics(p.test, p.real, mode="risk"))


@query
def variant_comparison(spark, folder):
    return rounded(_log(spark, folder))


@query
def last_week_comparison(spark, folder):
    return rounded(evaluate.compare_variants(_log(spark, folder)))


@query
def best_variants(spark, folder):
    return rounded(evaluate.winners(_log(spark, folder)))


@query
def calibration_guard(spark, folder):
    return ranking.enough_of_both(_histogram(spark, folder), ["mode", "week"])


@query
def reliability_curve(spark, folder):
    risk = _histogram(spark, folder).filter("mode = 'risk'")
    return rounded(ranking.reliability_curve(risk, ["week"]))


# --- logs ---------------------------------------------------------------------------------------------

@query
def latest_per_week(spark, folder):
    return rounded(metric_log.latest_per(_log(spark, folder), ["week"], "ordinal"))


@query
def latest_threshold(spark, folder):
    return metric_log.latest_row(_log(spark, folder), ["week", "ordinal"]).select("week", "theta_t", "variant")


@query
def max_tp_fp(spark, folder):
    return metric_log.max_hits_per_week(_log(spark, folder))


@query
def stage_means(spark, folder):
    return rounded(metric_log.stage_means(
        _log(spark, folder), ["variant"], ["auc_pr", "auc_roc", "f1", "precision", "recall"]))


@query
def metric_series(spark, folder):
    columns = ["auc_pr", "auc_roc", "f1", "brier", "theta_t", "warn_count", "tp", "fp"]
    return rounded(metric_log.log_series(_log(spark, folder), "week", columns, ["variant"]))


@query
def numbered_weeks(spark, folder):
    """A log that lost its week column, numbered by its order."""
    log = _log(spark, folder).withColumnRenamed("week", "logged")
    return metric_log.with_week(log, "variant", "logged").select("variant", "week", "tp", "fp")


# --- what-if --------------------------------------------------------------------------------------------

@query
def whatif_class(spark, folder):
    simulated = whatif.class_whatif(_features(spark, folder), CLASS_SLIDERS)
    return row_rounded(simulated.select(
        "student_uid", *[f"sim_{m}" for m in METRICS], "learning_index", "sim_learning_index"))


@query
def simulated_pass_rate(spark, folder):
    return rounded(overview.simulated_pass_rate(
        _features(spark, folder), CLASS_SLIDERS.mean_score, CLASS_SLIDERS.completion))


def _scenario(name: str) -> Query:
    def run(spark, folder):
        changed = scenario.apply_scenario(_prepared(spark, folder).test, name)
        total = F.lit(0.0)
        for c in week_columns():
            total = total + F.col(c)
        return row_rounded(changed.select("student_uid", "in_cohort", *METRICS, total.alias("scaled_clicks")))
    return run


for _s in scenario.SCENARIOS:
    QUERIES[f"scenario_{_s.name}"] = _scenario(_s.name)


@query
def snapshot_means(spark, folder):
    """One snapshot row per scenario."""
    test = _prepared(spark, folder).test
    return rounded(scenario.scenario_means(test, scenario.SCENARIOS))


def _requests(spark, folder):
    return whatif.preset_requests(_prepared(spark, folder).test)


@query
def student_presets(spark, folder):
    return _requests(spark, folder).select("student_uid", "preset", *[f"in_{m}" for m in METRICS])


@query
def learner_whatif(spark, folder):
    return row_rounded(whatif.simulate_learner(_requests(spark, folder)).select(
        "student_uid", "preset", "prob_pass", "predicted_label", "prob_risk", "alert"))


@query
def twin_delta(spark, folder):
    return row_rounded(whatif.twin_delta(_requests(spark, folder), ["student_uid", "preset"]))


@query
def weekly_trend(spark, folder):
    goal = F.col("total_clicks") * F.lit(1.25)
    return whatif.weekly_trend(_prepared(spark, folder).test, goal, ["student_uid"])


@query
def learner_profile(spark, folder):
    return whatif.learner_profile(_prepared(spark, folder).dataset)


# --- blending ---------------------------------------------------------------------------------------------

def _blend_inputs(spark, folder):
    learners = _learners(spark, folder)
    return learners, _predictions(learners), _second_predictions(learners)


@query
def blend_search(spark, folder):
    real, first, second = _blend_inputs(spark, folder)
    return rounded(blending.blend_search(blending.common_predictions(real, first, second)))


@query
def blend_predictions(spark, folder):
    real, first, second = _blend_inputs(spark, folder)
    best = blending.best_weight(blending.blend_search(blending.common_predictions(real, first, second)))
    return row_rounded(blending.apply_blend(first, second, best))


# --- models -------------------------------------------------------------------------------------------------

def _checks(scored):
    """What must hold of any model's scores: every row has one, in range, and better than chance."""
    p = F.col("prob_pass")
    better = train.quality(scored).select(F.col("auc_roc") > 0.5).scalar()
    return scored.agg(
        F.count("*").alias("n_rows"), F.count(F.when(p.isNull(), 1)).alias("n_missing"),
        F.count(F.when((p < 0) | (p > 1), 1)).alias("n_outside"),
    ).withColumn("above_chance", better)


def _model_checks(train_one: Callable) -> Query:
    def run(spark, folder):
        p = _prepared(spark, folder)
        _, score = train_one(p.train)
        return _checks(score(p.test))
    return run


QUERIES["train_gbt"] = _model_checks(train.train_boosting)
QUERIES["train_sequence"] = _model_checks(train.train_sequence)
QUERIES["train_aggregate"] = _model_checks(train.train_aggregate)


@query
def train_baselines(spark, folder):
    p = _prepared(spark, folder)
    fitted = train.train_baselines(p.train)
    return metric_log.union_runs({name: _checks(score(p.test)) for name, score in fitted.items()})


@query
def tune(spark, folder):
    """Every configuration of a logistic grid, and whether it beats chance."""
    estimator = LogisticRegression(labelCol="label", weightCol="class_weight")
    grid = (ParamGridBuilder().addGrid(estimator.regParam, [0.0, 0.01, 0.1])
            .addGrid(estimator.elasticNetParam, [0.0, 0.5]).build())
    scores = train.tune(_prepared(spark, folder).train, estimator, grid).scores
    rows = [(i, float(m[estimator.regParam]), float(m[estimator.elasticNetParam]), v is not None and 0.5 < v <= 1)
            for i, (m, v) in enumerate(zip(grid, scores))]
    return spark.createDataFrame(rows, "ordinal int, reg_param double, elastic_net double, above_chance boolean")


@query
def calibration_share(spark, folder):
    """Rows per week and label that the calibrators are fitted on."""
    points = calibration.calibration_points(_scores(spark, folder))
    return points.groupBy("week").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


@query
def calibrate_platt(spark, folder):
    """Slope and intercept per week, on the scores as they are."""
    fits = calibration.fit_platt(calibration.calibration_points(_scores(spark, folder)))
    rows = spark.createDataFrame([(week, *fit) for week, fit in fits.items()], "week int, slope double, intercept double")
    return rounded(rows, 5)


@query
def calibrate_isotonic(spark, folder):
    """Fitted value per week and score of the share, on the scores as they are."""
    points = calibration.calibration_points(_scores(spark, folder))
    fitted = calibration.apply_isotonic(points, calibration.fit_isotonic(points))
    return fitted.select("week", F.round("p", 9).alias("score"), F.round("fitted", 6).alias("fitted"))


@query
def weekly_metrics_platt(spark, folder):
    """Weekly evaluation of calibrated scores: what needs no fit of its own to be checked."""
    return rounded(evaluate.weekly_metrics(_prepared(spark, folder).test, calibration="platt").select(
        "week", "auc_pr", "auc_roc", "brier"))


@query
def weekly_metrics_model(spark, folder):
    """Weekly evaluation of a trained model on masked prefixes, in what must hold of any model."""
    p = _prepared(spark, folder)
    _, score = train.train_sequence(p.train)
    m = staged(evaluate.weekly_metrics(p.test, model=score), "model-metrics")
    shares = ["auc_pr", "auc_roc", "f1", "precision", "recall", "brier", "theta_t"]
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0, 1.0000001) for c in shares])
    return m.select("week", inside.alias("in_range"), (F.col("warn_count") == F.col("tp") + F.col("fp")).alias("adds_up"))


@query
def rebuild_consistency(spark, folder):
    """The published log's last threshold, applied to the published predictions, gives its warnings."""
    root = work_path(spark, "rebuild")
    rebuild.rebuild(spark, relational.inputs(spark, folder), root, run="first")
    paths = rebuild.published(spark, root)
    last = spark.read.parquet(paths.log).filter(F.col("week") == 19).select("theta_t", "warn_count")
    warned = F.count(F.when(1.0 - F.col("prob_pass") >= F.col("theta_t"), 1))
    predictions = spark.read.parquet(paths.predictions).withColumn("week", F.lit(19))
    log = last.withColumn("week", F.lit(19))
    return predictions.join(log, "week").agg(
        F.count("*").alias("n_predictions"), (warned - F.max("warn_count")).alias("difference")
    )


@query
def incremental_clicks(spark, folder):
    """Weekly clicks after three updates, each of which reads its new files only and brings earlier first days."""
    i = relational.inputs(spark, folder)
    log = work_path(spark, "clicks")
    days = incremental.ClickDays(spark, log, work_path(spark, "days"))
    for part in (F.col("date") >= 60, F.col("date").between(0, 59), F.col("date") < 0):
        i.student_vle.filter(part).write.mode("append").parquet(log)
        days.update()
    return days.weekly(i.student_info, enrolments.enrolments(i.student_info))


# --- sources and sinks: written, then read back with the public readers ---------------------------------------

@query
def raw_csv_features(spark, folder):
    """Features of the four raw tables after a way through CSV files with extra columns."""
    i, root = relational.inputs(spark, folder), work_path(spark, "raw-csv")
    for name, table in (("studentInfo", i.student_info), ("studentVle", i.student_vle),
                        ("assessments", i.assessments), ("studentAssessment", i.student_assessment)):
        sinks.export_csv(table.withColumn("surplus", F.lit("a, b")), f"{root}/{name}.csv")
    return row_rounded(feature_table(readers.read_inputs(spark, root)).select(*FEATURE_COLUMNS))


@query
def history_round_trip(spark, folder):
    path = work_path(spark, "history")
    sinks.append_history(whatif.simulate_learner(_requests(spark, folder)), path)
    history = readers.read_table(spark, path, WHATIF_HISTORY)
    return row_rounded(history.filter("timestamp IS NOT NULL").drop("timestamp"))


@query
def history_csv_round_trip(spark, folder):
    """The same log as CSV under the names of existing extracts, read by the tolerant reader."""
    path = work_path(spark, "history-csv")
    order = ["n_submitted", "mean_score", "completion", "total_clicks", "active_weeks"]
    requests = whatif.simulate_learner(_requests(spark, folder))
    rows = requests.select(
        F.lit("2024-01-01 00:00:00").alias("timestamp"), F.concat("student_uid", F.lit(",x")).alias("id_student"),
        *[F.col(f"in_{m}").cast("double").alias(m) for m in order], "prob_pass",
    )
    sinks.export_csv(sinks.to_extract_names(rows), path)
    history = readers.read_tolerant_csv(spark, path, WHATIF_HISTORY)
    return row_rounded(history.drop("timestamp"))


@query
def log_round_trip(spark, folder):
    """Two runs appended to one log; the threshold in force is that of the later run."""
    path, log = work_path(spark, "log"), staged(_log(spark, folder), "metrics")
    for run, variant, second in (("first", "pass_f1", "01"), ("second", "risk_cost", "02")):
        rows = log.filter(F.col("variant") == variant).select(*evaluate.LOG_COLUMNS)
        sinks.append_log(rows, path, run, F.to_timestamp(F.lit(f"2024-01-01 00:00:{second}")))
    both = readers.read_table(spark, path)
    theta = metric_log.latest_threshold(both)
    return rounded(both.groupBy("run").agg(F.count("*").alias("n"), F.sum("warn_count").alias("warned")).withColumn("theta", theta))


@query
def predictions_round_trip(spark, folder):
    path = work_path(spark, "predictions")
    learners = _learners(spark, folder).withColumn("predicted_label", label_at("prob_pass"))
    sinks.write_predictions(learners, path)
    return row_rounded(readers.read_first(spark, [f"{path}-none", path], PREDICTIONS))


@query
def early_warning_report(spark, folder):
    """The ranked list of the whole report, with predictions and the latest threshold of a log."""
    given = relational.inputs(spark, folder)
    learners = _features(spark, folder, given=given)
    predictions = _learners(spark, folder, given).select("student_uid", label_at("prob_pass").alias("predicted_label"), "prob_pass")
    log = _log(spark, folder, given).filter("variant = 'risk_f1'").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    report = early_warning(learners, predictions, log)
    return row_rounded(report.ranked.select("student_uid", "learning_index", "prob_risk"))


@query
def memoised_scan(spark, folder):
    """A folder read through the memo, again at the limit without a change, and 5 s after rows were added."""
    path, now = work_path(spark, "memo"), [0.0]
    learners = staged(_learners(spark, folder).select("student_uid", "prob_pass", label_at("prob_pass").alias("predicted_label")), "learners")
    memo = MemoisedScan(spark, lambda session, where: readers.read_table(session, where, PREDICTIONS), clock=lambda: now[0])
    shown = []
    for seconds, added in ((0.0, "predicted_label = 1"), (5.0, None), (10.0, "predicted_label = 0")):
        if added:
            learners.filter(added).write.mode("append").parquet(path)
        now[0] = seconds
        sums = memo.scan(path).agg(F.count("*").alias("n"), F.sum("predicted_label").cast("bigint").alias("n_pass"))
        shown.append(staged(sums.select(F.lit(seconds).alias("seconds"), "*", F.lit(memo.reads).alias("n_reads")), "memo-shown"))
    memo.clear()
    return reduce(DataFrame.unionByName, shown)


@query
def live_view(spark, folder):
    """The monitor's view of a snapshot log that a stream writes meanwhile, read through the memo in each cycle."""
    test = staged(_prepared(spark, folder).test, "test")
    inbox, log, status, state = (work_path(spark, name) for name in ("live", "snapshots", "status", "stream-state"))
    writer = twin.snapshot_writer(log, status, scenario.scenario_named("exam_season"))
    now, shown = [0.0], []
    memo = MemoisedScan(spark, runner.read_batches, clock=lambda: now[0])
    part = F.substring(F.md5("student_uid"), 1, 1)
    for cycle, (low, high) in enumerate((("0", "4"), ("5", "a"), ("b", "f"))):
        test.filter(part.between(low, high)).coalesce(1).write.mode("append").parquet(inbox)
        runner.run_available(spark, twin.watch_table(spark, inbox, test.schema), writer, checkpoint=state)
        now[0] += 5.0
        columns = ["scenario", "rows", "mean_score", "theta_t"]  # the log has no threshold: it is left out
        view = metric_log.live_view(memo.scan(log), ["batch_id"], columns)
        shown.append(staged(view.select(F.lit(cycle).alias("cycle"), "*"), "live-shown"))
    memo.clear()
    return rounded(reduce(DataFrame.unionByName, shown))


@query
def status_documents(spark, folder):
    """Status documents as the reader of JSON finds them: an unreadable one and an absent folder give no row."""
    _, status = _snapshots(spark, folder)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(f"{status}/broken")
    found = [readers.read_status(spark, f"{status}/{name}") for name in ("batch_id=0", "broken", "none")]
    return reduce(DataFrame.unionByName, found).select("scenario", "affected_fraction", "rows")


@query
def source_file_times(spark, folder):
    """Latest change of each written file: one row per file, none in the future, the clock as text."""
    path = staged_path(relational.student_info(spark, folder).repartition(3), "file-times")
    times = readers.file_times(spark, path)
    passed = F.col("modified") <= F.current_timestamp()
    return times.agg(
        F.count("*").alias("n_files"), F.min(passed).alias("passed"),
        F.min(F.col("clock").rlike("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$")).alias("readable"),
    )


@query
def backfilled_columns(spark, folder):
    """An extract that lacks columns, filled up with nulls or a constant."""
    old = _learners(spark, folder).select("student_uid", F.col("total_clicks").cast("double").alias("total_clicks"))
    filled = readers.with_missing_columns(old, ["total_clicks", "mean_score"])
    return readers.with_missing_columns(filled, ["completion"], 0.5)


@query
def learner_lookup(spark, folder):
    """Lookup of single learners by key: the first and the last one, and one there is not."""
    data = _prepared(spark, folder).dataset
    ends = data.agg(F.min("student_uid"), F.max("student_uid")).first()
    found = [whatif.learner(data, uid) for uid in (*ends, "nobody") if uid is not None]
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("student_uid", "label", "total_clicks", F.round("w0_clicks", 9).alias("w0"))


@query
def conditional_labels(spark, folder):
    """Labels joined where a table has none, kept where it has them, 0 without any source."""
    p = _prepared(spark, folder)
    bare = p.dataset.select("student_uid")
    views = {"joined": enrolments.ensure_label(bare, p.real), "none": enrolments.ensure_label(bare),
             "kept": enrolments.ensure_label(p.dataset.select("student_uid", (1 - F.col("label")).alias("label")), p.real)}
    each = [df.select(F.lit(name).alias("view"), "student_uid", F.col("label").cast("int").alias("label")) for name, df in views.items()]
    return reduce(DataFrame.unionByName, each)


# --- streams ------------------------------------------------------------------------------------------------

#: Parts of a backlog, ranges that make up a part, and rows of one of its files.
BACKLOG_PARTS, BACKLOG_RANGES, BACKLOG_ROWS = 5, 16, 2_000_000


def _backlog(table, order, purpose):
    """The table in five parts, newest rows first, so that a stream meets the oldest last.

    Each part has as many files as its rows need; rows of one value of ``order`` are spread by a hash.
    A part is several ranges, each a task's work, as a fifth of the table is too much for one.
    The path, the number of files of a part, and a function that writes part ``i``.
    """
    path = work_path(table.sparkSession, purpose)
    spread = F.xxhash64(*table.columns)
    ranges = table.repartitionByRange(BACKLOG_PARTS * BACKLOG_RANGES, F.col(order).desc(), spread)
    parts = ranges.withColumn("_part", F.floor(F.spark_partition_id() / BACKLOG_RANGES).cast("int"))
    parts = staged(parts, purpose, ["_part"])
    files = 1 + parts.count() // (BACKLOG_PARTS * BACKLOG_ROWS)

    def write(part):
        parts.filter(F.col("_part") == part).drop("_part").repartition(files).write.mode("append").parquet(path)

    return path, files, write


def _whole_backlog(table, order, purpose):
    path, files, write = _backlog(table, order, purpose)
    for part in range(BACKLOG_PARTS):
        write(part)
    return path, files


@query
def stream_weekly(spark, folder):
    table = spark.read.schema(relational.TABLES["events"]).parquet(f"{folder}/events.parquet")
    path, files = _whole_backlog(table, "ts", "events")
    events = twin.watch_table(spark, path, table.schema, files_per_trigger=files)
    out = work_path(spark, "weekly-events")
    runner.run_available(spark, events, runner.batch_table(out, stream_activity.weekly_events))
    final = stream_activity.total_events(runner.read_batches(spark, out))
    return rounded(final.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd")))


def _test_stream(spark, folder):
    test = _prepared(spark, folder).test
    return twin.watch_table(spark, staged_path(test, "test"), test.schema)


@query
def stream_rescore(spark, folder):
    out = work_path(spark, "predictions")
    runner.run_available(spark, twin.rescore(_test_stream(spark, folder)), runner.batch_table(out))
    return row_rounded(runner.newest(runner.read_batches(spark, out), ["student_uid"]))


def _snapshots(spark, folder):
    log, status = work_path(spark, "snapshots"), work_path(spark, "status")
    writer = twin.snapshot_writer(log, status, scenario.scenario_named("exam_season"))
    runner.run_available(spark, _test_stream(spark, folder), writer)
    return log, status


@query
def stream_snapshot(spark, folder):
    log, _ = _snapshots(spark, folder)
    return rounded(runner.read_batches(spark, log).drop("timestamp", "batch_id", "rows", "test_csv_mtime"))


@query
def stream_status(spark, folder):
    _, status = _snapshots(spark, folder)
    documents = spark.read.schema(f"{STATUS}, batch_id BIGINT").option("basePath", status).json(status)
    return metric_log.latest_row(documents, ["batch_id"]).select("scenario", "affected_fraction", "rows")


@query
def stream_alerts(spark, folder):
    rows = _scores(spark, folder).withColumn("prob_risk", F.lit(1.0) - F.col("score"))
    path = staged_path(rows, "scores")
    scores = spark.read.schema(rows.schema).parquet(path)
    histogram = ranking.by_mode(ranking.score_histogram(scores, ["week"]), ["risk"])
    sweep = thresholds.threshold_sweep(histogram, ["mode", "week"])
    picked = thresholds.select_thresholds(sweep, ["mode", "week"], thresholds.Strategy("f1"))
    theta = staged(picked.select("week", F.col("theta").alias("theta_t")), "thresholds")
    out = work_path(spark, "alerts")
    stream = twin.alerts(twin.watch_table(spark, path, scores.schema), theta)
    runner.run_available(spark, stream, runner.batch_table(out))
    found = runner.read_batches(spark, out).select("student_uid", "week", "prob_risk", "theta_t", "alert")
    return rounded(found, 9, ["prob_risk"])


@query
def stream_learner_weeks(spark, folder):
    i = relational.inputs(spark, folder)
    calendar = staged(activity.course_calendar(i.student_vle, i.student_info), "calendar")
    clicks = i.student_vle.select("id_student", "code_module", "code_presentation", "date", "sum_click")
    path, files = _whole_backlog(clicks, "code_presentation", "clicks")
    out = work_path(spark, "learner-weeks")
    stream = twin.watch_table(spark, path, clicks.schema, files_per_trigger=files)
    runner.run_available(spark, stream, runner.batch_table(out, lambda b: stream_activity.learner_weeks(b, calendar)))
    return stream_activity.total_per_week(runner.read_batches(spark, out))


def _click_stream(spark, folder):
    """Inputs with enrolments and calendar written once, the calendar, and a backlog of the clicks, written part by part."""
    i = relational.inputs(spark, folder)
    i = replace(i, student_info=staged(i.student_info, "student-info"))
    calendar = staged(activity.course_calendar(i.student_vle, i.student_info), "calendar")
    i = replace(i, calendar=calendar)
    clicks = i.student_vle.select("id_student", "code_module", "code_presentation", "date", "sum_click")
    return i, calendar, clicks.schema, *_backlog(clicks, "code_presentation", "clicks")


def _risk_thresholds(spark, folder, given):
    """(week, theta_t) of the risk scores, by F1."""
    sweep = thresholds.threshold_sweep(_histogram(spark, folder, given).filter("mode = 'risk'"), ["mode", "week"])
    picked = thresholds.select_thresholds(sweep, ["mode", "week"], thresholds.Strategy("f1"))
    return staged(picked.select("week", F.col("theta").alias("theta_t")), "thresholds")


@query
def stream_learner_state(spark, folder):
    """Series, current risk and flag of every learner, from a stream that is stopped and started again."""
    i, calendar, schema, path, files, write = _click_stream(spark, folder)
    weekly, _ = activity.learner_weeks(i.student_vle, i.student_info, calendar=calendar)
    ranges = learner_state.mean_ranges(learner_state.series_of(weekly)).join(_risk_thresholds(spark, folder, i), "week")
    fitted = learner_state.WeeklyRisk.of_table(ranges)
    out, state = work_path(spark, "learner-state"), work_path(spark, "stream-state")
    for run in (range(3), range(3, BACKLOG_PARTS)):
        for part in run:
            write(part)
        clicks = twin.watch_table(spark, path, schema, files_per_trigger=files)
        series = learner_state.weekly_series(clicks, calendar)
        runner.run_available(spark, series, runner.batch_table(out), "update", state)
    newest = runner.newest(runner.read_batches(spark, out), ["id_student"]).drop("n_updates")
    found = fitted.current(newest).withColumn("weeks", F.array_join(F.col("weeks").cast("array<string>"), ","))
    return row_rounded(found)


@query
def stream_running_alerts(spark, folder):
    """Alerts from raw clicks, scaled as the data come, as they stand at the end of the stream."""
    i, calendar, schema, path, files, write = _click_stream(spark, folder)
    rows = splitting.with_split(enrolments.enrolments(i.student_info).select("id_student", "student_uid").distinct())
    enrolled = staged(rows.withColumn("scored", F.col("split") == "test"), "enrolled")
    alerts = running_alerts.RunningAlerts(spark, work_path(spark, "running-alerts"), enrolled, _risk_thresholds(spark, folder, i))
    for part in range(BACKLOG_PARTS):
        write(part)
    clicks = twin.watch_table(spark, path, schema, files_per_trigger=files)
    runner.run_available(spark, learner_state.weekly_series(clicks, calendar), alerts, "update")
    return rounded(alerts.read(), 9, ["prob_risk"])


@query
def stream_event_windows(spark, folder):
    """Weekly sums with a watermark of a day, over events of which the oldest come last: late ones are added again."""
    table = spark.read.schema(relational.TABLES["events"]).parquet(f"{folder}/events.parquet")
    path, files = _whole_backlog(table, "ts", "events")
    out = work_path(spark, "event-windows")
    event_windows.write_windows(spark, twin.watch_table(spark, path, table.schema, files_per_trigger=files), out, "1 day")
    final = event_windows.read_windows(spark, out).drop("n_late")
    return rounded(final.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd")))


@query
def stream_compacted(spark, folder):
    """Weekly sums whose batches are merged while the stream goes on, once without the merge being published."""
    table = spark.read.schema(relational.TABLES["events"]).parquet(f"{folder}/events.parquet")
    path, files, write = _backlog(table, "ts", "events")
    out, state = work_path(spark, "weekly-events"), work_path(spark, "stream-state")
    merge = batch_store.merge_sums(["user_id", "event_type", "week_start"])
    for part in range(BACKLOG_PARTS):
        write(part)
        events = twin.watch_table(spark, path, table.schema, files_per_trigger=files)
        runner.run_available(spark, events, runner.batch_table(out, stream_activity.weekly_events), checkpoint=state)
        if part == 2:
            batch_store.write_merged(spark, out, merge)  # ends here, as if it had failed
        else:
            batch_store.compact(spark, out, merge)
    final = stream_activity.total_events(batch_store.read_table(spark, out))
    return rounded(final.withColumn("week_start", F.date_format("week_start", "yyyy-MM-dd")))


# functions whose plain name is taken by the operator they call
for _name in ("feature_table_", "model_dataset_", "learning_index_", "fallback_probability_"):
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
