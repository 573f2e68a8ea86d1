"""Week-by-week evaluation: one job for all weeks, modes and threshold strategies."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.operators.calibration import calibrate_weekly
from coursebeacon.operators.enrolments import attach_labels
from coursebeacon.operators.metric_log import best_variants, latest_per
from coursebeacon.operators.proxy import proxy_scores
from coursebeacon.operators.ranking import by_mode, ranking_metrics, score_histogram, score_totals
from coursebeacon.operators.scaling import ClickScaler, every_prefix
from coursebeacon.operators.thresholds import SWEEP_FIELDS, Strategy, threshold_sweep
from coursebeacon.plans.prefix_scores import SUPPORTED, prefix_scores
from coursebeacon.schemas import MAX_WEEKS


@dataclass(frozen=True)
class Variant:
    name: str
    mode: str = "pass"
    strategy: Strategy = Strategy("f1")


# The five compared variants, in order.
VARIANTS = [
    Variant("pass_f1", "pass", Strategy("f1")),
    Variant("pass_cost", "pass", Strategy("cost", 2.5)),
    Variant("pass_precision", "pass", Strategy("precision_floor", 0.75)),
    Variant("risk_f1", "risk", Strategy("f1")),
    Variant("risk_cost", "risk", Strategy("cost", 2.5)),
]


def weekly_scores(
    test: DataFrame,
    model=None,
    scaler: ClickScaler | None = None,
    max_weeks: int = MAX_WEEKS,
) -> DataFrame:
    """(student_uid, label, week, score) of the observed prefix of every week.

    The weekly columns are taken as scaled already; a ``scaler`` scales them (again), after the
    weeks not yet observed were zeroed. ``model`` maps a table with such weekly columns to one with
    ``prob_pass``; where it says which weekly model it runs, each row is read once for all weeks,
    otherwise once per week.
    """
    if model is None:
        rows = test if scaler is None else scaler.transform(test)
        return proxy_scores(rows, ["student_uid", "label"], max_weeks)
    known = getattr(model, "weekly_model", None)
    if scaler is None and isinstance(known, SUPPORTED):
        keys = ["student_uid", "label"]
        return prefix_scores(test, known, keys, max_weeks).select(*keys, F.posexplode("scores").alias("week", "score"))
    prefixes = every_prefix(test, max_weeks)
    rows = prefixes if scaler is None else scaler.transform(prefixes)
    return model(rows).select("student_uid", "label", "week", F.col("prob_pass").alias("score"))


def evaluate_variants(
    scored: DataFrame, variants: list[Variant] = VARIANTS, digits: int | None = None,
) -> DataFrame:
    """One metric row per variant and week.

    All variants are read off one score histogram: the scored rows are shuffled once, and only
    distinct scores (then at most 101 grid points per week and mode) go on from there.
    """
    modes = list(dict.fromkeys(v.mode for v in variants))
    histogram = by_mode(score_histogram(scored, ["week"], digits=digits), modes)
    groups = ["mode", "week"]
    row = F.struct(*SWEEP_FIELDS)
    picks = [v.strategy.chosen(row).alias(f"_v{i}") for i, v in enumerate(variants)]
    picked = threshold_sweep(histogram, groups).groupBy(*groups).agg(*picks)
    listed = F.array(*[
        F.struct(F.lit(v.name).alias("variant"), F.lit(i).alias("ordinal"),
                 F.lit(v.mode).alias("_mode"), F.col(f"_v{i}").alias("_row"))
        for i, v in enumerate(variants)
    ])
    chosen = picked.select(*groups, F.inline(listed)).filter(F.col("_mode") == F.col("mode"))
    return (
        chosen.join(ranking_metrics(histogram, groups), groups)
        .join(score_totals(histogram, groups), groups)
        .select(
            "variant", "ordinal", "mode", "week", "auc_pr", "auc_roc",
            F.col("_row.f1").alias("f1"), F.col("_row.precision").alias("precision"),
            F.col("_row.recall").alias("recall"), "brier", F.col("_row.theta").alias("theta_t"),
            (F.col("_row.tp") + F.col("_row.fp")).alias("warn_count"),
            F.col("_row.tp").alias("tp"), F.col("_row.fp").alias("fp"),
        )
    )


LOG_COLUMNS = ["week", "auc_pr", "auc_roc", "f1", "precision", "recall", "brier", "theta_t",
               "warn_count", "tp", "fp"]


def weekly_metrics(
    test: DataFrame,
    real: DataFrame | None = None,
    model=None,
    scaler: ClickScaler | None = None,
    max_weeks: int = MAX_WEEKS,
    calibration: str | None = None,
    threshold: str = "f1",
    precision_floor: float = 0.8,
    fp_cost: float = 2.0,
    mode: str = "pass",
    unknown_label: str = "zero",
    digits: int | None = None,
) -> DataFrame:
    """The evaluation of one variant. Thresholds are chosen on the rows they are evaluated on."""
    labelled = test if real is None else attach_labels(test, real, unknown_label)
    scored = weekly_scores(labelled, model, scaler, max_weeks)
    parameter = {"f1": None, "precision_floor": precision_floor, "cost": fp_cost}[threshold]
    if calibration is None:
        variant = Variant(mode, mode, Strategy(threshold, parameter))
    else:
        # the calibrator sees labels and scores of the mode, so the turn comes first
        if mode == "risk":
            scored = scored.withColumns({"score": 1.0 - F.col("score"), "label": 1 - F.col("label")})
        scored = calibrate_weekly(scored, calibration)
        variant = Variant(mode, "pass", Strategy(threshold, parameter))
    return evaluate_variants(scored, [variant], digits).select(*LOG_COLUMNS)


def compare_variants(metrics: DataFrame) -> DataFrame:
    """Last week of every variant."""
    return latest_per(metrics, ["variant"], "week")


def winners(metrics: DataFrame) -> DataFrame:
    return best_variants(compare_variants(metrics))
