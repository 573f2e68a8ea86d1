"""Early warning: at-risk rule, ranked list, KPIs, explanation and advice."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.learning_index import WEIGHTS, learning_index
from coursebeacon.functions.scalars import deviation_percent, lookup, ratio
from coursebeacon.schemas import DEFAULT_INDEX_THRESHOLD, DEFAULT_RISK_THRESHOLD, METRICS

# Advice per factor; pass a table of your own to ``advice`` to replace it.
ADVICE = {
    "mean_score": "Scores lag behind: go through the feedback of past tasks and book a tutoring hour.",
    "completion": "Open tasks remain: plan two fixed slots a week and close the oldest first.",
    "n_submitted": "Few tasks were handed in: agree on the next due date and submit a draft early.",
    "total_clicks": "Little time on the platform: start each session with the reading of the week.",
    "active_weeks": "Activity comes in bursts: log in at least once in every course week.",
}
DEFAULT_ADVICE = "Talk to the course team about a study plan."


def mark_at_risk(
    df: DataFrame,
    index_threshold: float = DEFAULT_INDEX_THRESHOLD,
    risk_threshold: Column | float = DEFAULT_RISK_THRESHOLD,
    index_column: str | None = None,
) -> DataFrame:
    """Adds ``at_risk`` (never NULL): a low index, or a risk at or above the threshold."""
    if index_column is None:
        df, index_column = df.withColumn("learning_index", learning_index()), "learning_index"
    theta = risk_threshold if isinstance(risk_threshold, Column) else F.lit(float(risk_threshold))
    low = F.coalesce(F.col(index_column) < F.lit(float(index_threshold)), F.lit(False))
    risky = F.lit(False)
    if "prob_risk" in df.columns:
        risky = F.coalesce(F.col("prob_risk") >= theta, F.lit(False))
    return df.withColumn("at_risk", low | risky)


def ranked_at_risk(marked: DataFrame, k: int | None = None) -> DataFrame:
    """At-risk learners, riskiest first; unknown risk last, then by index and key."""
    columns = ["student_uid", "mean_score", "completion", "n_submitted", "total_clicks",
               "active_weeks", "learning_index", "prob_risk"]
    listed = marked.filter("at_risk").select(*[c for c in columns if c in marked.columns])
    order = []
    if "prob_risk" in listed.columns:
        order.append(F.col("prob_risk").desc_nulls_last())
    order += [F.col("learning_index").desc(), F.col("student_uid")]
    ordered = listed.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def warning_kpis(marked: DataFrame, index_column: str = "learning_index") -> DataFrame:
    at_risk = F.count(F.when(F.col("at_risk"), 1))
    share = ratio(at_risk, F.count("*"))
    return marked.agg(
        F.avg(index_column).alias("mean_index"),
        (share * 100.0).alias("at_risk_pct"),
        ((F.lit(1.0) - share) * 100.0).alias("predicted_pass_pct"),
    )


def _factors(marked: DataFrame, metrics: list[str]) -> tuple[DataFrame, list[Column]]:
    means = marked.agg(F.struct(*[F.avg(m).alias(m) for m in metrics]).alias("means"))
    at_risk = marked.filter("at_risk").withColumn("_means", means.scalar())
    factors = []
    for i, m in enumerate(metrics):
        mean = F.col("_means")[m]
        deviation = deviation_percent(m, mean)
        factors.append(F.struct(
            (deviation * F.lit(WEIGHTS[m])).alias("impact"),
            F.lit(i).alias("position"),
            F.lit(m).alias("factor"),
            F.col(m).cast("double").alias("value"),
            mean.alias("class_mean"),
            deviation.alias("deviation_pct"),
            F.lit(WEIGHTS[m]).alias("weight"),
        ))
    return at_risk, factors


def explain_at_risk(marked: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Per at-risk learner and factor: deviation from the class mean times the weight.

    The class means are one row, read as a scalar subquery; learners are neither shuffled nor joined.
    """
    at_risk, factors = _factors(marked, metrics)
    rows = at_risk.select("student_uid", F.inline(F.array(*factors)))
    return rows.select("student_uid", "factor", "value", "class_mean", "deviation_pct", "weight", "impact")


def advice(marked: DataFrame, metrics: list[str] = METRICS, texts: dict[str, str] | None = None) -> DataFrame:
    """Weakest factor of each at-risk learner and what to do about it; row-local."""
    at_risk, factors = _factors(marked, metrics)
    known = F.filter(F.array(*factors), lambda f: f["impact"].isNotNull())
    weakest = at_risk.select("student_uid", F.array_min(known).alias("_weakest"))
    return weakest.select(
        "student_uid",
        F.col("_weakest")["factor"].alias("factor"),
        F.col("_weakest")["impact"].alias("impact"),
        F.coalesce(lookup(F.col("_weakest")["factor"], texts or ADVICE), F.lit(DEFAULT_ADVICE)).alias("advice"),
    )
