"""Quality of scores: average precision, ROC area, Brier, and counts at a cut.

Every metric is computed from one table, the score histogram: positives and negatives per group
and distinct score. It is built with one map-side-combined aggregate, so a score shared by a third
of all rows costs no more than any other, and pass and risk views are two readings of it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import label_at, ratio
from coursebeacon.operators.ordered import running_totals

# Width of the score buckets inside which running totals are ordered.
BUCKET_WIDTH = 2.0**-15


def _checked(scored: DataFrame, score: str, label: str) -> Column:
    """The score as a double; a missing score or an impossible label stops the job."""
    value = F.col(score).cast("double")
    bad = value.isNull() | F.isnan(value) | ~F.coalesce(F.col(label).isin(0, 1), F.lit(True))
    return F.when(bad, F.raise_error("a score is missing, or a label is neither 0 nor 1")).otherwise(value)


def score_histogram(
    scored: DataFrame, groups: list[str], score: str = "score", label: str = "label",
    digits: int | None = None,
) -> DataFrame:
    """(groups, p, pos, neg): positives and negatives per distinct score.

    A missing label counts as 0, as in the evaluation of learners without a result; a missing score
    or any other label is an error. ``digits`` rounds the scores, which makes the table smaller and
    merges scores, also across thresholds; by default nothing is rounded.
    """
    p = _checked(scored, score, label)
    if digits is not None:
        p = F.round(p, digits)
    return scored.groupBy(*groups, p.alias("p")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.coalesce(F.col(label), F.lit(0)) == 0, 1)).alias("neg"),
    )


def by_mode(histogram: DataFrame, modes: list[str]) -> DataFrame:
    """The histogram as seen in each mode: ``risk`` turns score and label around.

    Scores that become equal when turned around stay rows of their own, which count as ties.
    """
    views = {
        "pass": F.struct(F.lit("pass").alias("mode"), F.col("p"),
                         F.col("pos").alias("pos"), F.col("neg").alias("neg")),
        "risk": F.struct(F.lit("risk").alias("mode"), (F.lit(1.0) - F.col("p")).alias("p"),
                         F.col("neg").alias("pos"), F.col("pos").alias("neg")),
    }
    rest = [c for c in histogram.columns if c not in ("p", "pos", "neg")]
    return histogram.select(*rest, F.inline(F.array(*[views[m] for m in modes])))


def ranking_metrics(histogram: DataFrame, groups: list[str]) -> DataFrame:
    """Average precision over distinct scores and ROC area with ties counting half.

    Without positives the average precision is 0; with one class missing the ROC area is NULL.
    """
    bucket = F.floor(F.col("p") / F.lit(BUCKET_WIDTH))
    running = running_totals(histogram, groups, "p", ["pos", "neg"], bucket, descending=True)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    cum_pos, cum_neg = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    sums = running.groupBy(*groups).agg(
        F.sum(pos * cum_pos / (cum_pos + cum_neg)).alias("_ap"),
        F.sum(neg * (cum_pos - F.col("tied_pos").cast("double") / 2.0)).alias("_u"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    pairs = F.col("_p").cast("double") * F.col("_n").cast("double")
    return sums.select(
        *groups,
        F.coalesce(ratio("_ap", "_p"), F.lit(0.0)).alias("auc_pr"),
        ratio("_u", pairs).alias("auc_roc"),
    )


def score_totals(histogram: DataFrame, groups: list[str]) -> DataFrame:
    """Class counts and Brier score; a score outside [0, 1] makes the Brier score NULL."""
    p = F.col("p")
    error = F.col("pos") * (p - 1.0) * (p - 1.0) + F.col("neg") * p * p
    n = F.col("positives") + F.col("negatives")
    return (
        histogram.groupBy(*groups)
        .agg(
            F.sum("pos").alias("positives"),
            F.sum("neg").alias("negatives"),
            F.sum(error).alias("_error"),
            F.min(p).alias("_low"),
            F.max(p).alias("_high"),
        )
        .select(
            *groups, "positives", "negatives",
            F.when((F.col("_low") >= 0) & (F.col("_high") <= 1), ratio("_error", n)).alias("brier"),
        )
    )


def confusion_counts(
    scored: DataFrame, groups: list[str], score: str = "score", label: str = "label",
    cut: float = 0.5, inclusive: bool = True,
) -> DataFrame:
    """TP, FP, FN, TN and what follows from them at one fixed cut."""
    hit = label_at(score, cut, inclusive)

    def count(y, yhat, name):
        return F.count(F.when((F.col(label) == y) & (hit == yhat), 1)).alias(name)

    counted = scored.groupBy(*groups).agg(
        count(1, 1, "tp"), count(0, 1, "fp"), count(1, 0, "fn"), count(0, 0, "tn")
    )
    return counted.select(*groups, "tp", "fp", "fn", "tn", *rates("tp", "fp", F.col("tp") + F.col("fn")),
                          ratio(F.col("tp") + F.col("tn"),
                                F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def rates(tp: str, fp: str, positives) -> list:
    """Precision, recall and F1; a zero denominator gives 0."""
    zero = F.lit(0.0)
    warned = F.col(tp) + F.col(fp)
    return [
        F.coalesce(ratio(tp, warned), zero).alias("precision"),
        F.coalesce(ratio(tp, positives), zero).alias("recall"),
        F.coalesce(ratio(F.lit(2) * F.col(tp), positives + warned), zero).alias("f1"),
    ]


def enough_of_both(histogram: DataFrame, groups: list[str], minimum: int = 5) -> DataFrame:
    """Whether both classes are present with at least ``minimum`` rows each."""
    return histogram.groupBy(*groups).agg(
        (F.least(F.sum("pos"), F.sum("neg")) >= minimum).alias("calibratable")
    )


def reliability_curve(histogram: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width score bin."""
    p = F.col("p")
    n = F.col("pos") + F.col("neg")
    bin_of = F.least(F.floor(p * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    return (
        histogram.groupBy(*groups, bin_of.alias("bin"))
        .agg(F.sum(n).alias("n"), F.sum(p * n).alias("_p"), F.sum("pos").alias("_y"))
        .select(*groups, "bin", "n", ratio("_p", "n").alias("mean_score"), ratio("_y", "n").alias("observed_rate"))
    )
