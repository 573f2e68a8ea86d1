"""Class-level summaries: KPIs, label means, averages, cross-tab, histogram, box-plot values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import ratio
from coursebeacon.operators.ordered import exact_quantiles
from coursebeacon.schemas import METRICS, SNAPSHOT_NAMES


def class_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_learners"),
        (F.avg("label") * 100.0).alias("pass_rate"),
        F.avg("mean_score").alias("mean_score"),
    )


def simulated_pass_rate(df: DataFrame, score_percent: float, completion_percent: float) -> DataFrame:
    """Pass rate moved by half of the score and completion changes, and its distance to the real one."""
    shift = (float(score_percent) + float(completion_percent)) / 2.0
    rates = df.agg((F.avg("label") * 100.0).alias("pass_rate"))
    return rates.select(
        "pass_rate",
        (F.col("pass_rate") + shift).alias("simulated_pass_rate"),
        F.abs((F.col("pass_rate") + shift) - F.col("pass_rate")).alias("twin_gap"),
    )


def label_metric_means(df: DataFrame, metric: str, simulated: str) -> DataFrame:
    """Mean per label of a metric and of its simulated counterpart in the same row, and the gap."""
    means = df.groupBy("label").agg(F.avg(metric).alias("real_mean"), F.avg(simulated).alias("simulated_mean"))
    return means.withColumn("gap", F.col("simulated_mean") - F.col("real_mean"))


def class_averages(df: DataFrame, simulated_prefix: str = "sim_", metrics: list[str] = METRICS) -> DataFrame:
    """(metric, real_mean, simulated_mean) from one aggregate over the table."""
    row = df.agg(*[F.avg(m).alias(m) for m in metrics],
                 *[F.avg(simulated_prefix + m).alias(simulated_prefix + m) for m in metrics])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("real_mean"),
                 F.col(simulated_prefix + m).alias("simulated_mean"))
        for m in metrics
    ])))


def confusion_table(df: DataFrame) -> DataFrame:
    """Actual against predicted label, absent combinations as 0."""
    return (
        df.groupBy("label").pivot("predicted_label", [0, 1]).agg(F.count(F.lit(1)))
        .na.fill(0)
        .withColumnsRenamed({"0": "predicted_fail", "1": "predicted_pass"})
    )


def histogram(df: DataFrame, value: str, by: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between the extremes; the maximum belongs to the last bin."""
    extremes = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("r"))
    spread = df.select(by, F.col(value).alias("_x")).filter("_x is not null").withColumn("_r", extremes.scalar())
    low, high = F.col("_r")["lo"], F.col("_r")["hi"]
    width = (high - low) / F.lit(float(bins))
    place = F.coalesce(F.try_divide(F.col("_x") - low, width), F.lit(0.0))
    bin_of = F.least(F.floor(place), F.lit(bins - 1)).cast("int")
    return spread.groupBy(by, bin_of.alias("bin")).agg(
        F.count("*").alias("n"),
        F.first(low + bin_of * width).alias("bin_start"),
    )


def box_plot(df: DataFrame, value: str, by: str = "label") -> DataFrame:
    """Minimum, quartiles and maximum per group (q0, q25, q50, q75, q100)."""
    return exact_quantiles(df, value, [by], [0.0, 0.25, 0.5, 0.75, 1.0])


def metric_correlation(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """Pearson correlation, the summary of a scatter plot."""
    grouped = df.groupBy(*([by] if by else []))
    return grouped.agg(F.count("*").alias("n"), F.corr(x, y).alias("correlation"))


def snapshot_means(df: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """Means of the five metrics as logged per cycle; an absent column counts as 0."""
    return df.agg(*[
        (F.avg(m) if m in df.columns else F.max(F.lit(0.0))).alias(out) for m, out in SNAPSHOT_NAMES.items()
    ], *(more or []))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse-frequency weight n / (2 n_c) per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("_total", total).select(
        label, "n", ratio("_total", F.lit(2.0) * F.col("n")).alias("weight")
    )


def with_class_weight(df: DataFrame, label: str = "label", name: str = "class_weight") -> DataFrame:
    """The weight on every row, from one global count read as a scalar."""
    counts = df.agg(F.struct(F.count(F.when(F.col(label) == 1, 1)).alias("p"),
                             F.count(F.when(F.col(label) == 0, 1)).alias("n")).alias("c")).scalar()
    counted = df.withColumn("_c", counts)
    total = F.col("_c")["p"] + F.col("_c")["n"]
    mine = F.when(F.col(label) == 1, F.col("_c")["p"]).otherwise(F.col("_c")["n"])
    both = (F.col("_c")["p"] > 0) & (F.col("_c")["n"] > 0)
    weight = F.when(both, ratio(total, F.lit(2.0) * mine)).otherwise(F.lit(1.0))
    return counted.withColumn(name, weight).drop("_c")
