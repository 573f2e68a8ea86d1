"""Running totals and exact quantiles over an ordered key, without a single-task sort.

A window per group would put a whole group into one task. Here the key is cut into buckets that keep
its order: one window runs inside each bucket, one over the bucket totals, and the two are added up.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Buckets of quantiles per doubling of the value.
OCTAVE = 4096


def running_totals(
    counts: DataFrame,
    groups: list[str],
    key: str,
    measures: list[str],
    bucket: Column,
    descending: bool = False,
) -> DataFrame:
    """Adds ``cum_<measure>``, the total up to and including each key, and ``tied_<measure>``, that of
    its key alone. ``bucket`` must not fall as the key rises.
    """
    bucketed = counts.withColumn("_bucket", bucket)
    by = [*groups, "_bucket"]

    def ordered(window, column):
        return window.orderBy(F.col(column).desc() if descending else F.col(column).asc())

    keys = ordered(Window.partitionBy(*by), key)
    inside = keys.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = keys.rangeBetween(Window.currentRow, Window.currentRow)
    before = ordered(Window.partitionBy(*groups), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select(
        *by, *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures]
    )
    local = bucketed.withColumns(
        {f"_in_{m}": F.sum(m).over(inside) for m in measures}
        | {f"tied_{m}": F.sum(m).over(tied) for m in measures}
    )
    return local.join(offsets, by).select(
        *counts.columns,
        *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"tied_{m}" for m in measures],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    groups: list[str],
    probabilities: list[float],
) -> DataFrame:
    """Linearly interpolated quantiles of ``value``, one column per probability.

    Only value counts are ordered, in buckets by sign and size of the value.
    """
    v = F.col("_key")
    counts = (
        df.filter(F.col(value).isNotNull())
        .withColumn("_key", F.col(value).cast("double"))
        .groupBy(*groups, "_key")
        .agg(F.count("*").alias("_n"))
    )
    bucket = F.floor(F.signum(v) * F.log2(F.abs(v) + 1.0) * OCTAVE)
    running = running_totals(counts, groups, "_key", ["_n"], bucket)
    sizes = running.groupBy(*groups).agg(F.max("cum__n").alias("_size"))
    placed = running.join(sizes, groups)
    picks = []
    for i, p in enumerate(probabilities):
        at = (F.col("_size") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("cum__n") > rank) & (F.col("cum__n") - F.col("_n") <= rank)
            picks.append(F.max(F.when(inside, F.col("_key"))).alias(f"_{side}{i}"))
    found = placed.groupBy(*groups).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for i, p in enumerate(probabilities):
        at = (F.col("_size") - 1) * F.lit(float(p))
        part = at - F.floor(at)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * part).alias(f"q{int(round(p * 100))}"))
    return found.select(*groups, F.col("_size").alias("n"), *out)
