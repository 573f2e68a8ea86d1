"""Queries over evaluation and snapshot logs.

Rows of a distributed table have no order of their own, so every "last" names its order column.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursebeacon.schemas import DEFAULT_RISK_THRESHOLD

# First and last week of the three stages of a term.
TERM_STAGES = [("early", 0, 6), ("middle", 7, 12), ("late", 13, 19)]


def latest_per(log: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """The last row of each group."""
    by = [order] if isinstance(order, str) else order
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return log.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def latest_row(log: DataFrame, order: list[str]) -> DataFrame:
    newest = F.max_by(F.struct(*log.columns), F.struct(*order)).alias("_row")
    return log.agg(newest).filter("_row is not null").select("_row.*")


def live_view(log: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """What a monitor shows of a running log: how many rows there are, and those ``columns`` of the last one that it has."""
    newest = latest_row(log, order)
    size = log.agg(F.count("*").alias("n_snapshots"))
    return existing(newest.join(size, F.lit(True)), ["n_snapshots", *columns])


def latest_threshold(log: DataFrame | None, order: str = "timestamp",
                     default: float = DEFAULT_RISK_THRESHOLD) -> Column:
    """Threshold of the latest row of the latest week as a scalar; the default without one."""
    if log is None:
        return F.lit(default)
    newest = log.agg(F.max_by("theta_t", F.struct("week", order)).alias("theta_t"))
    return F.coalesce(newest.scalar(), F.lit(default))


def with_week(log: DataFrame, run: str = "run", order: str = "timestamp") -> DataFrame:
    """Week column repaired: rows of a run whose weeks are missing or unreadable are numbered by time."""
    place = (F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1).cast("int")
    if "week" not in log.columns:
        return log.withColumn("week", place)
    week = F.expr("try_cast(week as int)")
    dirty = F.max(week.isNull()).over(Window.partitionBy(run))
    return log.withColumn("week", F.when(dirty, place).otherwise(week))


def max_hits_per_week(log: DataFrame) -> DataFrame:
    return log.groupBy("week").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))


def stage_means(log: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means over each stage of the term and over the whole of it."""
    stage = F.lit(None).cast("string")
    for name, first, last in reversed(TERM_STAGES):
        stage = F.when(F.col("week").between(first, last), F.lit(name)).otherwise(stage)
    staged = log.withColumn("stage", stage).filter("stage is not null")
    # one row per log row and level instead of a second pass for the total
    levels = staged.withColumn("stage", F.explode(F.array("stage", F.lit("all"))))
    return levels.groupBy(*keys, "stage").agg(*[F.avg(m).alias(m) for m in metrics])


def union_runs(runs: dict[str, DataFrame | None]) -> DataFrame:
    """Evaluation runs under one another with a ``run`` column; absent ones are left out."""
    present = [df.withColumn("run", F.lit(name)) for name, df in runs.items() if df is not None]
    if not present:
        raise ValueError("no run to compare")
    out = present[0]
    for df in present[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def best_variants(last_rows: DataFrame, name: str = "variant", ordinal: str = "ordinal") -> DataFrame:
    """Winner per criterion; the first listed variant wins a tie."""
    first = -F.col(ordinal)

    def best(metric):
        return F.max_by(F.struct(F.col(name).alias("variant"), F.col(metric).cast("double").alias("value")),
                        F.struct(F.col(metric), first))

    fewest = F.min_by(F.struct(F.col(name).alias("variant"), F.col("fp").cast("double").alias("value")),
                      F.struct(F.col("fp"), F.col(ordinal)))
    winners = last_rows.agg(
        best("auc_pr").alias("auc_pr"), best("precision").alias("precision"),
        best("f1").alias("f1"), fewest.alias("fewest_fp"),
    )
    criteria = [("highest_auc_pr", "auc_pr"), ("highest_precision", "precision"),
                ("highest_f1", "f1"), ("fewest_fp", "fewest_fp")]
    return winners.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("criterion"), F.col(c)["variant"].alias("variant"),
                 F.col(c)["value"].alias("value"))
        for label, c in criteria
    ])))


def log_series(log: DataFrame, at: str, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """Chosen columns as (at, series, value), leaving out those the log lacks."""
    present = [c for c in columns if c in log.columns]
    keep = [at, *[c for c in (extra or []) if c in log.columns]]
    cast = log.select(*keep, *[F.col(c).cast("double").alias(c) for c in present])
    return cast.unpivot(keep, present, "series", "value")


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])
