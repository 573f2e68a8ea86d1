"""Train/test membership."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursebeacon.functions.scalars import hash_below, hash_prefix
from coursebeacon.session import staged

TEST_FRACTION = 0.2
SPLIT_SEED = 42


def with_split(df: DataFrame, fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
               key: str = "student_uid") -> DataFrame:
    """``test`` for a stable fraction of the keys, ``train`` otherwise; a narrow operator."""
    is_test = hash_below(key, fraction, seed)
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def with_exact_split(df: DataFrame, fraction: float = TEST_FRACTION, seed: int | str = SPLIT_SEED,
                     key: str = "student_uid", label: str | list[str] = "label", written: bool = False) -> DataFrame:
    """Like ``with_split``, but each label gives exactly ``round(fraction * n)`` test rows.

    Rows are ranked by hash within a label, or within each combination of several columns. Counts of ranges
    of the hash (65,536 at most) name the range in which the label's test rows end; only its rows are put in
    order, all others are told by their range where they lie. ``written`` says that ``df`` is a written table;
    it is read three times.
    """
    strata = [label] if isinstance(label, str) else label
    df = df if written else staged(df, "split-input")
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*strata, "_h"]])
    hashed = df.withColumn("_h", F.conv(hash_prefix(key, seed), 16, 10).cast("bigint")).filter(known)
    hashed = hashed.withColumn("_range", F.floor(F.col("_h") / F.lit(2.0**16)))
    counts = hashed.groupBy(*strata, "_range").agg(F.count("*").alias("_n"))
    up_to = Window.partitionBy(*strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("_cum", F.sum("_n").over(up_to))
    quota = F.round(F.max("_cum").over(Window.partitionBy(*strata)) * F.lit(float(fraction)))
    last = running.withColumn("_take", quota - (F.col("_cum") - F.col("_n"))).filter("_take >= 0").groupBy(*strata).agg(
        F.max("_range").alias("_last"), F.min("_take").alias("_take")
    )
    told = hashed.join(last, strata)
    # rows sharing one hash value are collisions of a 32-bit hash, told apart by their key
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))
    edge = told.filter("_range = _last").withColumn("_in", place <= F.col("_take"))
    rest = told.filter("_range <> _last").withColumn("_in", F.col("_range") < F.col("_last"))
    both = rest.unionByName(edge).withColumn("split", F.when(F.col("_in"), "test").otherwise("train"))
    return both.drop("_h", "_range", "_last", "_take", "_in")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n_rows"))
