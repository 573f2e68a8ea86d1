"""Small column expressions used across the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    """NaN sorts above every number in Spark, so it is turned into NULL when data enters."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def student_uid() -> Column:
    return F.concat_ws("_", F.col("id_student").cast("string"), "code_module", "code_presentation")


def week_index(date: Column | str, first_day: Column | str) -> Column:
    """Whole weeks since the first day of the course; ``floor``, because offsets may be negative."""
    return F.floor((col(date) - col(first_day)) / F.lit(7)).cast("int")


def clamp(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    x = col(x)
    out = x
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    # least and greatest skip NULL, a clamp keeps it
    return F.when(x.isNotNull(), out)


def min_max(x: Column | str, low: Column | str, high: Column | str) -> Column:
    """Min-max scaling; a zero range counts as 1."""
    span = col(high) - col(low)
    return (col(x) - col(low)) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def percent_change(x: Column | str, percent: Column | float) -> Column:
    p = percent if isinstance(percent, Column) else F.lit(float(percent))
    return col(x) * (F.lit(1.0) + p / F.lit(100.0))


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that gives NULL on a zero denominator (ANSI mode would fail)."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def deviation_percent(x: Column | str, mean: Column | str) -> Column:
    return ratio(col(x) - col(mean), mean) * F.lit(100.0)


def label_at(p: Column | str, cut: Column | float = 0.5, inclusive: bool = True) -> Column:
    c = cut if isinstance(cut, Column) else F.lit(float(cut))
    return ((col(p) >= c) if inclusive else (col(p) > c)).cast("int")


def risk_of(p: Column | str, missing: float = 0.5) -> Column:
    """Risk from pass probability; a learner without prediction gets the neutral value."""
    return F.lit(1.0) - F.coalesce(col(p), F.lit(float(missing)))


def blend(weight: Column | float, a: Column | str, b: Column | str) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * col(a) + (F.lit(1.0) - w) * col(b)


def model_score(auc_pr: Column | str, auc_roc: Column | str) -> Column:
    """Composite used to rank models; an undefined area counts as 0."""
    zero = F.lit(0.0)
    return F.lit(0.6) * F.coalesce(col(auc_pr), zero) + F.lit(0.4) * F.coalesce(col(auc_roc), zero)


def hash_below(key: Column | str, fraction: float, seed: int | str) -> Column:
    """True for a stable pseudo-random ``fraction`` of the keys.

    The decision hangs on the key alone: no shuffle, the same rows on every retry and under
    every partitioning.
    """
    if fraction >= 1.0:
        return F.lit(True)
    bound = format(min(int(round(fraction * 2**32)), 2**32 - 1), "08x")
    return hash_prefix(key, seed) < F.lit(bound)


def hash_prefix(key: Column | str, seed: int | str) -> Column:
    return F.substring(F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8)


def format_timestamp(ts: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(col(ts), pattern)


def round_half_even(x: Column | str, digits: int = 4) -> Column:
    return F.bround(col(x), digits)


def lookup(key: Column | str, table: dict, default=None) -> Column:
    """Value of a small fixed table, ``default`` for an unknown key."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    found = F.try_element_at(pairs, col(key))
    return found if default is None else F.coalesce(found, F.lit(default))
