"""Model-free weekly score: mean of the weeks observed so far, min-max scaled over learners."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.operators.scaling import column_ranges, scaled
from coursebeacon.schemas import MAX_WEEKS, week_columns


def prefix_means(df: DataFrame, keep: list[str], max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Column ``m<t>``: mean of weeks 0..t. Plain arithmetic on the wide row, no shuffle."""
    names = week_columns(max_weeks)
    means = [f"({' + '.join(names[:t + 1])}) / {t + 1}D as m{t}" for t in range(max_weeks)]
    return df.selectExpr(*keep, *means)


def proxy_scores(df: DataFrame, keep: list[str], max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Long table (keep, week, score) for all prefixes at once.

    The extremes of each prefix come from one global aggregate; learners are not shuffled.
    """
    means = prefix_means(df, keep, max_weeks)
    names = [f"m{t}" for t in range(max_weeks)]
    ranges = column_ranges(means, names)
    if ranges[0][0] is None:  # no rows at all
        ranges = [(0.0, 1.0)] * max_weeks
    scores = F.array(*[scaled(m, lo, hi) for m, (lo, hi) in zip(names, ranges)])
    return means.select(*keep, F.posexplode(scores).alias("week", "score"))
