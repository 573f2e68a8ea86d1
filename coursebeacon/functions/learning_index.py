"""Composite learning index and the probability used when no model is at hand."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import col

# Weight and full-scale value of each metric.
WEIGHTS = {
    "mean_score": 0.3,
    "completion": 0.25,
    "n_submitted": 0.2,
    "total_clicks": 0.15,
    "active_weeks": 0.1,
}
FULL_SCALE = {
    "mean_score": 100.0,
    "completion": 1.0,
    "n_submitted": 10.0,
    "total_clicks": 20000.0,
    "active_weeks": 20.0,
}
# Steepness and midpoint of the fallback curve.
FALLBACK_SLOPE = 3.5
FALLBACK_MIDPOINT = 0.5


def normalised(metric: str, value: Column | str | None = None) -> Column:
    """A metric as a share of its full scale."""
    return col(value if value is not None else metric) / F.lit(FULL_SCALE[metric])


def _weighted(values: dict[str, Column]) -> Column:
    parts = [F.lit(WEIGHTS[m]) * values[m] for m in WEIGHTS]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def learning_index(columns: dict[str, Column | str] | None = None) -> Column:
    """0-100 for ordinary learners, not clamped; missing metrics count as 0."""
    columns = columns or {}
    return F.lit(100.0) * _weighted(
        {m: F.coalesce(normalised(m, columns.get(m)), F.lit(0.0)) for m in WEIGHTS}
    )


def fallback_probability(columns: dict[str, Column | str] | None = None) -> Column:
    """Pass probability from the metrics alone; here clicks count at most once their full scale."""
    columns = columns or {}
    shares = {m: F.coalesce(normalised(m, columns.get(m)), F.lit(0.0)) for m in WEIGHTS}
    shares["total_clicks"] = F.least(shares["total_clicks"], F.lit(1.0))
    s = _weighted(shares)
    return F.lit(1.0) / (
        F.lit(1.0) + F.exp(F.lit(-FALLBACK_SLOPE) * (s - F.lit(FALLBACK_MIDPOINT)))
    )
