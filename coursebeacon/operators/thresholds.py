"""Alert thresholds on the 101-point grid.

Each score falls to the highest grid point it reaches, so the whole sweep is one small aggregate
and a running sum over at most 101 rows per group.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursebeacon.operators.ranking import rates, score_totals

GRID_POINTS = 101
GRID_STEP = 0.01  # grid point i is i * 0.01 in floating point, e.g. 94 -> 0.9400000000000001
DEFAULT_THRESHOLD_INDEX = 50


def grid_value(i: Column) -> Column:
    return i.cast("double") * F.lit(GRID_STEP)


def grid_index(p: Column) -> Column:
    """Index of the highest grid point not above ``p``; -1 below the grid."""
    guess = F.floor(p * F.lit(100.0)).cast("int")
    exact = (
        F.when(p < grid_value(guess), guess - 1)
        .when(p >= grid_value(guess + 1), guess + 1)
        .otherwise(guess)
    )
    return F.greatest(F.lit(-1), F.least(F.lit(GRID_POINTS - 1), exact))


def threshold_sweep(histogram: DataFrame, groups: list[str]) -> DataFrame:
    """TP, FP, precision, recall and F1 at every grid point (theta_idx 0..100) of every group."""
    counts = histogram.groupBy(*groups, grid_index(F.col("p")).alias("theta_idx")).agg(
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")
    )
    grid = score_totals(histogram, groups).select(
        *groups, "positives", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1))).alias("theta_idx")
    )
    above = (
        Window.partitionBy(*groups).orderBy(F.col("theta_idx").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    swept = grid.join(counts, [*groups, "theta_idx"], "left").select(
        *groups, "theta_idx", grid_value(F.col("theta_idx")).alias("theta"), "positives",
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("fp"),
    )
    return swept.select("*", *rates("tp", "fp", F.col("positives")))


@dataclass(frozen=True)
class Strategy:
    """``f1``: best F1. ``precision_floor``: best recall at or above the floor, 0.5 if none.
    ``cost``: best TP - parameter * FP. Ties always go to the lowest threshold."""

    name: str = "f1"
    parameter: float | None = None

    def chosen(self, row: Column) -> Column:
        lowest = -F.col("theta_idx")
        if self.name == "f1":
            return F.max_by(row, F.struct(F.col("f1"), lowest))
        if self.name == "precision_floor":
            floor = 0.8 if self.parameter is None else float(self.parameter)
            order = F.when(F.col("precision") >= floor, F.struct(F.col("recall"), lowest))
        elif self.name == "cost":
            price = 2.0 if self.parameter is None else float(self.parameter)
            order = F.struct(F.col("tp") - F.lit(price) * F.col("fp"), lowest)
        else:
            raise ValueError(f"unknown threshold strategy {self.name!r}")
        fallback = F.max_by(row, F.when(F.col("theta_idx") == DEFAULT_THRESHOLD_INDEX, F.lit(1)))
        return F.coalesce(F.max_by(row, order), fallback)


SWEEP_FIELDS = ["theta_idx", "theta", "tp", "fp", "precision", "recall", "f1"]


def select_thresholds(sweep: DataFrame, groups: list[str], strategy: Strategy) -> DataFrame:
    """The sweep row each group's strategy settles on."""
    row = F.struct(*SWEEP_FIELDS)
    return sweep.groupBy(*groups).agg(strategy.chosen(row).alias("_row")).select(*groups, "_row.*")
