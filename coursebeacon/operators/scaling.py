"""Per-week min-max scaling of the click matrix.

Fitting is one global aggregate (one row per partition is shuffled). The fitted ranges, two numbers
per week, become literals of the scaling expressions, so scaling stays plain compiled arithmetic.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.schemas import MAX_WEEKS, SCALER, week_columns


def column_ranges(df: DataFrame, columns: list[str]) -> list[tuple[float, float]]:
    """(min, max) of each column, from a single row."""
    row = df.agg(*[F.expr(f"double({f}({c}))") for c in columns for f in ("min", "max")]).first()
    return [(row[2 * i], row[2 * i + 1]) for i in range(len(columns))]


def scaler_table(df: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """The fitted ranges as rows (week, min, max); a maximum of 0 counts as 1."""
    ranges = [
        f"struct({k} as week, double(min({c})) as min, if(max({c}) = 0, 1D, double(max({c}))) as max)"
        for k, c in enumerate(week_columns(max_weeks))
    ]
    return df.agg(F.expr(f"array({', '.join(ranges)})").alias("ranges")).selectExpr("inline(ranges)")


@dataclass(frozen=True)
class ClickScaler:
    """(min, max) per week; None where a stored table lacks the week."""

    ranges: tuple[tuple[float, float] | None, ...]

    @staticmethod
    def fit(df: DataFrame, max_weeks: int = MAX_WEEKS) -> "ClickScaler":
        return ClickScaler._of_rows(scaler_table(df, max_weeks).collect(), max_weeks)

    @staticmethod
    def of_table(table: DataFrame, max_weeks: int = MAX_WEEKS) -> "ClickScaler":
        """From a stored table with one row per week; a week it lacks is scaled by the range of the
        column it is applied to. A week that is missing, negative or stored twice is an error."""
        stored = table.groupBy("week").agg(
            F.count("*").alias("n"), F.min("min").alias("min"), F.max("max").alias("max")
        )
        wrong = (F.col("n") > 1) | F.col("week").isNull() | (F.col("week") < 0)
        if not stored.filter(wrong).isEmpty():
            raise ValueError("a scaler table needs one row for each week from 0 on")
        return ClickScaler._of_rows(stored.filter(F.col("week") < max_weeks).collect(), max_weeks)

    @staticmethod
    def _of_rows(rows: list, max_weeks: int) -> "ClickScaler":
        known = {r["week"]: (0.0 if r["min"] is None else r["min"], 1.0 if r["max"] is None else r["max"]) for r in rows}
        return ClickScaler(tuple(known.get(k) for k in range(max_weeks)))

    def transform(self, df: DataFrame) -> DataFrame:
        known = dict(zip(week_columns(len(self.ranges)), self.ranges))
        absent = [c for c, r in known.items() if r is None]
        if absent:
            own = column_ranges(df, absent)
            known |= {c: (0.0, 1.0) if low is None else (low, high) for c, (low, high) in zip(absent, own)}
        return df.withColumns({c: scaled(c, low, high) for c, (low, high) in known.items()})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, lo, hi) for k, (lo, hi) in ((k, r) for k, r in enumerate(self.ranges) if r is not None)]
        return spark.createDataFrame(rows, SCALER)


def scaled(x: str, low: float, high: float) -> Column:
    """``x`` scaled by fitted bounds; a zero range counts as 1."""
    span = high - low if high != low else 1.0
    return F.expr(f"({x} - {float(low)!r}D) / {float(span)!r}D")


def mask_future(df: DataFrame, t: int, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Weeks after ``t`` become 0, as if not yet observed."""
    return df.withColumns({c: F.expr("0D") for c in week_columns(max_weeks)[t + 1:]})


def every_prefix(df: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Every row once per week ``week`` with the later weeks masked."""
    each = df.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(max_weeks - 1))))
    return each.withColumns({
        c: F.expr(f"if(week >= {k}, {c}, 0D)")
        for k, c in enumerate(week_columns(max_weeks))
    })
