"""Writers. Every write goes through the commit protocol: readers never see half a table.

A table must not be overwritten while it is being read; a job that updates tables others read writes
the next version to a new path and publishes it when all of it is there (``plans/rebuild.py``).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import round_half_even
from coursebeacon.schemas import EVALUATION_NAMES, EXTRACT_NAMES, METRICS

PREDICTION_COLUMNS = ["student_uid", "predicted_label", "prob_pass"]


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    write_table(predictions.select(*PREDICTION_COLUMNS), path)


def append_log(rows: DataFrame, path: str, run: str, at: Column | None = None) -> None:
    """Append one run's rows, stamped, below their own ``run`` partition."""
    stamped = rows.drop("run", "timestamp").withColumns(
        {"timestamp": F.current_timestamp() if at is None else at, "run": F.lit(run)}
    )
    stamped.write.mode("append").partitionBy("run").parquet(path)


def append_history(requests: DataFrame, path: str, at: Column | None = None) -> None:
    """Simulated requests as history rows; probabilities keep four digits (half to even)."""
    rows = requests.select(
        (F.current_timestamp() if at is None else at).alias("timestamp"), F.col("student_uid").alias("id_student"),
        *[F.col(f"in_{m}").cast("double").alias(m) for m in METRICS],
        round_half_even("prob_pass").alias("prob_pass"),
        round_half_even(F.lit(1.0) - F.col("prob_pass")).alias("prob_risk"),
    )
    rows.write.mode("append").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A result set as CSV part files with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_status(status: DataFrame, path: str) -> None:
    """The one-row status document as JSON."""
    status.coalesce(1).write.mode("overwrite").json(path)


def to_extract_names(df: DataFrame) -> DataFrame:
    """Back to the column names of existing extracts and logs."""
    back = {v: k for names in (EXTRACT_NAMES, EVALUATION_NAMES) for k, v in names.items()}
    return df.withColumnsRenamed(back)
