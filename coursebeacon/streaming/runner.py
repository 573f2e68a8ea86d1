"""Running a stream into a table that survives retries.

Each micro-batch overwrites its own ``batch_id=<n>`` folder, so a batch that is run again after a
failure leaves the same files. Readers take the newest value per key.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.session import work_path

BatchWriter = Callable[[DataFrame, int], None]


def batch_table(out: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> BatchWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def start(stream: DataFrame, writer: BatchWriter, checkpoint: str, mode: str = "append",
          interval: str | None = None):
    """A running query; without an interval it works off what is there and ends."""
    query = stream.writeStream.outputMode(mode).foreachBatch(writer).option("checkpointLocation", checkpoint)
    query = query.trigger(processingTime=interval) if interval else query.trigger(availableNow=True)
    return query.start()


def run_available(spark: SparkSession, stream: DataFrame, writer: BatchWriter, mode: str = "append",
                  checkpoint: str | None = None) -> None:
    start(stream, writer, checkpoint or work_path(spark, "stream-state"), mode).awaitTermination()


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(out)


def newest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Final value per key of a table written in update mode."""
    values = [c for c in batches.columns if c not in (*keys, "batch_id")]
    row = F.max_by(F.struct(*values), "batch_id").alias("_row")
    return batches.groupBy(*keys).agg(row).select(*keys, "_row.*")
