"""The live loop: re-score changed learners, log snapshots and status, raise alerts."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.functions.learning_index import fallback_probability
from coursebeacon.functions.scalars import format_timestamp, label_at
from coursebeacon.operators.overview import snapshot_means
from coursebeacon.operators.scenario import Scenario, apply_scenario
from coursebeacon.sources.sinks import PREDICTION_COLUMNS

POLL_INTERVAL = "5 seconds"
# Files of a micro-batch, so that a backlog is worked off in parts.
FILES_PER_TRIGGER = 64
FILE_TIME = "file_time"


def watch_table(spark: SparkSession, path: str, schema, files_per_trigger: int = FILES_PER_TRIGGER,
                pattern: str | None = None, file_time: bool = False) -> DataFrame:
    """New files of a parquet folder as a stream, if asked for with the time each file was changed."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.parquet(path)
    if file_time:
        rows = rows.select("*", F.col("_metadata.file_modification_time").alias(FILE_TIME))
    return rows


def rescore(learners: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Predictions of a batch or stream of learners; the label cut is above 0.5.

    ``model`` is fitted beforehand, on training rows; it only scores here.
    """
    scored = learners.withColumn("prob_pass", fallback_probability()) if model is None else model(learners)
    return scored.withColumn("predicted_label", label_at("prob_pass", inclusive=False)).select(*PREDICTION_COLUMNS)


def snapshot_writer(log: str, status: str, scenario: Scenario) -> Callable[[DataFrame, int], None]:
    """Per micro-batch: scenario applied, one snapshot row and the status document.

    The batch is read once; the status comes from the written snapshot. ``test_csv_mtime`` is the
    time in seconds at which the newest file of the batch was changed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = apply_scenario(batch, scenario)
        more = [F.count("*").alias("rows"), (F.max(F.col(FILE_TIME).cast("double")) if FILE_TIME in batch.columns
                                             else F.lit(None).cast("double")).alias("test_csv_mtime")]
        stamped = snapshot_means(changed, more).select(
            F.current_timestamp().alias("timestamp"), F.lit(scenario.name).alias("scenario"), "*"
        )
        stamped.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        document = batch.sparkSession.read.schema(stamped.schema).parquet(f"{log}/batch_id={batch_id}").select(
            format_timestamp("timestamp").alias("timestamp"), "scenario",
            F.lit(scenario.fraction).alias("affected_fraction"), "rows", "test_csv_mtime",
        )
        document.write.mode("overwrite").json(f"{status}/batch_id={batch_id}")

    return write


def alerts(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stream-static join of risk per week with the week's threshold.

    ``thresholds`` has one row per week.
    """
    return scores.join(thresholds.select("week", "theta_t"), "week").withColumn(
        "alert", F.coalesce(F.col("prob_risk") >= F.col("theta_t"), F.lit(False))
    )
