"""Full rebuild: raw tables -> prepared tables -> model -> predictions and log, published at the end.

Every rebuild writes a version of its own. Readers ask for the published one, which changes only when
the last table of a new version is complete; a rebuild that fails leaves what was there.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.operators.features import Inputs
from coursebeacon.plans.evaluate import weekly_metrics
from coursebeacon.plans.prepare import prepare
from coursebeacon.plans.train import predict, train_sequence
from coursebeacon.sources.models import save_model
from coursebeacon.sources.sinks import append_log, write_predictions, write_table


@dataclass(frozen=True)
class Rebuilt:
    train: str
    test: str
    real: str
    scaler: str
    model: str
    predictions: str
    log: str


def layout(root: str) -> Rebuilt:
    root = root.rstrip("/")
    return Rebuilt(f"{root}/train", f"{root}/test", f"{root}/real", f"{root}/scaler",
                   f"{root}/model", f"{root}/predictions", f"{root}/evaluation_log")


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the current one: one more row in the list of versions, written in one commit."""
    row = spark.createDataFrame([(version,)], "version string").withColumn("published", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/published")


def published(spark: SparkSession, root: str) -> Rebuilt:
    """The tables of the version published last."""
    versions = spark.read.parquet(f"{root.rstrip('/')}/published")
    version = versions.agg(F.max_by("version", F.struct("published", "version"))).first()[0]
    return layout(f"{root.rstrip('/')}/{version}")


def rebuild(spark: SparkSession, inputs: Inputs, root: str, train=train_sequence, run: str = "rebuild",
            mode: str = "risk", **prepare_options) -> Rebuilt:
    """Each stage reads the table the stage before has written; the log is of the model that was trained."""
    version = f"version-{uuid.uuid4().hex}"
    paths = layout(f"{root.rstrip('/')}/{version}")
    prepared = prepare(inputs, **prepare_options)
    write_table(prepared.train, paths.train)
    write_table(prepared.test, paths.test)
    write_table(prepared.real, paths.real)
    write_table(prepared.scaler.table(spark), paths.scaler)
    model, score = train(spark.read.parquet(paths.train))
    save_model(model, paths.model)
    test: DataFrame = spark.read.parquet(paths.test)
    write_predictions(predict(test, score), paths.predictions)
    append_log(weekly_metrics(test, spark.read.parquet(paths.real), model=score, mode=mode), paths.log, run)
    publish(spark, root, version)
    return paths
