"""Upkeep of tables that a stream writes as one folder per micro-batch.

Compaction merges complete batches into one folder and then says so in a manifest, one more row
written in one commit. Readers take the newest row: its folder, and the batches it does not cover. A
covered batch that is run again writes its folder anew, but no reader looks there any more, so it
cannot count twice. A compaction that ends before its row is written leaves a folder nobody reads.
"""

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Version:
    """What readers see: ``folder`` holds the batches up to ``upto``."""

    number: int = 0
    upto: int = -1
    folder: str | None = None


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifest(out: str) -> str:
    return f"{out.rstrip('/')}.manifest"


def versions(spark: SparkSession, out: str) -> list[Version]:
    """All versions, the newest first; of two with one number the one published last."""
    store, path = _store(spark, _manifest(out))
    if not store.exists(path):
        return []
    try:
        rows = spark.read.parquet(_manifest(out)).orderBy(F.col("number").desc(), F.col("published").desc(), "folder").collect()
    except AnalysisException:  # the first row is being written
        return []
    return [Version(r["number"], r["upto"], r["folder"]) for r in rows]


def current(spark: SparkSession, out: str) -> Version:
    return next(iter(versions(spark, out)), Version())


def complete_batches(spark: SparkSession, out: str) -> list[int]:
    """Ids of the batches whose folder is written whole."""
    store, path = _store(spark, out)
    if not store.exists(path):
        return []
    names = [status.getPath().getName() for status in store.listStatus(path)]
    ids = [int(name.split("=")[1]) for name in names if name.startswith("batch_id=")]
    done = [i for i in ids if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch_id={i}/_SUCCESS"))]
    return sorted(done)


def _batches(spark: SparkSession, out: str, ids: list[int]) -> DataFrame:
    return spark.read.option("basePath", out).parquet(*[f"{out}/batch_id={i}" for i in ids])


def read_table(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """All rows, merged or not, with batch_id; ``upto`` leaves later batches out."""
    version = current(spark, out)
    ids = [i for i in complete_batches(spark, out) if i > version.upto and (upto is None or i <= upto)]
    parts = [spark.read.parquet(version.folder)] if version.folder else []
    parts += [_batches(spark, out, ids)] if ids else []
    if not parts:
        raise ValueError(f"no batch in {out}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def merge_sums(keys: list[str]) -> Merge:
    """For tables whose other columns add up."""

    def merge(rows: DataFrame) -> DataFrame:
        sums = [c for c in rows.columns if c not in (*keys, "batch_id")]
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.max("batch_id").alias("batch_id"))

    return merge


def merge_newest(keys: list[str]) -> Merge:
    """For tables in update mode: the newest row per key."""

    def merge(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        newest = F.max_by(F.struct(*values), "batch_id").alias("_row")
        return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")

    return merge


def write_merged(spark: SparkSession, out: str, merge: Merge, keep: int = 1) -> Version | None:
    """First step: complete batches, all but the newest ``keep`` (they may be run again), in a folder of their own."""
    version = current(spark, out)
    ids = [i for i in complete_batches(spark, out) if i > version.upto]
    ids = ids[: len(ids) - keep]
    if not ids:
        return None
    folder = f"{out.rstrip('/')}.merged/version={version.number + 1}-{uuid.uuid4().hex}"
    merge(read_table(spark, out, ids[-1])).write.parquet(folder)
    return Version(version.number + 1, ids[-1], folder)


def publish(spark: SparkSession, out: str, version: Version) -> None:
    """Second step: from here on readers see the merged folder."""
    row = spark.createDataFrame([(version.number, version.upto, version.folder)], "number long, upto long, folder string")
    row.withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(_manifest(out))


def clean(spark: SparkSession, out: str) -> int:
    """Third step: removes what only versions before the last one need, so that a reader that has just
    looked at the manifest still finds its files. The number of folders removed.
    """
    known = versions(spark, out)
    if len({v.number for v in known}) < 2:
        return 0
    newest = known[0]
    previous = next(v for v in known if v.number < newest.number)
    store, path = _store(spark, out)
    gone = [f"{out}/batch_id={i}" for i in complete_batches(spark, out) if i <= previous.upto]
    gone += [v.folder for v in known if v.number < previous.number]
    return sum(bool(store.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)) for folder in gone)


def compact(spark: SparkSession, out: str, merge: Merge, keep: int = 1) -> bool:
    """All three steps; whether there was something to merge."""
    version = write_merged(spark, out, merge, keep)
    if version is None:
        return False
    publish(spark, out, version)
    clean(spark, out)
    return True
