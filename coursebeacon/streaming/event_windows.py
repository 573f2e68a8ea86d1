"""Weekly windows of event time with a watermark: bounded state, and no late record lost.

Users and event types fall into buckets by hash; a bucket is a key of a stateful processor, so that
the engine calls Python once per bucket and micro-batch, however many users there are. Each open
window of a bucket has the sums of its users in the state, as one Arrow table, and a timer at its
end; when the watermark passes that end, the window leaves the state. A record that comes after that
is late: it goes out in rows of its own, which the writer keeps in a table beside the windows and the
reader adds again.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from coursebeacon.streaming import runner

WEEK_MS = 7 * 24 * 3600 * 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of users whose windows are kept together. A stream that has begun keeps its number.
BUCKETS = 256
#: A user and type, nulls told apart by flags: pandas has no whole numbers with nulls.
KEY = ["user_id", "no_user", "event_type", "no_type"]
SUMS = ["n_events", "total_value"]
ROWS = (
    "user_id BIGINT, no_user BOOLEAN, event_type STRING, no_type BOOLEAN, window_ms BIGINT, n_events BIGINT, "
    "total_value DOUBLE, late BOOLEAN, open_windows INT"
)


def _summed(parts: list[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """Sums of rows under one another; a value that is not a number adds nothing."""
    return pd.concat(parts).groupby(by, sort=False, as_index=False)[SUMS].sum()


def _packed(sums: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(sums[[*KEY, *SUMS]], preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class OpenWindows(StatefulProcessor):
    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "window_ms BIGINT", "packed BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = _summed([_summed([part], [*KEY, "window_ms"]) for part in rows], [*KEY, "window_ms"])
        found["late"] = found["window_ms"] + self.width <= timerValues.getCurrentWatermarkInMs()
        known = {window: _unpacked(packed) for (window,), (packed,) in self.sums.iterator()}
        out = [found[found["late"]]]
        for window, new in found[~found["late"]].groupby("window_ms"):
            if window in known:
                sums = _summed([known[window], new[[*KEY, *SUMS]]], KEY)
                out.append(new.drop(columns=SUMS).merge(sums, on=KEY))
            else:
                sums = new[[*KEY, *SUMS]]
                self.handle.registerTimer(int(window) + self.width)
                out.append(new)
            known[window] = sums
            self.sums.updateValue((int(window),), (_packed(sums),))
        if known:
            still_open = pd.concat([sums[KEY] for sums in known.values()]).groupby(KEY, as_index=False).size()
            all_rows = pd.concat(out).merge(still_open.rename(columns={"size": "open_windows"}), on=KEY, how="left")
        else:
            all_rows = pd.concat(out).assign(open_windows=0)
        all_rows["open_windows"] = all_rows["open_windows"].fillna(0).astype("int32")
        yield all_rows[[c.split()[0] for c in ROWS.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.removeKey((expiredTimerInfo.getExpiryTimeInMs() - self.width,))
        yield from ()

    def close(self) -> None:
        pass


def event_windows(events: DataFrame, delay: str, width: int = WEEK_MS) -> DataFrame:
    """From a stream of (user_id, event_type, ts, value): sums of windows, in update mode, and of late records.

    Windows start at multiples of ``width`` milliseconds since 1970. A row that is not late has the
    window's sums so far, a late one those of the late records of its micro-batch. Records without
    time are left out, as windows have no place for them; a null value adds nothing.
    """
    timed = events.select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col("value"), F.lit(0.0)).alias("value")
    ).filter("ts IS NOT NULL").withWatermark("ts", delay)
    at = F.unix_millis("ts")
    # the time goes on as a number: the engine would drop late rows of a column that has the watermark
    plain = timed.select(
        F.coalesce(F.col("user_id").cast("long"), F.lit(0)).alias("user_id"), F.col("user_id").isNull().alias("no_user"),
        F.coalesce("event_type", F.lit("")).alias("event_type"), F.col("event_type").isNull().alias("no_type"),
        (at - F.pmod(at, F.lit(width))).alias("window_ms"),
        F.lit(1).cast("long").alias("n_events"), F.col("value").cast("double").alias("total_value"),
        F.pmod(F.xxhash64("user_id", "event_type"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    sums = plain.groupBy("bucket").transformWithStateInPandas(
        OpenWindows(width), outputStructType=ROWS, outputMode="Update", timeMode="EventTime"
    )
    return sums.select(
        F.when(~F.col("no_user"), F.col("user_id")).alias("user_id"), F.when(~F.col("no_type"), F.col("event_type")).alias("event_type"),
        "window_ms", "n_events", "total_value", "late", "open_windows",
    )


def write_windows(spark: SparkSession, events: DataFrame, out: str, delay: str, checkpoint: str | None = None, width: int = WEEK_MS) -> None:
    """Works off the stream: windows below ``out``/windows, late records below ``out``/late."""
    windows, late = runner.batch_table(f"{out}/windows"), runner.batch_table(f"{out}/late")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            windows(batch.filter("NOT late").drop("late"), batch_id)
            late(batch.filter("late").drop("late", "open_windows"), batch_id)
        finally:
            batch.unpersist()

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # maps and timers need it; a query keeps the provider it began with
    try:
        runner.run_available(spark, event_windows(events, delay, width), write, "update", checkpoint)
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """(user_id, event_type, week_start, n_events, total_value, n_late): windows with the late records added."""
    keys = ["user_id", "event_type", "window_ms"]
    closed = runner.newest(runner.read_batches(spark, f"{out}/windows").drop("open_windows"), keys)
    late = runner.read_batches(spark, f"{out}/late").drop("batch_id").withColumn("n_late", F.col("n_events"))
    both = closed.withColumn("n_late", F.lit(0).cast("long")).unionByName(late)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_events", "total_value", "n_late")]).select(
        "user_id", "event_type", F.timestamp_millis("window_ms").alias("week_start"), "n_events", "total_value", "n_late"
    )
