"""The state of each learner, kept by the stream itself: clicks by week, current risk and flag.

Learners fall into buckets by hash; a bucket is a key of a stateful operator whose state is the table of its
learners' clicks by week, so that Python is called once per bucket and micro-batch, however many learners there
are. Sums do not depend on the order in which records come, so neither does the state; after a restart it goes on
from the checkpoint. Records are summed batch by batch before they are shuffled, so a learner with a third of
the log sends one row per week and batch of records.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coursebeacon.operators.activity import with_week_index
from coursebeacon.schemas import COURSE, MAX_WEEKS

#: Per learner of a bucket, ordered by id: id, clicks of all weeks, last week, number of updates; 64-bit numbers.
STATE = "learners BINARY"
#: A stream that has begun keeps its number of buckets.
BUCKETS = 1024


def _adder(max_weeks: int):
    """Adds the clicks of a micro-batch to the weeks of a bucket's learners and puts out the series of those it touches."""
    width = max_weeks + 3

    def add(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [[part[c].to_numpy(dtype=np.int64) for c in ("id_student", "week_idx", "sum_click")] for part in rows]
        students, weeks, clicks = (np.concatenate(column) for column in zip(*parts))
        known = np.frombuffer(bytes(state.get[0]), dtype=np.int64).reshape(-1, width) if state.exists else np.empty((0, width), np.int64)
        touched = np.unique(students)
        ids = np.union1d(known[:, 0], touched)
        table = np.zeros((len(ids), width), np.int64)
        table[:, 0], table[:, max_weeks + 1] = ids, -1
        table[np.searchsorted(ids, known[:, 0])] = known
        inside = (weeks >= 0) & (weeks < max_weeks)
        at = np.searchsorted(ids, students[inside])
        np.add.at(table, (at, 1 + weeks[inside]), clicks[inside])
        np.maximum.at(table, (at, max_weeks + 1), weeks[inside])
        changed = np.searchsorted(ids, touched)
        table[changed, max_weeks + 2] += 1
        state.update((table.tobytes(),))
        yield pd.DataFrame(table[changed], columns=_columns(max_weeks))

    return add


def _columns(max_weeks: int) -> list[str]:
    """Of a row of the table: weeks as columns of their own, as an array per learner would cost most of the step."""
    return ["id_student", *[f"week_{k}" for k in range(max_weeks)], "last_week", "n_updates"]


def summed(records: DataFrame) -> DataFrame:
    """Clicks per learner and week within each batch of records: less to shuffle, the same sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(["id_student", "week_idx"]).aggregate([("sum_click", "sum")])
            yield from sums.rename_columns(["id_student", "week_idx", "sum_click"]).to_batches()

    return records.select("id_student", "week_idx", "sum_click").mapInArrow(
        run, "id_student BIGINT, week_idx INT, sum_click BIGINT"
    )


def weekly_series(clicks: DataFrame, calendar: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """From a stream of click records, in update mode: the series of every learner that has new records.

    ``calendar`` has the first day of each course. Clicks outside the matrix make a learner known but
    stand in no week; ``last_week`` is -1 as long as there are no others.
    """
    timed = with_week_index(clicks, calendar.select(*COURSE, "min_date")).filter(
        F.col("week_idx").isNotNull() & F.col("id_student").isNotNull() & F.col("sum_click").isNotNull()
    )
    typed = timed.select(F.col("id_student").cast("bigint"), F.col("week_idx").cast("int"), F.col("sum_click").cast("bigint"))
    bucket = F.pmod(F.xxhash64("id_student"), F.lit(BUCKETS)).cast("int")
    columns = _columns(max_weeks)
    rows = summed(typed).withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _adder(max_weeks), ", ".join(f"{c} BIGINT" for c in columns), STATE, "update", GroupStateTimeout.NoTimeout
    )
    weeks = F.array(*columns[1 : max_weeks + 1])
    return rows.select("id_student", weeks.alias("weeks"), F.col("last_week").cast("int"), "n_updates")


@dataclass(frozen=True)
class WeeklyRisk:
    """Fitted beforehand: the range of the prefix means of each week, and the threshold of each week."""

    ranges: tuple[tuple[float, float], ...]
    thetas: tuple[float, ...]

    @staticmethod
    def of_table(table: DataFrame) -> "WeeklyRisk":
        """From rows (week, low, high, theta_t), one for each week from 0 on."""
        rows = {r["week"]: r for r in table.select("week", "low", "high", "theta_t").collect()}
        if sorted(rows) != list(range(len(rows))):
            raise ValueError("one row is needed for each week from 0 on")
        ordered = [rows[k] for k in range(len(rows))]
        return WeeklyRisk(tuple((r["low"], r["high"]) for r in ordered), tuple(r["theta_t"] for r in ordered))

    def _of_week(self, values) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("last_week"))

    def current(self, series: DataFrame) -> DataFrame:
        """Series with ``prob_risk`` in the learner's last week and the flag against that week's threshold.

        A learner without a week yet has neither risk nor flag.
        """
        observed = F.slice("weeks", 1, F.col("last_week") + 1)
        mean = F.aggregate(observed, F.lit(0.0), lambda s, x: s + x) / (F.col("last_week") + 1)
        low = self._of_week(r[0] for r in self.ranges)
        span = self._of_week((r[1] - r[0]) if r[1] != r[0] else 1.0 for r in self.ranges)
        risk = F.lit(1.0) - (mean - low) / span
        known = F.when(F.col("last_week") >= 0, risk)
        return series.withColumn("prob_risk", known).withColumn("at_risk", known >= self._of_week(self.thetas))


def series_of(weekly: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """The same series from a batch table (id_student, week_idx, sum_click): id_student, weeks, last_week."""
    inside = F.col("week_idx").between(0, max_weeks - 1)
    sums = [F.coalesce(F.sum(F.when(F.col("week_idx") == k, F.col("sum_click"))), F.lit(0)) for k in range(max_weeks)]
    return weekly.groupBy("id_student").agg(
        F.array(*sums).alias("weeks"), F.coalesce(F.max(F.when(inside, F.col("week_idx"))), F.lit(-1)).alias("last_week")
    )


def mean_ranges(series: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """(week, low, high): the range over learners of the mean of weeks 0 to ``week``."""
    means = F.transform(
        F.sequence(F.lit(1), F.lit(max_weeks)),
        lambda n: F.aggregate(F.slice("weeks", 1, n), F.lit(0.0), lambda s, x: s + x) / n,
    )
    each = series.select(F.posexplode(means).alias("week", "mean"))
    return each.groupBy("week").agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
