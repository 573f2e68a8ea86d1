"""Alerts from raw clicks while they come in: the batch score against the week's threshold, kept current.

The stream's state gives the series of every learner with new clicks. What scales them (the range of
each week's clicks over all enrolments, and that of each prefix mean over the rows that are scored)
moves with the data, so it is computed anew from the series, never from the log, and kept by
micro-batch. Scores are put out again where they can have changed: those of learners with new clicks,
and all of a week whose scale has moved. Rows of a week from before it was last put out whole count no more, so
readers leave them out, and merge only weeks that have rows of their own since then.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.operators.proxy import prefix_means
from coursebeacon.operators.scaling import ClickScaler, column_ranges, scaled
from coursebeacon.schemas import MAX_WEEKS, week_columns
from coursebeacon.session import staged
from coursebeacon.streaming import batch_store, runner, twin

#: ``since`` is the last micro-batch that put out the whole week.
SCALES = "week INT, low DOUBLE, high DOUBLE, mean_low DOUBLE, mean_high DOUBLE, since BIGINT"
#: Micro-batches after which the table of series is merged.
MERGE_EVERY = 16
ALERT = ["student_uid", "week", "prob_risk", "theta_t", "alert"]
MERGE_ALERTS = batch_store.merge_newest(ALERT[:2])


class RunningAlerts:
    """Writer of micro-batches of series. ``enrolled`` has id_student, student_uid and ``scored`` (whether the
    row is scored, or only takes part in scaling); ``thresholds`` one row per week. Enrolments of
    learners without any click are left out, as in the batch evaluation.

    All enrolments of a learner have one series, so scales and scores are computed by learner; only the risks meet
    the enrolments that are scored.
    """

    def __init__(self, spark: SparkSession, out: str, enrolled: DataFrame, thresholds: DataFrame, max_weeks: int = MAX_WEEKS) -> None:
        self.spark, self.out, self.max_weeks = spark, out, max_weeks
        self.learners = staged(enrolled.groupBy("id_student").agg(F.max("scored").alias("scored")), "learners")
        self.scored = enrolled.filter("scored").select("id_student", "student_uid")
        self.thresholds = thresholds.select("week", "theta_t")

    @cached_property
    def _repeated(self) -> bool:
        """Whether a scored row shares its ``student_uid`` with another one."""
        return not self.scored.groupBy("student_uid").count().filter("count > 1").isEmpty()

    def _scales(self, batch_id: int) -> dict[int, tuple] | None:
        """The scales of the micro-batch before; none at the start."""
        earlier = [i for i in batch_store.complete_batches(self.spark, f"{self.out}/scales") if i < batch_id]
        if not earlier:
            return None
        rows = self.spark.read.schema(SCALES).parquet(f"{self.out}/scales/batch_id={earlier[-1]}").collect()
        return {r["week"]: tuple(r)[1:] for r in rows}

    def moved(self, old: dict[int, tuple] | None, new: dict[int, tuple]) -> list[int]:
        """Weeks all of whose scores are new: the own range of means moved, or that of the clicks of a week up to it."""
        if old is None:
            return sorted(new)
        first = min((w for w in new if old.get(w, (None,))[:2] != new[w][:2]), default=self.max_weeks)
        return [w for w in sorted(new) if w >= first or old[w][2:4] != new[w][2:4]]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, names = self.spark, week_columns(self.max_weeks)
        series = f"{self.out}/series"
        runner.batch_table(series)(batch, batch_id)
        newest = batch_store.merge_newest(["id_student"])(batch_store.read_table(spark, series, batch_id))
        weeks = [F.col("weeks")[k].cast("double").alias(name) for k, name in enumerate(names)]
        data = newest.select("id_student", "batch_id", *weeks).join(self.learners, "id_student").persist()
        try:
            scaler = ClickScaler.fit(data, self.max_weeks)
            rows = data.filter("scored").drop("scored")
            means = prefix_means(scaler.transform(rows), ["id_student"], self.max_weeks)
            columns = [f"m{t}" for t in range(self.max_weeks)]
            ranges = [(0.0, 1.0) if low is None else (low, high) for low, high in column_ranges(means, columns)]
            new = {t: (*scaler.ranges[t], *ranges[t]) for t in range(self.max_weeks)}
            old = self._scales(batch_id)
            again = self.moved(old, new)
            risks = F.array(*[1.0 - scaled(c, low, high) for c, (low, high) in zip(columns, ranges)])
            owners = scaler.transform(rows.join(self.scored, "id_student"))  # joined first: cheap to plan
            own = prefix_means(owners, ["student_uid", "batch_id"], self.max_weeks)
            each = own.select("student_uid", "batch_id", F.posexplode(risks).alias("week", "prob_risk"))
            changed = each.filter((F.col("batch_id") == batch_id) | F.col("week").isin(again)).drop("batch_id")
            found = twin.alerts(changed, self.thresholds).select(*ALERT)
            runner.batch_table(f"{self.out}/alerts")(found, batch_id)
            since = {t: batch_id if t in again else old[t][4] for t in new}
            table = spark.createDataFrame([(t, *map(float, values), since[t]) for t, values in new.items()], SCALES)
            runner.batch_table(f"{self.out}/scales", lambda df: df.coalesce(1))(table, batch_id)
        finally:
            data.unpersist()
        if batch_id % MERGE_EVERY == MERGE_EVERY - 1:
            batch_store.compact(spark, series, batch_store.merge_newest(["id_student"]))
            # by the scales before: the newest batch is not merged, and may be run again
            batch_store.compact(spark, f"{self.out}/alerts", lambda rows: MERGE_ALERTS(self._valid(rows, old)))

    def _valid(self, rows: DataFrame, scales: dict[int, tuple] | None) -> DataFrame:
        """Without rows from before their week was last put out whole."""
        since = {week: values[4] for week, values in (scales or {}).items() if values[4] is not None}
        if not since:
            return rows
        first = F.get(F.array(*[F.lit(since.get(week, -1)) for week in range(self.max_weeks)]), F.col("week"))
        return rows.filter(F.col("batch_id") >= first)

    def read(self) -> DataFrame:
        """The alerts as they stand: one row per scored enrolment and week."""
        last = max(batch_store.complete_batches(self.spark, f"{self.out}/alerts"), default=-1)
        rows, scales = batch_store.read_table(self.spark, f"{self.out}/alerts", last), self._scales(last + 1)
        single = [week for week, values in (scales or {}).items() if values[4] == last]
        if not single or self._repeated:
            return MERGE_ALERTS(self._valid(rows, scales)).drop("batch_id")
        whole = rows.filter((F.col("batch_id") == last) & F.col("week").isin(single)).select(*ALERT)
        if len(single) == self.max_weeks:
            return whole
        rest = self._valid(rows.filter(~F.col("week").isin(single)), scales)
        return whole.unionByName(MERGE_ALERTS(rest).drop("batch_id"))
