"""Weekly clicks kept current from new files only.

A click log grows by files. Each update lists the folder, reads the files that no earlier update has
read, and adds their clicks up per learner, course and day: the finest grain that does not depend on
where a course's first day lies. The sums of an update are one batch of a batch table, the files it
read are named beside them, and both count only once its manifest row is written. Weeks are cut from
the days afterwards, so a file with an earlier first day moves all weeks of its course without a
second look at the log.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.operators.activity import learner_weeks, weekly_clicks
from coursebeacon.schemas import ENROLMENT, STUDENT_VLE
from coursebeacon.sources.memo import listing

FILES = "path string, size long, modified long"
DAILY = "id_student BIGINT, code_module STRING, code_presentation STRING, date INT, sum_click BIGINT"
#: Updates whose sums are merged into one folder.
MERGE_AT = 8


@dataclass(frozen=True)
class Update:
    """What one update did: the files it read, and the updates that stand behind the table now."""

    files: int
    parts: int


class ClickDays:
    """Daily sums of the files of ``log``, kept below ``root``.

    A file is known by path, size and modification time. One that was changed or removed cannot be
    taken out of sums: that is an error, and ``root`` has to be built anew.
    """

    def __init__(self, spark: SparkSession, log: str, root: str) -> None:
        self.spark, self.log, self.root = spark, log, root.rstrip("/")

    def _manifest(self) -> list[tuple[int, str, bool]]:
        """(number, folder, whether it takes the place of all before) of the updates that count, in order."""
        where = f"{self.root}/manifest"
        if not listing(self.spark, where):
            return []
        rows = sorted((r["number"], r["published"], r["folder"], r["whole"]) for r in self.spark.read.parquet(where).collect())
        last: dict[int, tuple[int, str, bool]] = {}
        for number, _, folder, whole in rows:
            last.setdefault(number, (number, folder, whole))  # of two with one number the first published counts
        found = list(last.values())
        wholes = [i for i, (_, _, whole) in enumerate(found) if whole]
        return found[wholes[-1] :] if wholes else found

    def _publish(self, number: int, folder: str, whole: bool) -> None:
        row = self.spark.createDataFrame([(number, folder, whole)], "number long, folder string, whole boolean")
        row.withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{folder}/{kind}" for _, folder, _ in self._manifest()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def update(self) -> Update:
        """Reads the files that are new. An update that fails before its last step leaves nothing that counts."""
        files = self.spark.createDataFrame(sorted(listing(self.spark, self.log)), FILES)
        known = self._read("files", FILES)
        keys = ["path", "size", "modified"]
        if not known.join(files, keys, "left_anti").isEmpty():
            raise ValueError(f"files of {self.log} were changed or removed")
        new = [r["path"] for r in files.join(known, keys, "left_anti").orderBy("path").collect()]
        if new:
            parts = self._manifest()
            number = parts[-1][0] + 1 if parts else 0
            folder = f"{self.root}/part-{number:06d}-{uuid.uuid4().hex}"
            rows = self.spark.read.schema(STUDENT_VLE).parquet(*new)
            daily = rows.groupBy(*ENROLMENT, "date").agg(F.sum("sum_click").alias("sum_click"))
            daily.write.parquet(f"{folder}/days")
            files.join(known, keys, "left_anti").coalesce(1).write.parquet(f"{folder}/files")
            self._publish(number, folder, False)
            if len(self._manifest()) >= MERGE_AT:
                self.merge()
        return Update(len(new), len(self._manifest()))

    def merge(self) -> None:
        """One folder in the place of all parts so far."""
        parts = self._manifest()
        if len(parts) < 2:
            return
        number = parts[-1][0] + 1
        folder = f"{self.root}/part-{number:06d}-{uuid.uuid4().hex}"
        self.days().write.parquet(f"{folder}/days")
        self._read("files", FILES).coalesce(1).write.parquet(f"{folder}/files")
        self._publish(number, folder, True)

    def days(self) -> DataFrame:
        """Clicks per learner, course and day: a click log like any other, only smaller."""
        parts = self._read("days", DAILY)
        return parts.groupBy(*ENROLMENT, "date").agg(F.sum("sum_click").alias("sum_click"))

    def weekly(self, info: DataFrame, enrolled: DataFrame, join_keys: str = "student") -> DataFrame:
        """The weekly series of a full rebuild from the whole log."""
        return weekly_clicks(self.days(), info, enrolled, join_keys)

    def learner_weeks(self, info: DataFrame, join_keys: str = "student") -> tuple[DataFrame, list[str]]:
        return learner_weeks(self.days(), info, join_keys)
