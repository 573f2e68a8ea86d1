"""Memoised scans: a folder is read again only when its files have changed.

A table stays persisted on the executors under the listing it was read with: path, size and
modification time of every file. Within the time limit it is handed out as it is; after that the
folder is listed anew, and only another listing makes it be read again. So a change shows no later
than the limit, and an unchanged folder is not read twice.
"""

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

#: Seconds for which a table is not even listed again, and tables that are kept at most.
LIFE, TABLES = 5.0, 16

Listing = frozenset[tuple[str, int, int]]


def listing(spark: SparkSession, path: str) -> Listing:
    """(path, size, modification time in ms) of the files below a path, hidden ones aside; empty without any."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return frozenset()
    found, files = set(), store.listFiles(where, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()
        if not status.getPath().getName().startswith(("_", ".")):
            found.add((name, status.getLen(), status.getModificationTime()))
    return frozenset(found)


@dataclass
class _Kept:
    table: DataFrame
    files: Listing
    listed: float


class MemoisedScan:
    """Scans through ``reader``, a function of session and path, e.g. one of `sources.readers`.

    Not a copy of the data: if an executor with a part of a table is lost within the limit after the
    files were replaced, that part cannot be read again; ``forget`` then lets the next scan start anew.
    """

    def __init__(self, spark: SparkSession, reader: Callable[[SparkSession, str], DataFrame], life: float = LIFE,
                 tables: int = TABLES, clock: Callable[[], float] = time.monotonic) -> None:
        self.spark, self.reader, self.life, self.tables, self.clock = spark, reader, life, tables, clock
        self.kept: OrderedDict[str, _Kept] = OrderedDict()
        self.reads = 0

    def scan(self, path: str) -> DataFrame:
        """The table at ``path``, at most ``life`` seconds old."""
        now, known = self.clock(), self.kept.get(path)
        if known is not None and now - known.listed < self.life:
            self.kept.move_to_end(path)
            return known.table
        files = listing(self.spark, path)  # before reading: a change in between shows at the next listing
        if known is not None and files == known.files:
            known.listed = now
            self.kept.move_to_end(path)
            return known.table
        self.forget(path)
        table = self.reader(self.spark, path).persist(StorageLevel.MEMORY_AND_DISK)
        self.reads += 1
        self.kept[path] = _Kept(table, files, now)
        while len(self.kept) > self.tables:
            self.forget(next(iter(self.kept)))  # the one that was asked for longest ago
        return table

    def forget(self, path: str) -> None:
        known = self.kept.pop(path, None)
        if known is not None:
            known.table.unpersist()

    def clear(self) -> None:
        for path in list(self.kept):
            self.forget(path)
