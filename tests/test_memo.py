"""Memoised scans."""

import os
import shutil

from coursebeacon.sources import readers
from coursebeacon.sources.memo import MemoisedScan, listing


def test_listing_names_every_file(spark, tmp_path):
    assert listing(spark, f"{tmp_path}/none") == frozenset()
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/t")
    found = listing(spark, f"{tmp_path}/t")
    assert len(found) == 2 and all(size > 0 and at > 0 and name.endswith(".parquet") for name, size, at in found)


def test_a_change_shows_after_the_limit_and_no_folder_is_read_twice(spark, tmp_path):
    path, now = f"{tmp_path}/t", [0.0]
    memo = MemoisedScan(spark, lambda s, p: readers.read_table(s, p), clock=lambda: now[0])
    spark.range(10).write.parquet(path)
    first = memo.scan(path)
    assert first.count() == 10 and first.storageLevel.useMemory
    now[0] = 4.9
    assert memo.scan(path) is first and memo.reads == 1
    now[0] = 5.0  # listed again, but nothing has changed
    assert memo.scan(path) is first and memo.reads == 1
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/more")  # another process puts a file into the folder
    more = next(f for f in os.listdir(f"{tmp_path}/more") if f.endswith(".parquet"))
    shutil.copy(f"{tmp_path}/more/{more}", path)
    now[0] = 9.9
    assert memo.scan(path).count() == 10
    now[0] = 10.0
    again = memo.scan(path)
    assert again.count() == 15 and memo.reads == 2
    file = next(f for f in os.listdir(path) if f.endswith(".parquet"))
    os.utime(f"{path}/{file}", (1, 1))  # same names and sizes
    now[0] = 15.0
    memo.scan(path)
    assert memo.reads == 3
    memo.clear()
    assert not memo.kept and not spark.read.parquet(path).storageLevel.useMemory
    assert memo.scan(path).count() == 15 and memo.reads == 4


def test_the_table_asked_for_longest_ago_goes(spark, tmp_path):
    memo = MemoisedScan(spark, lambda s, p: s.read.parquet(p), tables=2)
    for name in "abc":
        spark.range(3).write.parquet(f"{tmp_path}/{name}")
    a = memo.scan(f"{tmp_path}/a")
    memo.scan(f"{tmp_path}/b")
    assert memo.scan(f"{tmp_path}/a") is a
    memo.scan(f"{tmp_path}/c")
    assert list(memo.kept) == [f"{tmp_path}/a", f"{tmp_path}/c"]
