"""Streams that keep state: learner series, windows with a watermark, compaction, running alerts."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from coursebeacon.streaming import activity as stream_activity
from coursebeacon.streaming import batch_store, event_windows, learner_state, runner, running_alerts, twin

CLICKS = "id_student long, code_module string, code_presentation string, date int, sum_click long"


def drop(df, path, n):
    df.coalesce(1).write.mode("append").parquet(f"{path}/drop-{n}.parquet")


@pytest.fixture(scope="module")
def calendar(spark):
    return spark.createDataFrame([("A", "2014J", -5), ("B", "2013J", 0)], "code_module string, code_presentation string, min_date int")


ROWS = [
    (1, "A", "2014J", -5, 3), (1, "B", "2013J", 6, 4), (1, "A", "2014J", 9, 5), (2, "B", "2013J", 0, None), (3, "A", "2014J", 500, 7),
    (None, "A", "2014J", 1, 1), (4, "C", "2014J", 1, 1), (2, "B", "2013J", 20, 2), (1, "A", "2014J", 130, 6), (5, "A", None, 1, 1),
]


@pytest.mark.parametrize("order", [1, -1])
def test_learner_state_does_not_depend_on_order_or_restart(spark, calendar, tmp_path, order):
    inbox, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for n, row in enumerate(ROWS[::order]):
        drop(spark.createDataFrame([row], CLICKS), inbox, n)
        if n % 4 == 3 or n == len(ROWS) - 1:  # started again on the same checkpoint
            stream = twin.watch_table(spark, f"{inbox}/*", CLICKS, files_per_trigger=2)
            series = learner_state.weekly_series(stream, calendar)
            runner.run_available(spark, series, runner.batch_table(out), "update", state)
    found = runner.newest(runner.read_batches(spark, out), ["id_student"]).collect()
    got = {r.id_student: ({k: n for k, n in enumerate(r.weeks) if n}, r.last_week) for r in found}
    assert got == {1: ({0: 7, 2: 5, 19: 6}, 19), 2: ({2: 2}, 2), 3: ({}, -1)}
    fitted = learner_state.WeeklyRisk(((0.0, 10.0),) * 20, (0.9,) * 20)
    risks = {r.id_student: (r.prob_risk, r.at_risk) for r in fitted.current(spark.createDataFrame(found)).collect()}
    assert risks[1] == (pytest.approx(1 - 18 / 20 / 10), True) and risks[3] == (None, None)
    assert risks[2][0] == pytest.approx(1 - 2 / 3 / 10)


def test_batch_series_and_fit(spark):
    weekly = spark.createDataFrame([(1, 0, 4), (1, 2, 2), (2, 25, 9)], "id_student long, week_idx int, sum_click long")
    series = learner_state.series_of(weekly, 3)
    assert {r.id_student: (r.weeks, r.last_week) for r in series.collect()} == {1: ([4, 0, 2], 2), 2: ([0, 0, 0], -1)}
    ranges = {r.week: (r.low, r.high) for r in learner_state.mean_ranges(series, 3).collect()}
    assert ranges == {0: (0, 4), 1: (0, 2), 2: (0, 2)}
    with pytest.raises(ValueError):
        learner_state.WeeklyRisk.of_table(spark.createDataFrame([(1, 0.0, 1.0, 0.5)], "week int, low double, high double, theta_t double"))


def test_windows_keep_late_records_and_drop_old_state(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    days = [*range(1, 29), 3, 12, 27, 1]  # the last four come late, all but one after their window has closed
    expected, rows = defaultdict(float), []
    for n, day in enumerate(days):
        rows.append([(n, f"2024-0{1 + day // 29}-{day:02d} 12:00:00", 1, "view", 1.5), (n, None, 1, "view", 9.0),
                     (n, f"2024-01-{day:02d} 01:00:00", None, None, None)])
    for n, batch in enumerate(rows):
        df = spark.createDataFrame(batch, "event_id long, at string, user_id long, event_type string, value double")
        drop(df.select("event_id", F.col("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value"), inbox, n)
        expected[days[n]] += 1.5
    event_windows.write_windows(spark, twin.watch_table(spark, f"{inbox}/*", schema, files_per_trigger=1), out, "2 days")
    table = spark.read.schema(schema).parquet(f"{inbox}/*").filter("ts IS NOT NULL")
    want = table.groupBy("user_id", "event_type", F.window(F.col("ts").cast("timestamp"), "7 days").start.alias("s")).agg(
        F.count("*").alias("n"), F.sum("value").alias("v")).collect()
    got = event_windows.read_windows(spark, out).collect()
    assert sorted((str(r.user_id), r.week_start, r.n_events, r.total_value) for r in got) == sorted(
        (str(r.user_id), r.s, r.n, r.v or 0.0) for r in want)
    assert sum(r.n_late for r in got) == 6  # two users, three days
    windows = runner.read_batches(spark, f"{out}/windows")
    assert windows.agg(F.max("open_windows")).first()[0] <= 2 and windows.select("window_ms").distinct().count() >= 4


def weekly(spark, n):
    rows = [(u, "view", f"2024-01-0{1 + u % 2} 00:00:00", n, float(u)) for u in range(4)]
    return spark.createDataFrame(rows, "user_id long, event_type string, week_start string, n_events long, total_value double")


def test_compaction_at_every_step(spark, tmp_path):
    out = str(tmp_path / "table")
    write = runner.batch_table(out)
    merge = batch_store.merge_sums(["user_id", "event_type", "week_start"])
    assert batch_store.complete_batches(spark, out) == [] and not batch_store.compact(spark, out, merge)
    with pytest.raises(ValueError):
        batch_store.read_table(spark, out)

    def total():
        return stream_activity.total_events(batch_store.read_table(spark, out)).agg(F.sum("n_events")).first()[0]

    for n in range(4):
        write(weekly(spark, n + 1), n)
    assert total() == 40
    version = batch_store.write_merged(spark, out, merge)  # and fails
    assert version.upto == 2 and total() == 40 and batch_store.current(spark, out).upto == -1
    assert batch_store.compact(spark, out, merge) and total() == 40
    assert batch_store.current(spark, out).upto == 2 and batch_store.complete_batches(spark, out) == [0, 1, 2, 3]
    write(weekly(spark, 3), 2)  # a merged batch is run again: it does not count twice
    write(weekly(spark, 4), 3)  # so is the newest
    assert total() == 40
    (tmp_path / "table" / "batch_id=9").mkdir()  # a batch whose writing has begun
    assert total() == 40
    for n in (4, 5):
        write(weekly(spark, n + 1), n)
    assert batch_store.compact(spark, out, merge) and total() == 4 * 21
    assert batch_store.complete_batches(spark, out) == [3, 4, 5]  # what the first version covered has gone
    version = batch_store.current(spark, out)
    batch_store.publish(spark, out, batch_store.Version(version.number, version.upto, version.folder))  # twice
    assert total() == 4 * 21 and batch_store.read_table(spark, out, 4).agg(F.sum("n_events")).first()[0] == 4 * 15
    assert not batch_store.compact(spark, out, merge)


def test_compaction_of_newest_rows(spark, tmp_path):
    out = str(tmp_path / "newest")
    schema = "k long, v string"
    for n, rows in enumerate([[(1, "a"), (2, "b")], [(1, "c")], [(3, None), (2, "d")], [(1, "e")]]):
        runner.batch_table(out)(spark.createDataFrame(rows, schema), n)
    merge = batch_store.merge_newest(["k"])
    for _ in range(2):
        found = merge(batch_store.read_table(spark, out)).collect()
        assert {r.k: (r.v, r.batch_id) for r in found} == {1: ("e", 3), 2: ("d", 2), 3: (None, 2)}
        batch_store.compact(spark, out, merge)


def test_running_alerts_put_out_what_can_have_changed(spark, tmp_path):
    enrolled = spark.createDataFrame(
        [(1, "a", True), (2, "b", True), (3, "c", False), (4, "d", True)], "id_student long, student_uid string, scored boolean")
    theta = spark.createDataFrame([(0, 0.5), (1, 0.5)], "week int, theta_t double")
    alerts = running_alerts.RunningAlerts(spark, str(tmp_path), enrolled, theta, max_weeks=2)
    schema = "id_student long, weeks array<long>, last_week int, n_updates long"

    def put(n, *rows):
        alerts(spark.createDataFrame([(i, w, 1, n) for i, w in rows], schema), n)
        written = spark.read.parquet(f"{tmp_path}/alerts/batch_id={n}").collect()
        return Counter(r.student_uid for r in written), {(r.student_uid, r.week): (r.prob_risk, r.alert) for r in alerts.read().collect()}

    changed, now = put(0, (1, [0, 0]), (2, [4, 8]), (3, [8, 8]))
    assert changed == {"a": 2, "b": 2} and now["a", 1] == (1.0, True) and now["b", 1] == (0.0, False)
    changed, now = put(1, (4, [2, 2]))  # within all ranges: only the new one
    assert changed == {"d": 2} and now["d", 0] == (0.5, True) and len(now) == 6
    changed, now = put(2, (3, [16, 8]))  # not scored itself, but it stretches the first week
    assert changed == {"a": 2, "b": 2, "d": 2}
    changed, now = put(3, (2, [4, 9]))  # the range of the second week moves
    assert changed == {"a": 1, "b": 2, "d": 1}
    changed, again = put(3, (2, [4, 9]))  # a batch run again
    assert again == now


def test_windows_call_python_by_bucket(spark, tmp_path, monkeypatch):
    """Users share the state of a bucket: sums, late rows and open windows stay those of each user and type."""
    monkeypatch.setattr(event_windows, "BUCKETS", 2)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    big = 2**60 + 1  # not a double
    for n, day in enumerate(("2024-03-20", "2024-03-21", "2024-01-02")):
        rows = [(n, f"{day} 12:00:00", u, t, 1.0) for u in (0, big, None) for t in ("", "view", None)]
        df = spark.createDataFrame(rows + [(n, f"{day} 13:00:00", big, "view", float("nan"))], "event_id long, at string, user_id long, event_type string, value double")
        drop(df.select("event_id", F.col("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value"), inbox, n)
    stream = event_windows.event_windows(twin.watch_table(spark, f"{inbox}/*", schema), "1 day")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan.split("TransformWithState")[1].split("\n")[0]
    event_windows.write_windows(spark, twin.watch_table(spark, f"{inbox}/*", schema, files_per_trigger=1), out, "1 day")
    got = {(r.user_id, r.event_type, str(r.week_start)[:10]): r for r in event_windows.read_windows(spark, out).collect()}
    assert len(got) == 9 * 3 and {k[0] for k in got} == {0, big, None}
    assert all(r.n_late == (r.n_events if k[2] < "2024-02" else 0) for k, r in got.items())
    assert all(r.total_value == 1.0 and r.n_events == 1 + (k[:2] == (big, "view")) for k, r in got.items())


def test_learners_share_the_state_of_a_bucket(spark, calendar, tmp_path, monkeypatch):
    monkeypatch.setattr(learner_state, "BUCKETS", 2)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n, ids in enumerate((range(0, 40), range(20, 60), [2**60 + 1, 3])):
        drop(spark.createDataFrame([(i, "B", "2013J", 7 * n, i) for i in ids], CLICKS), inbox, n)
    series = learner_state.weekly_series(twin.watch_table(spark, f"{inbox}/*", CLICKS, files_per_trigger=1), calendar)
    assert "bucket" in series._jdf.queryExecution().analyzed().toString().split("FlatMapGroupsInPandasWithState")[1].split("\n")[0]
    runner.run_available(spark, series, runner.batch_table(out), "update")
    found = {r.id_student: r for r in runner.newest(runner.read_batches(spark, out), ["id_student"]).collect()}
    assert len(found) == 61 and found[2**60 + 1].weeks[2] == 2**60 + 1
    assert (found[30].weeks[:3], found[30].last_week, found[30].n_updates) == ([30, 30, 0], 1, 2)
    assert (found[3].weeks[:3], found[3].last_week, found[3].n_updates) == ([3, 0, 3], 2, 2)
    assert found[59].n_updates == 1


def test_backlog_parts_are_several_tasks(spark, monkeypatch):
    """Five parts in order, every row once; a part is not the work of one task."""
    from coursebeacon.catalog import entries

    seen, staged = [], entries.staged
    monkeypatch.setattr(entries, "staged", lambda df, *rest: (seen.append(df), staged(df, *rest))[1])
    table = spark.range(0, 4000, 1, 4).selectExpr("id", "int(id % 50) as day")
    path, files, write = entries._backlog(table, "day", "backlog")
    tasks = seen[0].select("_part", F.spark_partition_id().alias("at")).distinct().groupBy("_part").count().collect()
    assert files == 1 and {r["_part"] for r in tasks} == set(range(5)) and all(r["count"] > 1 for r in tasks)
    lowest = None
    for part in range(5):
        before = {r["id"] for r in spark.read.parquet(path).collect()} if part else set()
        write(part)
        days = [r["day"] for r in spark.read.parquet(path).collect() if r["id"] not in before]
        assert days and (lowest is None or max(days) <= lowest)
        lowest = min(days)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(4000))


SERIES = "id_student long, weeks array<long>, last_week int, n_updates long"


def put(spark, alerts, n, *rows):
    alerts(spark.createDataFrame([(i, w, 1, n) for i, w in rows], SERIES), n)


def newest_rows(spark, out):
    rows = batch_store.merge_newest(["student_uid", "week"])(batch_store.read_table(spark, f"{out}/alerts"))
    return Counter((r.student_uid, r.week, r.prob_risk, r.theta_t, r.alert) for r in rows.collect())


def merged(table):
    return "Aggregate" in table._jdf.queryExecution().executedPlan().toString()


def test_running_alerts_merge_only_weeks_that_have_not_been_put_out_whole(spark, tmp_path):
    enrolled = spark.createDataFrame(
        [(1, "a", True), (1, "b", True), (1, "x", False), (2, "c", True), (3, "d", False), (4, "e", True), (None, "f", True)],
        "id_student long, student_uid string, scored boolean")
    theta = spark.createDataFrame([(0, 0.5), (1, 0.5)], "week int, theta_t double")
    alerts = running_alerts.RunningAlerts(spark, str(tmp_path), enrolled, theta, max_weeks=2)

    def found():
        table = alerts.read()
        assert table.columns == ["student_uid", "week", "prob_risk", "theta_t", "alert"]
        rows = Counter(tuple(r) for r in table.collect())
        assert rows == newest_rows(spark, tmp_path) and max(rows.values()) == 1
        return merged(table), len(rows)

    put(spark, alerts, 0, (1, [0, 0]), (2, [4, 8]), (3, [8, 8]))
    assert found() == (False, 6)  # the only batch
    put(spark, alerts, 1, (4, [2, 2]))
    assert found() == (True, 8)  # no week is put out whole
    put(spark, alerts, 2, (2, [4, 9]))  # the second week is
    assert found() == (True, 8)
    assert {r.week: r.since for r in spark.read.parquet(f"{tmp_path}/scales/batch_id=2").collect()} == {0: 0, 1: 2}
    put(spark, alerts, 3, (3, [16, 8]))  # both are
    assert found() == (False, 8)
    (tmp_path / "alerts" / "batch_id=7").mkdir()  # a batch whose writing has begun
    assert found() == (False, 8)


def test_running_alerts_read_what_was_written_before(spark, tmp_path):
    """Scales without the batch in which a week was put out whole, rows that share a key, and merged batches."""
    enrolled = spark.createDataFrame([(1, "a", True), (1, "a", True), (2, "b", True)], "id_student long, student_uid string, scored boolean")
    theta = spark.createDataFrame([(0, 0.5)], "week int, theta_t double")
    alerts = running_alerts.RunningAlerts(spark, str(tmp_path), enrolled, theta, max_weeks=1)
    put(spark, alerts, 0, (1, [0]), (2, [4]))
    scales = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/scales/batch_id=0").drop("since").collect())
    runner.batch_table(f"{tmp_path}/scales")(scales.select(F.col("week").cast("int"), *scales.columns[1:]), 0)
    for n, row in ((1, (1, [2])), (2, (2, [6])), (15, (1, [1]))):  # the last one is followed by a merge
        put(spark, alerts, n, row)
        rows = Counter(tuple(r) for r in alerts.read().collect())
        assert rows == newest_rows(spark, tmp_path) and {r[0]: n for r, n in rows.items()} == {"a": 1, "b": 1}
    assert batch_store.current(spark, f"{tmp_path}/alerts").upto == 2


def test_thresholds_are_taken_from_the_inputs_of_the_stream(spark, small, monkeypatch):
    from coursebeacon.catalog import entries

    written, lines = [], entries.relational.written_lines
    monkeypatch.setattr(entries.relational, "written_lines", lambda *where: written.append(where) or lines(*where))
    i, calendar, *_ = entries._click_stream(spark, small)
    theta = entries._risk_thresholds(spark, small, i)
    assert len(written) == 1 and theta.count() == 20 and i.calendar is calendar
    sweep = entries.thresholds.threshold_sweep(entries._histogram(spark, small).filter("mode = 'risk'"), ["mode", "week"])
    want = entries.thresholds.select_thresholds(sweep, ["mode", "week"], entries.thresholds.Strategy("f1"))
    assert {(r.week, r.theta_t) for r in theta.collect()} == {(r.week, r.theta) for r in want.collect()}
