from pyspark.sql import functions as F

from coursebeacon.operators import activity, metric_log
from coursebeacon.operators.scenario import scenario_named
from coursebeacon.plans.train import train_aggregate
from coursebeacon.sources import readers, relational
from coursebeacon.streaming import activity as stream_activity
from coursebeacon.streaming import runner, twin


def drop(df, path, n):
    df.write.mode("append").parquet(f"{path}/drop-{n}.parquet")


def test_two_drops_equal_the_batch(spark, small, tmp_path):
    events = relational._read(spark, small, "events")
    inbox, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for n in (0, 1):
        drop(events.filter(F.col("event_id") % 2 == n), inbox, n)
        stream = twin.watch_table(spark, f"{inbox}/*", relational.TABLES["events"])
        runner.run_available(spark, stream, runner.batch_table(out, stream_activity.weekly_events), checkpoint=state)
    keys = ["user_id", "event_type", "week_start"]
    got = stream_activity.total_events(runner.read_batches(spark, out))
    want = events.groupBy("user_id", "event_type", F.window(F.col("ts").cast("timestamp"), "7 days").alias("w")).agg(
        F.count("*").alias("n"))
    assert got.count() == want.count()
    joined = got.join(want.select("user_id", "event_type", F.col("w.start").alias("week_start"), "n"), keys)
    assert joined.filter("n = n_events").count() == want.count()


def test_learner_weeks_equal_the_batch(spark, small, tmp_path):
    i = relational.inputs(spark, small)
    calendar = activity.course_calendar(i.student_vle, i.student_info).cache()
    inbox, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    for n in (0, 1):
        drop(i.student_vle.filter(F.col("id_site") % 2 == n), inbox, n)
        stream = twin.watch_table(spark, f"{inbox}/*", i.student_vle.schema)
        writer = runner.batch_table(out, lambda b: stream_activity.learner_weeks(b, calendar))
        runner.run_available(spark, stream, writer, checkpoint=state)
    got = stream_activity.total_per_week(runner.read_batches(spark, out))
    want = activity.learner_weeks(i.student_vle, i.student_info)[0].select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_course_years_in_any_order(spark, tmp_path):
    """Course codes of text, the oldest year last, one file at a time: nothing is lost."""
    inbox, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    calendar = spark.createDataFrame([("A", "2014J", -5), ("A", "2013J", 0)], "code_module string, code_presentation string, min_date int")
    schema = "id_student long, code_module string, code_presentation string, date int, sum_click long"
    for n, (course, date) in enumerate([("2014J", -5), ("2014J", 9), ("2013J", 1), ("2013J", 8), ("2013J", 1)]):
        drop(spark.createDataFrame([(1, "A", course, date, 10**n)], schema), inbox, n)
    stream = twin.watch_table(spark, f"{inbox}/*", schema, files_per_trigger=1)
    runner.run_available(spark, stream, runner.batch_table(out, lambda b: stream_activity.learner_weeks(b, calendar)), checkpoint=state)
    parts = runner.read_batches(spark, out)
    assert parts.select("batch_id").distinct().count() >= 4
    got = {r["week_idx"]: r["sum_click"] for r in stream_activity.total_per_week(parts).collect()}
    assert got == {0: 10101, 1: 1000, 2: 10}


def test_rescore_snapshot_and_status(spark, tmp_path):
    df = spark.range(60).selectExpr(
        "concat('u', id) as student_uid", "id * 100 as total_clicks", "id % 10 as n_submitted",
        "double(id) as mean_score", "double(id) / 60 as completion", "id % 20 as active_weeks", "int(id > 30) as label")
    inbox, log, status, out = (str(tmp_path / p) for p in ("in", "log", "status", "out"))
    _, score = train_aggregate(df)
    drop(df, inbox, 0)
    stream = twin.watch_table(spark, f"{inbox}/*", df.schema, file_time=True)
    runner.run_available(spark, twin.rescore(stream, score), runner.batch_table(out))
    predictions = runner.read_batches(spark, out)
    assert predictions.count() == 60 and predictions.filter("prob_pass between 0 and 1").count() == 60
    writer = twin.snapshot_writer(log, status, scenario_named("baseline"))
    runner.run_available(spark, stream, writer)
    snapshots = runner.read_batches(spark, log)
    assert metric_log.latest_row(snapshots, ["batch_id"]).first()["mean_score"] == 29.5
    assert readers.read_status(spark, f"{status}/batch_id=0").first()["rows"] == 60
    modified = max(f.stat().st_mtime for f in tmp_path.glob("in/*/*.parquet"))
    assert abs(readers.read_status(spark, f"{status}/batch_id=0").first()["test_csv_mtime"] - modified) < 1
    # a batch run again overwrites its own folder
    writer(df, 0)
    assert runner.read_batches(spark, log).count() == 1


def test_alerts_join_the_weeks_threshold(spark, tmp_path):
    scores = spark.createDataFrame([("a", 0, 0.94), ("b", 1, 0.94), ("c", 1, None)], "student_uid string, week int, prob_risk double")
    theta = spark.createDataFrame([(0, 0.94), (1, 94 * 0.01)], "week int, theta_t double")
    drop(scores, str(tmp_path / "in"), 0)
    stream = twin.alerts(twin.watch_table(spark, f"{tmp_path}/in/*", scores.schema), theta)
    runner.run_available(spark, stream, runner.batch_table(str(tmp_path / "out")))
    got = {r["student_uid"]: r["alert"] for r in runner.read_batches(spark, str(tmp_path / "out")).collect()}
    assert got == {"a": True, "b": False, "c": False}
