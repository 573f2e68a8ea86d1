"""Weekly clicks from new files only."""

import os

import pytest
from pyspark.sql import functions as F

from coursebeacon.operators import enrolments
from coursebeacon.operators.activity import weekly_clicks
from coursebeacon.plans import incremental
from coursebeacon.plans.incremental import ClickDays
from coursebeacon.schemas import STUDENT_VLE
from coursebeacon.sources import relational


def test_updates_equal_a_full_rebuild(spark, small, tmp_path, monkeypatch):
    i = relational.inputs(spark, small)
    info, enrolled = i.student_info, enrolments.enrolments(i.student_info)
    vle = i.student_vle.select([c.split()[0] for c in STUDENT_VLE.split(", ")]).cache()
    log, days = str(tmp_path / "log"), ClickDays(spark, str(tmp_path / "log"), str(tmp_path / "root"))
    monkeypatch.setattr(incremental, "MERGE_AT", 3)
    assert days.update() == incremental.Update(0, 0) and days.days().count() == 0
    seen = []
    # later days first, so that each update brings an earlier first day of every course
    for number, days_of in enumerate((F.col("date") >= 60, F.col("date").between(0, 59), F.col("date") < 0)):
        seen.append(days_of)
        vle.filter(days_of).repartition(2).write.mode("append").parquet(log)
        done = days.update()
        assert done.files == 2 and done.parts == (1, 2, 1)[number]  # the third one is merged
        want = weekly_clicks(vle.filter(seen[0] if number == 0 else (seen[0] | seen[1] if number == 1 else F.lit(True))), info, enrolled)
        got = days.weekly(info, enrolled).select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert days.update() == incremental.Update(0, 1)
    assert days.learner_weeks(info)[0].agg(F.sum("sum_click")).first()[0] > 0


def test_failed_updates_do_not_count(spark, tmp_path, monkeypatch):
    log, days = str(tmp_path / "log"), ClickDays(spark, str(tmp_path / "log"), str(tmp_path / "root"))
    row = [(1, "A", "2014J", 7, 3, 5)]
    spark.createDataFrame(row, STUDENT_VLE).coalesce(1).write.parquet(log)

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(days, "_publish", fails)
        with pytest.raises(RuntimeError):
            days.update()
    assert days.days().count() == 0
    assert days.update().files == 1 and days.days().first()["sum_click"] == 5
    days._publish(0, "another that came second", False)
    assert days.days().first()["sum_click"] == 5
    file = next(f for f in os.listdir(log) if f.endswith(".parquet"))
    os.utime(f"{log}/{file}", (1, 1))
    with pytest.raises(ValueError, match="changed"):
        days.update()
