from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from coursebeacon import schemas
from coursebeacon.operators.features import feature_table
from coursebeacon.sources import readers, relational, sinks

HISTORY = """timestamp,id_student,so_bai_nop,diem_tb,ti_le_hoan_thanh,tong_click,so_tuan_hoat_dong,prob_pass
2024-03-01 08:00:00,4711_X_2020B,3,81.5,0.75,640,12,0.25
2024-03-02 09:30:15,"47,12_X_2020B",4,55,0.5,120,9,0.75,0.25
2024-03-03 10:00:00,4713_X_2020B,5,60,0.5,130,9,0.625,0.375,surplus
2024-03-04 10:00:00,"47,14_X_2020B",6,61,0.5,131,8,0.5
"""


def test_history_rows_of_two_widths(spark, tmp_path):
    (tmp_path / "history.csv").write_text(HISTORY)
    rows = readers.read_tolerant_csv(spark, str(tmp_path / "history.csv"), schemas.WHATIF_HISTORY).orderBy("timestamp").collect()
    assert [(r["prob_pass"], r["prob_risk"]) for r in rows] == [(0.25, None), (0.75, 0.25), (0.5, None)]
    assert rows[0]["active_weeks"] == 12.0 and rows[2]["id_student"] == "47,14_X_2020B"


def test_raw_csv_by_header_with_dirty_values(spark, tmp_path):
    (tmp_path / "studentInfo.csv").write_text("code_module,extra,code_presentation,id_student,final_result\nA,x,13,1,Pass\n")
    (tmp_path / "studentVle.csv").write_text("id_student,date,sum_click\n1,-3,5\n1,oops,2\n")
    (tmp_path / "assessments.csv").write_text("code_module,code_presentation,id_assessment\nA,13,9\n")
    (tmp_path / "studentAssessment.csv").write_text("id_assessment,id_student,score\n9,1,50\n9,1,?\n")
    inputs = readers.read_inputs(spark, str(tmp_path))
    r = feature_table(inputs).first()
    assert (r["w0_clicks"], r["n_submitted"], r["mean_score"], r["completion"]) == (5.0, 1, 50.0, 1.0)
    (tmp_path / "studentInfo.csv").write_text("id_student\n1\n")
    with pytest.raises(ValueError, match="student_info|studentInfo"):
        readers.read_inputs(spark, str(tmp_path))


def test_optional_and_preferred_sources(spark, tmp_path):
    assert readers.read_optional(spark, str(tmp_path / "no"), schemas.PREDICTIONS).count() == 0
    spark.createDataFrame([("a", 1, float("nan"))], schemas.PREDICTIONS).write.parquet(str(tmp_path / "p"))
    found = readers.read_first(spark, [str(tmp_path / "no"), str(tmp_path / "p")], schemas.PREDICTIONS)
    assert found.first()["prob_pass"] is None  # NaN is NULL from the start
    assert readers.read_first(spark, [str(tmp_path / "no")], schemas.PREDICTIONS) is None
    times = readers.file_times(spark, str(tmp_path / "p")).first()
    assert len(times["clock"]) == 8


def test_status_document(spark, tmp_path):
    assert readers.read_status(spark, str(tmp_path / "none.json")).count() == 0
    doc = spark.sql("select '2025-01-01 00:00:00' as timestamp, 'holiday' as scenario, 0.15D as affected_fraction, 7L as rows, 1D as test_csv_mtime")
    sinks.write_status(doc, str(tmp_path / "status"))
    r = readers.read_status(spark, str(tmp_path / "status")).first()
    assert (r["scenario"], r["rows"]) == ("holiday", 7)


def test_logs_append_and_predictions_overwrite(spark, tmp_path):
    row = spark.sql("select 1 as week, 0.5D as f1")
    at = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
    for run in ("a", "b", "b"):
        sinks.append_log(row, str(tmp_path / "log"), run, at)
    assert {(r["run"], r["count"]) for r in spark.read.parquet(str(tmp_path / "log")).groupBy("run").count().collect()} == {("a", 1), ("b", 2)}
    p = spark.createDataFrame([("a", 1, 0.9)], schemas.PREDICTIONS)
    for _ in range(2):
        sinks.write_predictions(p, str(tmp_path / "pred"))
    assert readers.read_table(spark, str(tmp_path / "pred"), schemas.PREDICTIONS).count() == 1


def test_names_history_and_export(spark, tmp_path):
    legacy = spark.sql("select 3 as so_bai_nop, 50D as diem_tb")
    ours = readers.from_extract_names(legacy)
    assert ours.columns == ["n_submitted", "mean_score"]
    assert sinks.to_extract_names(ours).columns == legacy.columns
    assert readers.with_missing_columns(ours, ["completion"]).first()["completion"] is None
    request = spark.sql("select 'u' as student_uid, 1L as in_total_clicks, 2L as in_n_submitted, 3L as in_mean_score, "
                        "4L as in_completion, 5L as in_active_weeks, 0.123450001D as prob_pass")
    sinks.append_history(request, str(tmp_path / "h"))
    r = readers.read_table(spark, str(tmp_path / "h"), schemas.WHATIF_HISTORY).first()
    assert (r["id_student"], r["total_clicks"]) == ("u", 1.0)
    assert (r["prob_pass"], r["prob_risk"]) == (0.1235, 0.8765)
    sinks.export_csv(ours, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ours.columns


def test_order_lines_meet_their_orders_once(spark, tmp_path):
    """Click log and scores read written lines; lines and orders with null or repeated keys count as in a plain join."""
    orders = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    day = datetime(1996, 3, 1)
    spark.createDataFrame([
        (1, 6, "F", 10.0, day, "2-HIGH"), (2, 6, "O", 10.0, day, "1-URGENT"), (2, 7, "O", 10.0, day, "1-URGENT"),
        (3, None, "P", 10.0, day, None), (None, 9, "F", 10.0, day, "3-MEDIUM"),
    ], orders).write.parquet(f"{tmp_path}/orders.parquet")
    lines = "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_discount DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ"
    spark.createDataFrame([
        (1, 5, 2.0, 0.05, "N", day), (1, 5, 2.0, 0.05, "N", day), (2, None, 1.0, 0.04, "R", day), (3, 8, None, None, None, None),
        (None, 5, 2.0, 0.05, "N", day), (4, 5, 2.0, 0.05, "N", day),
    ], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, 7)], "p_partkey BIGINT, p_size INT").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 2)], "s_suppkey BIGINT, s_nationkey INT").write.parquet(f"{tmp_path}/supplier.parquet")
    i = relational.inputs(spark, str(tmp_path))
    for table in (i.student_vle, i.student_assessment):
        assert "Join" not in table._jdf.queryExecution().optimizedPlan().toString()
    day_of_course = (61 - 1) % 210 - 25
    high, urgent = (6, "2", "1996", 5, day_of_course + 6, 6), [(k, "1", "1996", None, day_of_course + 3, n) for k, n in ((6, 3), (7, 4))]
    assert Counter(map(tuple, i.student_vle.collect())) == Counter([high, high, *urgent, (None, None, "1996", 8, None, None)])
    assert Counter(map(tuple, i.student_assessment.collect())) == Counter(
        [(5, 6, 50.0), (5, 6, 50.0), (None, 6, None), (None, 7, None), (8, None, None)])
