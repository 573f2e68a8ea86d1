import pytest

from coursebeacon.operators import activity, enrolments
from coursebeacon.operators.features import Inputs, feature_table, model_dataset
from coursebeacon.schemas import ASSESSMENTS, STUDENT_ASSESSMENT, STUDENT_INFO, STUDENT_VLE


@pytest.fixture(scope="module")
def inputs(spark):
    info = [(1, "A", "13", "Pass"), (1, "B", "13", "Fail"), (1, "C", "14", "Distinction"),
            (2, "A", "13", None), (3, "B", "13", "Withdrawn"), (3, "B", "13", "Withdrawn")]
    vle = [(1, "A", "13", 7, -7, 4), (1, "A", "13", 8, -1, 2), (1, "A", "13", 8, 0, 3),
           (1, "A", "13", 8, 133, 10), (1, "A", "13", 8, 139, 0), (1, "A", "13", 8, 140, 0),
           (2, "A", "13", 7, -5, 1), (99, "A", "13", 7, -50, 1000)]
    tests = [(10, "A", "13", 1, 1.0), (11, "A", "13", 1, 1.0), (12, "B", "13", 1, 1.0)]
    scores = [(10, 1, 80.0), (11, 1, None), (12, 1, 60.0), (12, 3, None)]
    make = spark.createDataFrame
    return Inputs(make(info, STUDENT_INFO), make(vle, STUDENT_VLE), make(tests, ASSESSMENTS),
                  make(scores, STUDENT_ASSESSMENT))


def by_uid(df):
    return {r["student_uid"]: r for r in df.collect()}


def test_labels_and_key(inputs):
    rows = by_uid(enrolments.enrolments(inputs.student_info))
    assert {k: v["label"] for k, v in rows.items()} == {
        "1_A_13": 1, "1_B_13": 0, "1_C_14": 1, "2_A_13": 0, "3_B_13": 0}


def test_calendar_ignores_unknown_learners(inputs):
    rows = activity.course_calendar(inputs.student_vle, inputs.student_info).collect()
    assert [tuple(r) for r in rows] == [("A", "13", -7)]


def test_activity_counts_for_every_enrolment_of_a_learner(inputs):
    rows = by_uid(feature_table(inputs))
    for uid in ("1_A_13", "1_B_13", "1_C_14"):
        r = rows[uid]
        assert (r["w0_clicks"], r["w1_clicks"], r["w19_clicks"]) == (6.0, 3.0, 0.0)
        # week 20 is outside the matrix and inside the totals; a week of zero clicks is not active
        assert (r["total_clicks"], r["active_weeks"]) == (19, 3)
        assert (r["n_submitted"], r["mean_score"]) == (2, 70.0)
    assert rows["1_A_13"]["completion"] == 1.0 and rows["1_C_14"]["completion"] is None


def test_enrolment_join_keeps_courses_apart(inputs):
    rows = by_uid(feature_table(inputs, join_keys="enrolment"))
    assert rows["1_A_13"]["total_clicks"] == 19 and rows["1_A_13"]["n_submitted"] == 1
    assert rows["1_B_13"]["total_clicks"] == 0 and rows["1_B_13"]["mean_score"] == 60.0
    assert "1_C_14" not in rows


def test_scores_without_clicks_stay_features_but_leave_the_dataset(inputs):
    features = feature_table(inputs)
    r = by_uid(features)["3_B_13"]
    assert (r["n_submitted"], r["mean_score"], r["has_clicks"]) == (0, 0.0, False)
    assert "3_B_13" not in by_uid(model_dataset(features))


def test_absent_completion(inputs):
    assert {r["completion"] for r in feature_table(inputs, completion="absent").collect()} == {0.0}


def test_fan_out_after_aggregation_equals_fan_out_before(inputs, spark):
    enrolled = enrolments.enrolments(inputs.student_info)
    quick = activity.weekly_clicks(inputs.student_vle, inputs.student_info, enrolled)
    inputs.student_vle.createOrReplaceTempView("v")
    enrolled.createOrReplaceTempView("e")
    slow = spark.sql("""
      select student_uid, cast(floor((v.date - m.d) / 7) as int) as week_idx, sum(sum_click) as sum_click
      from v join e on v.id_student = e.id_student
      join (select code_module, code_presentation, min(date) as d from v
            where id_student in (select id_student from e) group by all) m
        on v.code_module = m.code_module and v.code_presentation = m.code_presentation
      group by all""")
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, slow.collect()))


def test_logs_without_course_take_the_enrolments_course(inputs):
    bare = inputs.student_vle.drop("code_module", "code_presentation")
    rows = by_uid(feature_table(Inputs(inputs.student_info, bare, inputs.assessments, inputs.student_assessment)))
    assert rows["1_C_14"]["w0_clicks"] == 6.0 and rows["2_A_13"]["total_clicks"] == 1


def test_pivot_equals_profile(inputs):
    enrolled = enrolments.enrolments(inputs.student_info)
    weekly = activity.weekly_clicks(inputs.student_vle, inputs.student_info, enrolled)
    wide = by_uid(activity.weekly_matrix(weekly))
    full = by_uid(feature_table(inputs))
    assert all(wide[u][f"w{k}_clicks"] == full[u][f"w{k}_clicks"] for u in wide for k in range(20))


def test_matrix_is_summed_before_the_shuffle(spark):
    rows = [("a", 0, 1), ("a", 0, 2), ("a", 19, 4), ("b", 20, 5), ("b", None, 6), ("c", 3, None), (None, 1, 7)]
    wide = activity.weekly_matrix(spark.createDataFrame(rows, "student_uid string, week_idx int, sum_click long"))
    got = {r["student_uid"]: {k: n for k, n in enumerate(r[1:]) if n} for r in wide.collect()}
    assert got == {"a": {0: 3, 19: 4}, "b": {}, "c": {}, None: {1: 7}} and wide.columns[1:] == [f"w{k}_clicks" for k in range(20)]
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1  # no aggregate by learner and week


def test_missing_columns_are_named(inputs):
    with pytest.raises(ValueError, match="final_result"):
        enrolments.enrolments(inputs.student_info.drop("final_result"))


def test_by_enrolment_scores_do_not_carry_the_weeks(spark, inputs):
    """Scores of courses without clicks are summed as two numbers; rows with null keys meet nothing."""
    make = spark.createDataFrame
    info = inputs.student_info.unionByName(make([(None, "A", "13", "Pass"), (3, None, "13", "Pass")], STUDENT_INFO))
    vle = inputs.student_vle.unionByName(make([(None, "A", "13", 7, 1, 9), (3, None, "13", 7, 1, 9), (3, "B", "13", 7, None, 9)], STUDENT_VLE))
    scores = inputs.student_assessment.unionByName(make([(10, None, 50.0), (None, 1, 50.0), (10, 2, 40.0)], STUDENT_ASSESSMENT))
    features = feature_table(Inputs(info, vle, inputs.assessments, scores), join_keys="enrolment")
    sums = [part for part in features._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in part and "score_sum" in part]
    assert sums and not any("w19_clicks" in part for part in sums)
    got = {k: (r["has_clicks"], r["total_clicks"], r["n_submitted"], r["mean_score"]) for k, r in by_uid(features).items()}
    assert got == {"1_A_13": (True, 19, 1, 80.0), "1_B_13": (False, 0, 1, 60.0), "2_A_13": (True, 1, 1, 40.0), "3_B_13": (False, 9, 0, 0.0)}
