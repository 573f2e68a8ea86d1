"""Per-enrolment feature table and the model-ready data set."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import ratio
from coursebeacon.operators.activity import click_aggregates, learner_weeks
from coursebeacon.operators.assessments import course_totals, score_aggregates, score_sums
from coursebeacon.operators.enrolments import enrolments
from coursebeacon.schemas import COURSE, ENROLMENT, MAX_WEEKS, week_columns


@dataclass(frozen=True)
class Inputs:
    student_info: DataFrame
    student_vle: DataFrame
    assessments: DataFrame
    student_assessment: DataFrame
    calendar: DataFrame | None = None  # of the click log, where it is known already


def with_profiles(enrolled: DataFrame, inputs: Inputs, join_keys: str, max_weeks: int) -> DataFrame:
    """Enrolments whose key has clicks or scores, with the sums of both.

    By learner, weekly sums and scores are put under one another and added up by one aggregate, so one
    shuffle of map-side sums replaces two aggregates and a join. By enrolment they are summed on their own: a
    learner can be scored in many courses without clicks, whose rows stay two numbers instead of all weeks. Where
    both sides come by different keys (logs without course columns) they are joined instead.
    """
    weeks, click_keys = learner_weeks(inputs.student_vle, inputs.student_info, join_keys, inputs.calendar)
    scores, score_keys = score_sums(inputs.student_assessment, inputs.assessments, join_keys)
    clicked = [*click_aggregates(max_weeks), (F.count("week_idx") > 0).alias("has_clicks")]
    if click_keys == score_keys == ["id_student"]:
        both = weeks.unionByName(scores, allowMissingColumns=True)
        return enrolled.join(both.groupBy(*click_keys).agg(*clicked, *score_aggregates()), click_keys)
    by_clicks = weeks.groupBy(*click_keys).agg(*clicked)
    by_scores = scores.groupBy(*score_keys).agg(*score_aggregates())
    if click_keys == score_keys:
        clicks, marks = by_clicks.withColumn("_clicked", F.lit(True)), by_scores.withColumn("_scored", F.lit(True))
        found = enrolled.join(clicks, click_keys, "left").join(marks, score_keys, "left")
        return found.filter("_clicked or _scored").drop("_clicked", "_scored")
    owners = inputs.student_info.select(*ENROLMENT).distinct()
    return enrolled.join(owners.join(by_scores, score_keys).join(by_clicks, ENROLMENT, "full_outer"), ENROLMENT)


def feature_table(
    inputs: Inputs,
    join_keys: str = "student",
    completion: str = "ratio",
    max_weeks: int = MAX_WEEKS,
) -> DataFrame:
    """Every enrolment with clicks or scores: weekly columns and the aggregate metrics.

    ``join_keys="student"`` counts all of a learner's activity for each enrolment, ``"enrolment"``
    only that of the course. ``completion="absent"`` leaves the ratio at 0. Enrolments meet finished
    profiles, one row per key, in joins that AQE can split where a key is hot.
    """
    totals = course_totals(inputs.assessments)
    joined = with_profiles(enrolments(inputs.student_info), inputs, join_keys, max_weeks).join(totals, COURSE, "left")
    n_submitted = F.coalesce("n_submitted", F.lit(0)).cast("bigint")
    n_assessments = F.coalesce("n_assessments", F.lit(0)).cast("bigint")
    if completion == "ratio":
        share = F.when(
            F.col("n_assessments") > 0, F.least(F.lit(1.0), ratio(n_submitted, "n_assessments"))
        )
    elif completion == "absent":
        share = F.lit(0.0)
    else:
        raise ValueError(f"completion must be 'ratio' or 'absent', not {completion!r}")
    return joined.select(
        "student_uid", "id_student", *COURSE, "final_result", "label",
        F.coalesce("has_clicks", F.lit(False)).alias("has_clicks"),
        *[F.expr(f"double(coalesce({w}, 0))").alias(w) for w in week_columns(max_weeks)],
        n_submitted.alias("n_submitted"),
        F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
        F.coalesce("total_clicks", F.lit(0)).cast("bigint").alias("total_clicks"),
        F.coalesce("active_weeks", F.lit(0)).cast("bigint").alias("active_weeks"),
        n_assessments.alias("n_assessments"),
        share.alias("completion"),
    )


def model_dataset(features: DataFrame) -> DataFrame:
    """Enrolments with a click matrix; learners without any click are left out."""
    return features.filter("has_clicks").drop("has_clicks")
