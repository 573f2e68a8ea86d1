"""Scores and assessment counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.schemas import COURSE, ENROLMENT


def course_totals(assessments: DataFrame) -> DataFrame:
    return assessments.groupBy(*COURSE).agg(F.count("*").alias("n_assessments"))


def score_sums(
    student_assessment: DataFrame, assessments: DataFrame, join_keys: str = "student"
) -> tuple[DataFrame, list[str]]:
    """Rows (key, n_scores, score_sum) to be added up per key, with the key they are held by.

    By learner this is a plain projection. By enrolment the scores are summed per learner and
    assessment before they meet the assessment's course, so a popular assessment cannot swell the
    join.
    """
    n, total = F.count("score").alias("n_scores"), F.sum("score").alias("score_sum")
    if join_keys == "student":
        single = F.when(F.col("score").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        return student_assessment.select("id_student", single.alias("n_scores"),
                                         F.col("score").alias("score_sum")), ["id_student"]
    per_assessment = student_assessment.groupBy("id_student", "id_assessment").agg(n, total)
    joined = per_assessment.join(assessments.select("id_assessment", *COURSE), "id_assessment")
    return joined.select(*ENROLMENT, "n_scores", "score_sum"), ENROLMENT


def score_aggregates() -> list:
    """Scored submissions and mean score over rows of ``score_sums``."""
    n = F.coalesce(F.sum("n_scores"), F.lit(0))
    return [n.alias("n_submitted"), F.try_divide(F.sum("score_sum"), n.cast("double")).alias("mean_score")]


def score_profile(
    student_assessment: DataFrame, assessments: DataFrame, join_keys: str = "student"
) -> tuple[DataFrame, list[str]]:
    sums, keys = score_sums(student_assessment, assessments, join_keys)
    return sums.groupBy(*keys).agg(*score_aggregates()), keys
