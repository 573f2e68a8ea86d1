"""Click logs: course calendar, weekly sums, click profiles.

The raw log is by far the largest table. It is scanned with three to five columns, summed on the
map side before every shuffle, and never joined to enrolments row by row: because a learner's
activity counts for each of the learner's enrolments, the weekly sums are built per learner and
only the finished profile (one row per learner) meets the enrolments.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import week_index
from coursebeacon.operators.enrolments import known_learners
from coursebeacon.schemas import COURSE, ENROLMENT, MAX_WEEKS, week_columns


def has_course(vle: DataFrame) -> bool:
    return all(c in vle.columns for c in COURSE)


def course_calendar(vle: DataFrame, info: DataFrame) -> DataFrame:
    """First day with activity of known learners, per course."""
    if not has_course(vle):
        first = vle.groupBy("id_student").agg(F.min("date").alias("min_date"))
        per_learner = first.join(info.select(*ENROLMENT).distinct(), "id_student")
    else:
        # summarised before the semi join: the raw log is not shuffled for it
        per_learner = (
            vle.groupBy(*ENROLMENT)
            .agg(F.min("date").alias("min_date"))
            .join(known_learners(info), "id_student", "left_semi")
        )
    return per_learner.groupBy(*COURSE).agg(F.min("min_date").alias("min_date"))


def with_week_index(vle: DataFrame, calendar: DataFrame) -> DataFrame:
    return vle.join(calendar, COURSE).withColumn("week_idx", week_index("date", "min_date"))


def learner_weeks(
    vle: DataFrame, info: DataFrame, join_keys: str = "student", calendar: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Weekly sums at the finest grain that does not depend on the enrolment, with its key.

    ``calendar`` is that of the log, where it is known already.
    """
    calendar = course_calendar(vle, info) if calendar is None else calendar
    clicks = F.sum("sum_click").alias("sum_click")
    if not has_course(vle):
        days = vle.groupBy("id_student", "date").agg(clicks)
        per_course = days.join(info.select(*ENROLMENT).distinct(), "id_student")
        return with_week_index(per_course, calendar).groupBy(*ENROLMENT, "week_idx").agg(clicks), ENROLMENT
    keys = {"student": ["id_student"], "enrolment": ENROLMENT}[join_keys]
    return with_week_index(vle, calendar).groupBy(*keys, "week_idx").agg(clicks), keys


def weekly_clicks(vle: DataFrame, info: DataFrame, enrolled: DataFrame, join_keys: str = "student") -> DataFrame:
    """Long series (student_uid, week_idx, sum_click)."""
    weeks, keys = learner_weeks(vle, info, join_keys)
    owners = enrolled.select(*ENROLMENT, "student_uid").distinct()
    return weeks.join(owners, keys).select("student_uid", "week_idx", "sum_click")


def _dense(max_weeks: int) -> list:
    return [
        F.expr(f"coalesce(sum(if(week_idx = {k}, sum_click, null)), 0)").alias(name)
        for k, name in enumerate(week_columns(max_weeks))
    ]


def click_aggregates(max_weeks: int = MAX_WEEKS) -> list:
    """Dense weekly columns, total clicks and active weeks over rows (week_idx, sum_click).

    Weeks past the matrix are cut from it but still count in the two totals.
    """
    return [
        *_dense(max_weeks),
        F.coalesce(F.sum("sum_click"), F.lit(0)).alias("total_clicks"),
        F.count(F.when(F.col("sum_click") > 0, 1)).alias("active_weeks"),
    ]


def weekly_matrix(weekly: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """The long series as dense columns, 0 where a week is missing.

    One aggregate with a sum per column: what a task holds of a learner is one row before the shuffle, where a
    pivot would send a row for each week.
    """
    return weekly.groupBy("student_uid").agg(*_dense(max_weeks))


def active_weeks(weekly: DataFrame) -> DataFrame:
    """Weeks with clicks; the long series holds one row per week, so a plain count is distinct."""
    return (
        weekly.filter(F.col("sum_click") > 0)
        .groupBy("student_uid")
        .agg(F.count("*").alias("active_weeks"))
    )
