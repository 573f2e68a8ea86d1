"""Weekly activity from streams of events and click records.

Each micro-batch is summed on its own and appended; the parts are added up when they are read. There
is no state and no watermark, so nothing is ever too late, whatever order the files come in.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.operators.activity import with_week_index
from coursebeacon.schemas import COURSE


def weekly_events(events: DataFrame) -> DataFrame:
    """Count and total of a batch per learner, event type and tumbling week of event time."""
    week = F.window(F.col("ts").cast("timestamp"), "7 days")
    return (
        events.groupBy("user_id", "event_type", week.alias("week"))
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("total_value"))
        .select("user_id", "event_type", F.col("week.start").alias("week_start"), "n_events", "total_value")
    )


def total_events(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id", "event_type", "week_start").agg(
        F.sum("n_events").alias("n_events"), F.sum("total_value").alias("total_value")
    )


def learner_weeks(clicks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Clicks of a batch per learner and course week; the week starts at the course's own first day."""
    timed = with_week_index(clicks, calendar.select(*COURSE, "min_date"))
    return timed.groupBy("id_student", "week_idx").agg(F.sum("sum_click").alias("sum_click"))


def total_per_week(parts: DataFrame) -> DataFrame:
    return parts.groupBy("id_student", "week_idx").agg(F.sum("sum_click").alias("sum_click"))
