"""Enrolments: key, label, known learners, label alignment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import student_uid
from coursebeacon.schemas import ENROLMENT, PASS_RESULTS


def require_columns(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {missing}; it has {df.columns}")
    return df


def enrolments(info: DataFrame) -> DataFrame:
    """One row per learner and course with composite key and 0/1 label."""
    require_columns(info, [*ENROLMENT, "final_result"], "student_info")
    passed = F.coalesce(F.col("final_result").isin(*PASS_RESULTS), F.lit(False))
    return (
        info.select(F.col("id_student").cast("bigint").alias("id_student"),
                    "code_module", "code_presentation", "final_result")
        .dropDuplicates()
        .withColumn("student_uid", student_uid())
        .withColumn("label", passed.cast("int"))
    )


def known_learners(info: DataFrame) -> DataFrame:
    return info.select("id_student").distinct()


def real_labels(enrolled: DataFrame) -> DataFrame:
    return enrolled.select("student_uid", "label", "final_result").distinct()


def _one_label(real: DataFrame) -> DataFrame:
    """A learner with several results has passed if any of them is a pass."""
    return real.groupBy("student_uid").agg(F.max("label").alias("label"))


def attach_labels(df: DataFrame, real: DataFrame, unknown_label: str = "zero") -> DataFrame:
    """Labels by key; a learner without a known label counts as 0 or is dropped."""
    labels = _one_label(real)
    how = {"zero": "left", "drop": "inner"}[unknown_label]
    joined = df.drop("label").join(labels, "student_uid", how)
    return joined.withColumn("label", F.coalesce("label", F.lit(0)))


def ensure_label(df: DataFrame, real: DataFrame | None = None) -> DataFrame:
    """Label join only when the table carries none; without any source the label is 0."""
    if "label" in df.columns:
        return df
    if real is None:
        return df.withColumn("label", F.lit(0))
    return df.join(_one_label(real), "student_uid", "left")


def attach_predictions(df: DataFrame, predictions: DataFrame | None) -> DataFrame:
    """Left join of predictions with the risk column; all NULL when there are none."""
    if predictions is None:
        return (
            df.withColumn("predicted_label", F.lit(None).cast("int"))
            .withColumn("prob_pass", F.lit(None).cast("double"))
            .withColumn("prob_risk", F.lit(None).cast("double"))
        )
    cols = predictions.select("student_uid", "predicted_label", "prob_pass")
    return df.join(cols, "student_uid", "left").withColumn(
        "prob_risk", F.lit(1.0) - F.coalesce("prob_pass", F.lit(0.5))
    )
