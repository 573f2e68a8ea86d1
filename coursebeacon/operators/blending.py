"""Blend of two models' predictions: search over weights, then apply."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import blend, label_at, model_score
from coursebeacon.operators.ranking import confusion_counts, ranking_metrics, score_histogram

# Weights of the first model that are tried, in this order.
BLEND_WEIGHTS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def common_predictions(real: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Truth with both probabilities, for the learners both models scored."""
    a = first.select("student_uid", F.col("prob_pass").alias("p_a"))
    b = second.select("student_uid", F.col("prob_pass").alias("p_b"))
    return (
        real.select("student_uid", "label")
        .join(a, "student_uid").join(b, "student_uid")
        .na.drop(subset=["p_a", "p_b"])
    )


def blend_search(common: DataFrame, weights: list[float] = BLEND_WEIGHTS) -> DataFrame:
    """Quality of every weight in one job; each row is read once and fanned out in place."""
    tried = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(w).alias("weight"))
                      for i, w in enumerate(weights)])
    scored = common.select("label", "p_a", "p_b", F.inline(tried)).withColumn(
        "score", blend(F.col("weight"), "p_a", "p_b")
    )
    keys = ["ordinal", "weight"]
    areas = ranking_metrics(score_histogram(scored, keys), keys)
    hits = confusion_counts(scored, keys).select(*keys, "f1")
    return areas.join(hits, keys).withColumn("model_score", model_score("auc_pr", "auc_roc"))


def best_weight(search: DataFrame) -> DataFrame:
    """One row: the best weight, the earliest tried on a tie."""
    order = F.struct("model_score", -F.col("ordinal"))
    return search.agg(F.max_by(F.struct(*search.columns), order).alias("_row")).select("_row.*")


def apply_blend(first: DataFrame, second: DataFrame, best: DataFrame) -> DataFrame:
    a = first.select("student_uid", F.col("prob_pass").alias("p_a"))
    b = second.select("student_uid", F.col("prob_pass").alias("p_b"))
    weight = best.select("weight").scalar()
    mixed = a.join(b, "student_uid").withColumn("_w", weight)
    mixed = mixed.select("student_uid", blend(F.col("_w"), "p_a", "p_b").alias("prob_pass"))
    return mixed.select("student_uid", label_at("prob_pass").alias("predicted_label"), "prob_pass")
