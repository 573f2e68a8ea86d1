"""The early-warning report: at-risk list, KPIs, explanation, advice."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from coursebeacon.functions.learning_index import learning_index
from coursebeacon.functions.scalars import percent_change
from coursebeacon.operators.enrolments import attach_predictions
from coursebeacon.operators.metric_log import latest_threshold
from coursebeacon.operators.warning import advice, explain_at_risk, mark_at_risk, ranked_at_risk, warning_kpis
from coursebeacon.operators.whatif import Sliders
from coursebeacon.schemas import DEFAULT_INDEX_THRESHOLD, METRICS


@dataclass(frozen=True)
class Report:
    marked: DataFrame
    ranked: DataFrame
    kpis: DataFrame
    explanation: DataFrame
    advice: DataFrame


def early_warning(
    learners: DataFrame,
    predictions: DataFrame | None = None,
    log: DataFrame | None = None,
    sliders: Sliders = Sliders(),
    index_threshold: float = DEFAULT_INDEX_THRESHOLD,
    risk_threshold: Column | float | None = None,
    k: int | None = None,
) -> Report:
    """The risk threshold is the latest one of the evaluation log unless given."""
    theta = latest_threshold(log) if risk_threshold is None else risk_threshold
    joined = attach_predictions(learners, predictions)
    simulated = joined.withColumns({m: percent_change(m, sliders.of(m)) for m in METRICS})
    marked = mark_at_risk(simulated.withColumn("learning_index", learning_index()),
                          index_threshold, theta, "learning_index")
    return Report(marked, ranked_at_risk(marked, k), warning_kpis(marked),
                  explain_at_risk(marked), advice(marked))
