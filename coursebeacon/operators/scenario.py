"""Cohort scenarios: a share of the learners changes its behaviour."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import clamp, hash_below
from coursebeacon.schemas import METRICS, SNAPSHOT_NAMES, week_columns


@dataclass(frozen=True)
class Scenario:
    name: str
    click_factor: float
    submit_delta: int
    score_delta: float
    completion_delta: float
    active_weeks_delta: int
    fraction: float


# The scenario catalogue and the share of learners each one touches.
SCENARIOS = [
    Scenario("baseline", 0.0, 0, 0.0, 0.0, 0, 0.3),
    Scenario("exam_season", 0.25, 1, 2.5, 0.05, 1, 0.3),
    Scenario("holiday", -0.3, -1, -2.0, -0.08, -1, 0.15),
    Scenario("early_intervention", 0.15, 1, 1.5, 0.1, 1, 0.3),
    Scenario("late_dropout", -0.5, -2, -5.0, -0.2, -2, 0.15),
]
NOISE_LIMIT = 0.03
SCENARIO_SEED = 7


def scenario_named(name: str) -> Scenario:
    for s in SCENARIOS:
        if s.name == name:
            return s
    raise KeyError(name)


def _changes(s: Scenario, noise: float = 0.0) -> dict[str, Column]:
    """What a scenario makes of each column in the cohort."""
    factor = F.lit(1.0 + s.click_factor)
    changes = {
        "total_clicks": clamp(F.col("total_clicks") * factor, low=0),
        "n_submitted": clamp(F.col("n_submitted") + F.lit(float(s.submit_delta)), 0, 10),
        "mean_score": clamp(F.col("mean_score") + F.lit(s.score_delta), 0, 100),
        "completion": clamp(F.col("completion") + F.lit(s.completion_delta), 0, 1),
        "active_weeks": clamp(F.col("active_weeks") + F.lit(float(s.active_weeks_delta)), 0, 20),
    }
    for w in week_columns():
        changes[w] = clamp(clamp(F.col(w) * factor, low=0) * F.lit(1.0 + noise), 0, 1)
    return changes


def scenario_means(df: DataFrame, scenarios: list[Scenario], seed: int | str = SCENARIO_SEED,
                   key: str = "student_uid") -> DataFrame:
    """One row of metric means per scenario, from one pass: each row is fanned out in place."""
    views = [
        F.struct(F.lit(s.name).alias("scenario"), *[
            F.when(hash_below(key, s.fraction, f"{seed}-{s.name}"), change).otherwise(F.col(m).cast("double")).alias(m)
            for m, change in _changes(s).items() if m in METRICS
        ])
        for s in scenarios
    ]
    fanned = df.select(F.inline(F.array(*views)))
    return fanned.groupBy("scenario").agg(*[F.avg(m).alias(out) for m, out in SNAPSHOT_NAMES.items()])


def apply_scenario(
    df: DataFrame,
    scenario: Scenario | str,
    fraction: float | None = None,
    seed: int | str = SCENARIO_SEED,
    noise: float = 0.0,
    key: str = "student_uid",
) -> DataFrame:
    """Change the hash-chosen cohort and clip it; other rows stay as they are.

    The clips hold for the cohort in every scenario, the baseline included: active weeks end at 20
    and submissions at 10. ``noise`` is one shared relative deviation of the weekly clicks.
    Columns the table lacks are skipped.
    """
    s = scenario_named(scenario) if isinstance(scenario, str) else scenario
    if abs(noise) > NOISE_LIMIT:
        raise ValueError(f"noise must stay within +-{NOISE_LIMIT}")
    share = s.fraction if fraction is None else fraction
    changes = _changes(s, noise)
    chosen = hash_below(key, share, f"{seed}-{s.name}")
    marked = df.withColumn("in_cohort", chosen)
    return marked.withColumns({
        c: F.when(F.col("in_cohort"), change).otherwise(F.col(c).cast("double"))
        for c, change in changes.items() if c in df.columns
    })
