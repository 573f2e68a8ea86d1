"""What-if views: class sliders, learner requests and presets, real-versus-simulated comparison."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.learning_index import FULL_SCALE, fallback_probability, learning_index, normalised
from coursebeacon.functions.scalars import clamp, label_at, percent_change
from coursebeacon.schemas import DEFAULT_RISK_THRESHOLD, MAX_WEEKS, METRICS, week_columns


@dataclass(frozen=True)
class Sliders:
    """Percent change per metric; the ordinary range is -50 to 50."""

    total_clicks: float = 0.0
    n_submitted: float = 0.0
    mean_score: float = 0.0
    completion: float = 0.0
    active_weeks: float = 0.0

    def of(self, metric: str) -> float:
        return float(getattr(self, metric))


def class_whatif(df: DataFrame, sliders: Sliders) -> DataFrame:
    """Adds ``sim_<metric>`` and the index before and after."""
    changed = df.withColumns({f"sim_{m}": percent_change(m, sliders.of(m)) for m in METRICS})
    return changed.withColumns({
        "learning_index": learning_index(),
        "sim_learning_index": learning_index({m: f"sim_{m}" for m in METRICS}),
    })


@dataclass(frozen=True)
class Preset:
    """Change of one learner's inputs: clicks times a factor, the others plus a delta."""

    name: str
    click_factor: float
    submit_delta: float
    score_delta: float
    completion_delta: float  # in percent points
    week_delta: float

    def inputs(self) -> dict[str, Column]:
        """The five inputs after the change, clamped and cut to whole numbers; completion in percent."""
        up = self.submit_delta > 0
        submits = F.col("n_submitted") + F.lit(float(self.submit_delta))
        weeks = F.col("active_weeks") + F.lit(float(self.week_delta))
        score = F.col("mean_score") + F.lit(float(self.score_delta))
        done = F.coalesce("completion", F.lit(0.0)) * 100.0 + F.lit(float(self.completion_delta))
        # improvements are capped from above, setbacks from below
        return {
            "total_clicks": F.col("total_clicks") * F.lit(self.click_factor),
            "n_submitted": submits if up else clamp(submits, low=0),
            "mean_score": clamp(score, high=100) if up else clamp(score, low=0),
            "completion": clamp(done, high=100) if up else clamp(done, low=0),
            "active_weeks": clamp(weeks, high=20) if up else clamp(weeks, low=0),
        }


# The learner presets.
PRESETS = [
    Preset("exam_season", 1.25, 1, 3, 5, 1),
    Preset("holiday", 0.7, -1, -2, -8, -1),
    Preset("intervention", 1.15, 1, 2, 10, 1),
    Preset("drop_risk", 0.5, -2, -5, -20, -2),
]


def preset_requests(df: DataFrame, presets: list[Preset] = PRESETS, keep: list[str] | None = None) -> DataFrame:
    """One request row per learner and preset with ``in_<metric>`` inputs; fanned out in place."""
    rows = []
    for p in presets:
        values = p.inputs()
        rows.append(F.struct(F.lit(p.name).alias("preset"), *[
            F.floor(values[m]).cast("bigint").alias(f"in_{m}") for m in METRICS
        ]))
    # floor equals truncation: every input is at or above zero once clamped, clicks always are
    return df.select(*(keep or ["student_uid", *METRICS]), F.inline(F.array(*rows)))


def simulate_learner(requests: DataFrame, risk_threshold: float = DEFAULT_RISK_THRESHOLD,
                     model=None) -> DataFrame:
    """Probability, label (cut above 0.5), risk and alert of request rows.

    ``model`` is an optional fitted pipeline with ``prob_pass`` output over normalised inputs.
    """
    shares = {m: F.col(f"in_{m}").cast("double") for m in METRICS}
    shares["completion"] = shares["completion"] / 100.0
    if model is None:
        scored = requests.withColumn("prob_pass", fallback_probability(shares))
    else:
        scored = model(requests.withColumns({f"x_{m}": shares[m] / FULL_SCALE[m] for m in METRICS}))
    return scored.withColumns({
        "predicted_label": label_at("prob_pass", inclusive=False),
        "prob_risk": F.lit(1.0) - F.col("prob_pass"),
    }).withColumn("alert", F.col("prob_risk") >= F.lit(float(risk_threshold)))


def twin_delta(requests: DataFrame, keep: list[str]) -> DataFrame:
    """Per metric: real and simulated share of full scale in percent, and their difference."""
    rows = []
    for m in METRICS:
        real = normalised(m, F.coalesce(F.col(m).cast("double"), F.lit(0.0)))
        given = F.col(f"in_{m}").cast("double")
        simulated = normalised(m, given / 100.0 if m == "completion" else given)
        rows.append(F.struct(
            F.lit(m).alias("metric"), (real * 100.0).alias("real_pct"),
            (simulated * 100.0).alias("simulated_pct"), ((simulated - real) * 100.0).alias("delta_pct"),
        ))
    return requests.select(*keep, F.inline(F.array(*rows)))


def weekly_trend(df: DataFrame, simulated_clicks: Column | str, keep: list[str],
                 max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Weekly series next to itself rescaled to the simulated total; weeks count from 1."""
    total = F.greatest(F.coalesce("total_clicks", F.lit(1)), F.lit(1)).cast("double")
    goal = simulated_clicks if isinstance(simulated_clicks, Column) else F.col(simulated_clicks)
    rows = [
        F.struct(F.lit(k + 1).alias("week"), F.col(c).alias("real_clicks"),
                 (F.col(c) * (goal / total)).alias("simulated_clicks"))
        for k, c in enumerate(week_columns(max_weeks))
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def learner_profile(df: DataFrame, uid: str | None = None, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Current metrics and weekly series (weeks from 1) in long form, of one learner or of all."""
    chosen = df if uid is None else df.filter(F.col("student_uid") == uid)
    current = [
        F.struct(F.lit(m).alias("series"), F.lit(0).alias("week"),
                 F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("value"))
        for m in METRICS
    ]
    weeks = [
        F.struct(F.lit("weekly_clicks").alias("series"), F.lit(k + 1).alias("week"),
                 F.col(c).cast("double").alias("value"))
        for k, c in enumerate(week_columns(max_weeks))
    ]
    return chosen.select("student_uid", F.inline(F.array(*current, *weeks)))


def learner(df: DataFrame, uid: str) -> DataFrame:
    """Point lookup; the filter reaches the scan."""
    return df.filter(F.col("student_uid") == uid).limit(1)
