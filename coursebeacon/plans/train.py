"""Models with Spark ML: boosting, weekly sequence, aggregate features, baselines, tuning."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.functions.scalars import hash_below, label_at, model_score
from coursebeacon.operators.overview import with_class_weight
from coursebeacon.operators.ranking import confusion_counts, ranking_metrics, score_histogram
from coursebeacon.plans.boosting import fit_boosting
from coursebeacon.plans.network import fit_network
from coursebeacon.plans.prefix_scores import staged_scores
from coursebeacon.schemas import MAX_WEEKS, METRICS, week_columns
from coursebeacon.session import checkpoint_root, staged
from coursebeacon.sources.models import save_model
from coursebeacon.sources.sinks import PREDICTION_COLUMNS, write_predictions

# The boosting parameters of the baseline model.
BOOSTING = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 3, "subsamplingRate": 0.9, "seed": 42}
VALIDATION_FRACTION = 0.2
VALIDATION_SEED = "validation-42"

Scorer = Callable[[DataFrame], DataFrame]


def with_sequence(df: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Vector of the weekly columns, in order of the weeks."""
    weeks = ", ".join(f"double(coalesce({c}, 0))" for c in week_columns(max_weeks))
    return df.withColumn("features", array_to_vector(F.expr(f"array({weeks})")))


def with_all_features(df: DataFrame, max_weeks: int = MAX_WEEKS) -> DataFrame:
    """Weekly columns and those aggregate metrics the table has; missing values count as 0."""
    names = [*week_columns(max_weeks), *[m for m in METRICS if m in df.columns]]
    values = ", ".join(f"double(coalesce({c}, 0))" for c in names)
    return df.withColumn("features", array_to_vector(F.expr(f"array({values})")))


def scorer(model, features: Scorer = lambda df: df, weekly: bool = False) -> Scorer:
    """Adds ``prob_pass``; scoring is a narrow map over the rows.

    ``weekly`` says that the inputs are the weekly columns first, so that all prefixes can be scored
    from one row (`plans.prefix_scores`).
    """

    def run(df: DataFrame) -> DataFrame:
        scored = model.transform(features(df))
        dropped = [c for c in scored.columns if c not in df.columns and c != "probability"]
        return scored.withColumn("prob_pass", vector_to_array("probability")[1]).drop("probability", *dropped)

    run.weekly_model = model if weekly else None
    return run


def predict(df: DataFrame, score: Scorer, inclusive: bool = True) -> DataFrame:
    scored = score(df)
    return scored.withColumn("predicted_label", label_at("prob_pass", inclusive=inclusive)).select(*PREDICTION_COLUMNS)


def train_boosting(train: DataFrame, **parameters) -> tuple[object, Scorer]:
    """Gradient boosted trees on all features. The long lineage is cut by checkpoints."""
    model = fit_boosting(with_all_features(train), GBTClassifier(labelCol="label", **{**BOOSTING, **parameters}))
    return model, scorer(model, with_all_features, weekly=True)


def train_sequence(train: DataFrame, max_weeks: int = MAX_WEEKS, **parameters) -> tuple[object, Scorer]:
    """Network over the weekly sequence; position in the vector carries the order of the weeks."""
    settings = {"layers": [max_weeks, 64, 32, 2], "maxIter": 50, "seed": 42, **parameters}

    def features(df: DataFrame) -> DataFrame:
        return with_sequence(df, max_weeks)

    model = fit_network(features(train), MultilayerPerceptronClassifier(labelCol="label", **settings))
    return model, scorer(model, features, weekly=True)


def train_aggregate(train: DataFrame) -> tuple[object, Scorer]:
    """Five aggregate metrics, min-max scaled; fitted on training rows only."""

    def features(df: DataFrame) -> DataFrame:
        known = df.na.drop(subset=["mean_score", "n_submitted", "total_clicks"])
        return known.withColumns({f"f_{m}": F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in METRICS})

    stages = [
        VectorAssembler(inputCols=[f"f_{m}" for m in METRICS], outputCol="assembled"),
        MinMaxScaler(inputCol="assembled", outputCol="features"),
        LogisticRegression(labelCol="label"),
    ]
    model = Pipeline(stages=stages).fit(features(train))
    return model, scorer(model, features)


def train_baselines(train: DataFrame) -> dict[str, Scorer]:
    """Linear model, forest and boosted trees on all features; the trees are all those of the baseline model."""
    rows = with_all_features(train)
    fitted = {
        "logistic_regression": LogisticRegression(labelCol="label").fit(rows),
        "random_forest": RandomForestClassifier(labelCol="label", seed=42).fit(rows),
    }
    scorers = {name: scorer(model, with_all_features, weekly=True) for name, model in fitted.items()}
    return scorers | {"boosting": train_boosting(train)[1]}


def quality(scored: DataFrame, score: str = "prob_pass") -> DataFrame:
    """One row: areas, composite score and rates at 0.5."""
    rows = scored.withColumn("all", F.lit(1))
    areas = ranking_metrics(score_histogram(rows, ["all"], score=score), ["all"])
    rates = confusion_counts(rows, ["all"], score=score)
    joined = areas.join(rates, "all").drop("all")
    return joined.withColumn("model_score", model_score("auc_pr", "auc_roc"))


def boosting_grid(estimator: GBTClassifier) -> list:
    return (
        ParamGridBuilder()
        .addGrid(estimator.maxIter, [50, 100, 300])
        .addGrid(estimator.maxDepth, [2, 3])
        .addGrid(estimator.subsamplingRate, [0.8, 1.0])
        .addGrid(estimator.stepSize, [0.05, 0.1])
        .build()
    )


@dataclass(frozen=True)
class Tuned:
    """The best configuration's model, and the score of each in grid order (None where it failed)."""

    bestModel: object
    scores: list[float | None]

    @property
    def score(self) -> Scorer:
        return scorer(self.bestModel, with_all_features)


def tune(train: DataFrame, estimator=None, grid: list | None = None, parallelism: int = 4) -> Tuned:
    """Best of a parameter grid under class weights; the earlier configuration wins a tie.

    Configurations are fitted on the training part of ``validation_split`` and judged by 0.6 * average
    precision + 0.4 * ROC area on the rest. One that cannot be fitted is left out, unless all fail.
    Numbers of boosted trees share one fit, of which the scores after fewer trees are taken.
    """
    checkpoint_root(train.sparkSession)
    if estimator is None:
        estimator = GBTClassifier(labelCol="label", weightCol="class_weight", seed=42)
    grid = boosting_grid(estimator) if grid is None else grid
    rows = staged(with_all_features(with_class_weight(train)).select("student_uid", "features", "label", "class_weight"), "tuning")
    fit, held = validation_split(rows)

    def judged(parameters) -> tuple[object, float | None, Exception | None]:
        try:
            model = estimator.fit(fit, parameters)
            scored = model.transform(held).withColumn("prob_pass", vector_to_array("probability")[1])
            return model, float(quality(scored).first()["model_score"]), None
        except Exception as error:  # an unfit configuration, kept for the case that none is left
            return None, None, error

    def judged_together(places: list[int]) -> list[tuple[object, float | None, Exception | None]]:
        """Configurations that differ in the number of trees only: one fit of the most, judged after each number."""
        if len(places) == 1:
            return [judged(grid[places[0]])]
        counts = [grid[i][estimator.maxIter] for i in places]
        try:
            model = estimator.fit(fit, grid[places[counts.index(max(counts))]])
            scored = staged(staged_scores(held, model, counts, ["label"]), "tuning-scores")
            each = [scored.select("label", F.col("scores")[k].alias("prob_pass")) for k in range(len(counts))]
            own = [float(quality(rows).first()["model_score"]) for rows in each]
            return [(model if n == max(counts) else None, score, None) for n, score in zip(counts, own)]
        except Exception as error:
            return [(None, None, error)] * len(places)

    groups = _same_path(estimator, grid)
    results: list[tuple[object, float | None, Exception | None]] = [(None, None, None)] * len(grid)
    with ThreadPoolExecutor(parallelism) as pool:
        for places, found in zip(groups, pool.map(judged_together, groups)):
            for i, result in zip(places, found):
                results[i] = result
    scores = [score for _, score, _ in results]
    known = [i for i, score in enumerate(scores) if score is not None]
    if not known:
        raise results[0][2]
    best = max(known, key=lambda i: (scores[i], -i))
    model = results[best][0] or estimator.fit(fit, grid[best])  # fewer trees than its group was fitted with
    return Tuned(model, scores)


def _same_path(estimator, grid: list) -> list[list[int]]:
    """Places of the grid, those together whose boosted trees begin alike."""
    groups: dict = {}
    for i, parameters in enumerate(grid):
        shares = isinstance(estimator, GBTClassifier) and estimator.maxIter in parameters
        rest = frozenset((p.name, v) for p, v in parameters.items() if p.name != "maxIter") if shares else i
        groups.setdefault(rest, []).append(i)
    return list(groups.values())


def write_tuned(tuned: Tuned, test: DataFrame, model_path: str, predictions_path: str) -> None:
    """Saves the winner and its predictions."""
    save_model(tuned.bestModel, model_path)
    write_predictions(predict(test, tuned.score), predictions_path)


def validation_split(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = hash_below("student_uid", VALIDATION_FRACTION, VALIDATION_SEED)
    return train.filter(~held), train.filter(held)
