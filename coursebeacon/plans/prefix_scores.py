"""Model scores of every prefix of the weeks, with each learner read once.

A prefix is the row with later weeks unseen. Scoring twenty masked copies repeats what does not
change from week to week; here a week adds only what it brings. A linear model's margin is a running
sum, plain arithmetic on the wide row. The first layer of a network is a running sum per neuron. A
boosted tree is walked anew only in weeks that it splits on; in all others its value stays.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from coursebeacon.schemas import MAX_WEEKS, METRICS, week_columns
from coursebeacon.session import work_path

SUPPORTED = (LogisticRegressionModel, MultilayerPerceptronClassificationModel, GBTClassificationModel)
#: Rows whose prefixes are scored together.
TOGETHER = 2048


def feature_names(df: DataFrame, model, max_weeks: int = MAX_WEEKS) -> list[str]:
    """The weekly columns, then as many metrics as the model has inputs for."""
    names = [*week_columns(max_weeks), *[m for m in METRICS if m in df.columns]]
    if model.numFeatures not in (max_weeks, len(names)):
        raise ValueError(f"the model has {model.numFeatures} inputs, the table {len(names)}")
    return names[: model.numFeatures]


def _linear(df: DataFrame, model: LogisticRegressionModel, names: list[str], keep: list[str], max_weeks: int) -> DataFrame:
    weights = [float(w) for w in model.coefficients.toArray()]
    values = [f"double(coalesce(`{name}`, 0)) * {w!r}D" for name, w in zip(names, weights)]
    fixed = " + ".join([f"{float(model.intercept)!r}D", *values[max_weeks:]])
    scores = [f"1D / (1D + exp(-({' + '.join([fixed, *values[: t + 1]])})))" for t in range(max_weeks)]
    return df.select(*keep, F.expr(f"array({', '.join(scores)})").alias("scores"))


def _network(model: MultilayerPerceptronClassificationModel, max_weeks: int):
    """Function from rows (n, features) to scores (n, weeks)."""
    sizes, flat, layers, at = list(model.getLayers()), model.weights.toArray(), [], 0
    for inputs, outputs in zip(sizes, sizes[1:]):
        weights = flat[at : at + inputs * outputs].reshape(outputs, inputs, order="F")
        at += inputs * outputs
        layers.append((weights, flat[at : at + outputs]))
        at += outputs

    def score(rows: np.ndarray) -> np.ndarray:
        first, bias = layers[0]
        brought = rows[:, :max_weeks, None] * first.T[None, :max_weeks]  # of each week to each neuron
        values = np.cumsum(brought, axis=1) + (rows[:, max_weeks:] @ first.T[max_weeks:] + bias)[:, None]
        for weights, bias in layers[1:]:
            values = (1.0 / (1.0 + np.exp(-values))) @ weights.T + bias
        return 1.0 / (1.0 + np.exp(values[..., 0] - values[..., 1]))

    return score


def _trees(spark, model: GBTClassificationModel) -> list[tuple[float, dict[int, tuple]]]:
    """(weight, nodes) of each tree, from the model as it is stored: id -> (feature, threshold, left, right, value)."""
    path = work_path(spark, "boosting")
    model.save(path)
    nodes: list[dict[int, tuple]] = [{} for _ in range(model.getNumTrees)]
    data = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    for r in data.toLocalIterator():
        split = r["split"]
        if r["leftChild"] >= 0 and split["numCategories"] >= 0:
            raise ValueError("trees with categories are not known here")
        threshold = split["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0
        nodes[r["treeID"]][r["id"]] = (split["featureIndex"], threshold, r["leftChild"], r["rightChild"], r["prediction"])
    return list(zip(model.treeWeights, nodes))


def _walk(nodes: dict[int, tuple], rows: np.ndarray, seen: int, max_weeks: int) -> np.ndarray:
    """Values of a tree for rows of which ``seen`` weeks are known, the others 0."""
    out = np.empty(len(rows))
    todo = [(0, np.arange(len(rows)))]
    while todo:
        at, chosen = todo.pop()
        feature, threshold, left, right, value = nodes[at]
        if left < 0:
            out[chosen] = value
        elif seen <= feature < max_weeks:
            todo.append((left if 0.0 <= threshold else right, chosen))
        else:
            goes = rows[chosen, feature] <= threshold
            todo += [(left, chosen[goes]), (right, chosen[~goes])]
    return out


def _boosting(trees: list[tuple[float, dict[int, tuple]]], max_weeks: int):
    # the number of known weeks from which on a tree can have another value than with one week less
    turns = [sorted({1, *[f + 1 for f, _, left, _, _ in nodes.values() if left >= 0 and f < max_weeks]}) for _, nodes in trees]

    def score(rows: np.ndarray) -> np.ndarray:
        margins = np.zeros((len(rows), max_weeks))
        for (weight, nodes), starts in zip(trees, turns):
            for start, stop in zip(starts, [*starts[1:], max_weeks + 1]):
                margins[:, start - 1 : stop - 1] += weight * _walk(nodes, rows, start, max_weeks)[:, None]
        return 1.0 / (1.0 + np.exp(-2.0 * margins))

    return score


def _mapped(rows: DataFrame, score, width: int) -> DataFrame:
    """``rows``, whose last column holds feature arrays, with ``scores`` of ``width`` values in its place."""
    schema = StructType([*rows.schema.fields[:-1], StructField("scores", ArrayType(DoubleType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(start, TOGETHER)
                flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
                found = score(flat.reshape(batch.num_rows, -1))
                edges = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width)
                lists = pa.ListArray.from_arrays(edges, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def staged_scores(df: DataFrame, model: GBTClassificationModel, counts: list[int], keep: list[str], features: str = "features") -> DataFrame:
    """``keep`` and ``scores``: the probability by the first n trees, for each n of ``counts``.

    Trees are fitted one after the other, so the first n of a longer fit are those of a fit of n.
    """
    trees = _trees(df.sparkSession, model)

    def score(rows: np.ndarray) -> np.ndarray:
        margins, total = {}, np.zeros(len(rows))
        for n, (weight, nodes) in enumerate(trees, 1):
            total = total + weight * _walk(nodes, rows, 0, 0)
            if n in counts:
                margins[n] = total
        return 1.0 / (1.0 + np.exp(-2.0 * np.stack([margins[n] for n in counts], axis=1)))

    return _mapped(df.select(*keep, vector_to_array(features).alias("_values")), score, len(counts))


def prefix_scores(df: DataFrame, model, keep: list[str], max_weeks: int = MAX_WEEKS) -> DataFrame:
    """``keep`` and ``scores``: the probability of a pass after each week, an array per row of ``df``.

    Equal to the model's own score of the row with later weeks set to 0. Missing values count as 0.
    """
    names = feature_names(df, model, max_weeks)
    if isinstance(model, LogisticRegressionModel):
        return _linear(df, model, names, keep, max_weeks)
    if isinstance(model, MultilayerPerceptronClassificationModel):
        score = _network(model, max_weeks)
    elif isinstance(model, GBTClassificationModel):
        score = _boosting(_trees(df.sparkSession, model), max_weeks)
    else:
        raise ValueError(f"no prefix scores for {type(model).__name__}")
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names]
    rows = df.select(*keep, F.array(*values).alias("_values"))
    return _mapped(rows, score, max_weeks)
