"""Weights of a network over all rows: loss and gradient from numpy tasks, steps of L-BFGS on the driver.

Model, loss and start are those of Spark's ``MultilayerPerceptronClassifier`` (sigmoid layers, softmax at
the end, mean cross entropy); what takes its time there are the matrix products of each pass.
"""

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.session import work_path

#: Rows whose matrix products are taken together.
TOGETHER = 1024
#: Steps that the curvature is known from, and points that a step looks at.
MEMORY, TRIES = 10, 20

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def fit_network(rows: DataFrame, estimator: MultilayerPerceptronClassifier) -> MultilayerPerceptronClassificationModel:
    """The estimator's network, fitted to features and labels of all rows.

    Rows are packed into arrays once, kept, and passed for each point that is looked at; a task sends one
    gradient. Products are taken in single precision, sums over arrays, loss and steps in double. A label that
    is no class is an error. No rows, and solvers other than L-BFGS, are left to the estimator.
    """
    if estimator.getSolver() != "l-bfgs":
        return estimator.fit(rows)
    layers = list(estimator.getLayers())
    blocks = _blocks(rows, estimator, layers[0]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        last = layers[-1]
        sizes = blocks.map(lambda block: (len(block), np.isin(block[:, -1], np.arange(last)).sum()))
        n, known = sizes.fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + int(b[1])))
        if n == 0:
            return estimator.fit(rows)
        if known < n:
            raise ValueError(f"{n - known} labels are not among the {last} classes")
        given = estimator.isDefined(estimator.initialWeights)
        start = estimator.getInitialWeights() if given else _with_weights(rows.sparkSession, estimator).weights
        found = minimise(_loss(blocks, n, layers), np.array(start.toArray()), estimator.getMaxIter(), estimator.getTol())
    finally:
        blocks.unpersist()
    return _with_weights(rows.sparkSession, estimator, found)


def _blocks(rows: DataFrame, estimator: MultilayerPerceptronClassifier, width: int) -> RDD:
    """Arrays of ``TOGETHER`` rows at most: the features, then the label (not a number if it is null)."""
    together = TOGETHER

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, together):
                part = batch.slice(i, together)
                values = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                labels = part.column(1).to_numpy(zero_copy_only=False)
                block = np.column_stack([values, labels]).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"block": [block.tobytes()]})

    values, label = vector_to_array(estimator.getFeaturesCol()), F.col(estimator.getLabelCol()).cast("double")
    packed = rows.select(values.alias("values"), label.alias("label")).mapInArrow(pack, "block binary")
    return packed.rdd.map(lambda row: np.frombuffer(row.block, np.float32).reshape(-1, width + 1))


def _with_weights(
    spark: SparkSession, estimator: MultilayerPerceptronClassifier, weights: np.ndarray | None = None
) -> MultilayerPerceptronClassificationModel:
    """The estimator's model with these weights, or those it starts from: a fit of no steps, by way of its file."""
    settings = {estimator.maxIter: 0}
    if weights is not None:
        settings[estimator.initialWeights] = Vectors.dense(weights)
    size, path = estimator.getLayers()[0], work_path(spark, "network")
    names = [estimator.getFeaturesCol(), estimator.getLabelCol()]
    rows = spark.createDataFrame([(Vectors.dense([0.0] * size), 0.0)], names)
    estimator.fit(rows, settings).save(path)  # read back, it has no summary of that row
    model = MultilayerPerceptronClassificationModel.load(path)
    model.set(model.maxIter, estimator.getMaxIter())
    if weights is not None and not estimator.isDefined(estimator.initialWeights):
        model.clear(model.initialWeights)
    return model


def _loss(blocks: RDD, n: int, layers: list[int]) -> Loss:
    """Mean cross entropy over all rows and its gradient, as a function of the weights."""

    def unpacked(flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Views: weights (outputs, inputs) and biases of each layer."""
        out, at = [], 0
        for inputs, outputs in zip(layers, layers[1:]):
            weights = flat[at : at + inputs * outputs].reshape(inputs, outputs).T
            at += inputs * outputs
            out.append((weights, flat[at : at + outputs]))
            at += outputs
        return out

    def add(parts: list, sums: list, values: np.ndarray, classes: np.ndarray) -> float:
        """Loss of some rows; adds their gradient to ``sums``."""
        seen = [values]
        for weights, bias in parts[:-1]:
            z = seen[-1] @ weights.T
            z += bias
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1.0
            seen.append(np.reciprocal(z, out=z))
        z = seen[-1] @ parts[-1][0].T + parts[-1][1]
        z -= z.max(axis=1, keepdims=True)
        lines = np.arange(len(z))
        own = z[lines, classes]
        np.exp(z, out=z)
        total = z.sum(axis=1, keepdims=True)
        loss = float(np.log(total).sum(dtype=np.float64) - own.sum(dtype=np.float64))
        z /= total
        z[lines, classes] -= 1.0
        for k in range(len(parts) - 1, -1, -1):
            sums[k][0][...] += z.T @ seen[k]
            sums[k][1][...] += z.sum(axis=0)
            if k:
                z = z @ parts[k][0]
                z *= seen[k]
                z *= 1.0 - seen[k]
        return loss

    def evaluate(flat: np.ndarray) -> tuple[float, np.ndarray]:
        def run(own: Iterator[np.ndarray]) -> Iterator[tuple[float, np.ndarray]]:
            gradient, loss = np.zeros(len(flat)), 0.0
            parts, sums = unpacked(flat.astype(np.float32)), unpacked(gradient)
            with np.errstate(over="ignore"):  # exp of a large number: an activation of 0
                for block in own:
                    loss += add(parts, sums, block[:, :-1], block[:, -1].astype(np.int64))
            yield loss, gradient

        found = blocks.mapPartitions(run).collect()
        loss = sum(part for part, _ in found)
        if not np.isfinite(loss):
            raise ValueError("a feature is not a number, or the weights have grown beyond all bounds")
        return loss / n, sum(part for _, part in found) / n

    return evaluate


def minimise(function: Loss, start: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """L-BFGS. It ends early where 20 steps, or the slope, promise less than ``tolerance`` of the loss."""
    at, (loss, gradient) = start, function(start)
    first, recent, pairs = loss, deque([loss], 20), deque(maxlen=MEMORY)
    for _ in range(steps):
        direction = _direction(gradient, pairs)
        length = 1.0 if pairs else 1.0 / max(np.linalg.norm(direction), 1e-300)
        found = _step(function, at, loss, gradient, direction, length)
        if found is None:
            break
        pairs.append((found[0] - at, found[2] - gradient))
        at, loss, gradient = found
        if np.linalg.norm(gradient) <= max(tolerance * abs(loss), 1e-8) or max(recent) - loss <= tolerance * abs(first):
            break
        recent.append(loss)
    return at


def _direction(gradient: np.ndarray, pairs: deque) -> np.ndarray:
    out, shares = -gradient, []
    for moved, turned in reversed(pairs):
        shares.append(moved @ out / (moved @ turned))
        out = out - shares[-1] * turned
    if pairs:
        moved, turned = pairs[-1]
        out = out * (moved @ turned / (turned @ turned))
    for (moved, turned), share in zip(pairs, reversed(shares)):
        out = out + (share - turned @ out / (moved @ turned)) * moved
    return out


def _step(function: Loss, at: np.ndarray, loss: float, gradient: np.ndarray, direction: np.ndarray, length: float):
    """The next point with its loss and gradient, by Wolfe's conditions; None where no way leads down."""
    slope, low, high = float(gradient @ direction), 0.0, np.inf
    if slope >= 0.0:
        return None
    for _ in range(TRIES):
        point = at + length * direction
        value, steepness = function(point)
        if value > loss + 1e-4 * length * slope:
            high = length
        elif steepness @ direction < 0.9 * slope:
            low = length
        else:
            return point, value, steepness
        length = (low + high) / 2 if high < np.inf else 2 * low
    return None
