"""Boosted trees over all rows: histograms from numpy tasks, splits chosen on the driver.

Trees, loss and steps are those of Spark's ``GBTClassifier`` (regression trees on the residuals of the
logistic loss, by variance); what takes its time there are rows as objects, read anew for each level.
"""

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.session import checkpoint_root, work_path

#: Rows of an array, and rows of a task where there are more than two tasks a core.
TOGETHER, TASK_ROWS = 1 << 16, 1 << 21
#: Points that sum up the distribution of a feature with more values.
POINTS = 1024
#: Deeper trees and finer bins are left to the library.
DEEPEST, FINEST = 8, 256
#: Gains up to this one are errors of rounding: residuals are 2 at most.
ROUNDING = 1e-12
NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
    "gain double, leftChild int, rightChild int, "
    "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)

#: Values of a feature in order, and the rows at each.
Points = tuple[np.ndarray, np.ndarray]


@dataclass
class Tree:
    """Nodes by place: the root is 1, below ``k`` are ``2 k`` (values up to the cut) and ``2 k + 1``."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)  # feature, last bin that goes left
    gains: dict[int, float] = field(default_factory=dict)
    sums: dict[int, tuple[float, float]] = field(default_factory=dict)  # rows, residuals
    squares: dict[int, float] = field(default_factory=dict)  # of the residuals

    def values(self, size: int) -> np.ndarray:
        out = np.zeros(size, np.float32)
        for place, (n, total) in self.sums.items():
            out[place] = total / n
        return out


def fit_boosting(rows: DataFrame, estimator: GBTClassifier) -> GBTClassificationModel:
    """The estimator's trees, fitted to features and labels of all rows.

    Features are cut into bins by the distribution of all rows. Rows are kept as arrays of bins; a task sends one
    histogram a level, only of the smaller child of each split. Labels other than 0 and 1, and features that are no
    finite numbers, are an error. No rows, weights, subsets of features, early stops, trees deeper than 8 and more
    than 256 bins are left to the estimator.
    """
    if not _plain(estimator):
        return estimator.fit(rows)
    spark, raw = rows.sparkSession, _raw(rows, estimator)
    n, points = _distribution(raw)
    if n == 0:
        return estimator.fit(rows)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    cuts = [thresholds(values, counts, estimator.getMaxBins()) for values, counts in points]
    depth, bits = estimator.getMaxDepth(), (estimator.getMaxBins() - 1).bit_length()
    size, every = 2 << depth, max(estimator.getCheckpointInterval(), 1)
    binned, histograms, advance = _passes(cuts, bits, size, estimator.getSubsamplingRate(), estimator.getSeed())
    tasks = min(raw.getNumPartitions(), max(2 * spark.sparkContext.defaultParallelism, n // TASK_ROWS))
    blocks, before = raw.coalesce(tasks).mapPartitionsWithIndex(binned).persist(StorageLevel.MEMORY_AND_DISK), None
    trees: list[Tree] = []
    saved: list[str] = []

    def passed(number: int, splits: dict, chosen: list[int]) -> np.ndarray:
        found = blocks.mapPartitions(histograms(number, splits, chosen)).collect()
        if trees and not trees[-1].squares:  # the first pass since the last tree
            squares = sum(part for _, part in found)
            trees[-1].squares = {place: float(squares[place]) for place in trees[-1].sums}
        return sum(part for part, _ in found)

    try:
        for number in range(estimator.getMaxIter()):
            tree = grow(lambda splits, chosen: passed(number, splits, chosen), estimator)
            if before is not None:
                before.unpersist()
            if blocks.isCheckpointed():
                saved.append(blocks.getCheckpointFile())
                _remove(spark, saved[:-1])
                del saved[:-1]
            trees.append(tree)
            weight = estimator.getStepSize() if number else 1.0
            before, blocks = blocks, blocks.map(advance(number, tree.splits, weight * tree.values(size)))
            blocks.persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % every == 0 and number + 1 < estimator.getMaxIter():
                blocks.checkpoint()  # ends the chain of passes that the margins come from
        passed(estimator.getMaxIter(), {}, [])
    finally:
        blocks.unpersist()
        if before is not None:
            before.unpersist()
        _remove(spark, saved)
    return _model(spark, estimator, trees, cuts)


def _plain(estimator: GBTClassifier) -> bool:
    special = any(estimator.isDefined(p) for p in (estimator.weightCol, estimator.validationIndicatorCol))
    return (
        not special and estimator.getFeatureSubsetStrategy() in ("all", "auto") and estimator.getImpurity() == "variance"
        and estimator.getMinWeightFractionPerNode() == 0.0 and estimator.getMaxDepth() <= DEEPEST
        and estimator.getMaxBins() <= FINEST
    )


def _raw(rows: DataFrame, estimator: GBTClassifier) -> RDD:
    """Arrays of rows: the features, then the label (not a number if it is null)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                block = np.column_stack([values, batch.column(1).to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_pydict({"width": [block.shape[1]], "block": [block.astype(np.float64).tobytes()]})

    values, label = vector_to_array(estimator.getFeaturesCol()), F.col(estimator.getLabelCol()).cast("double")
    packed = rows.select(values.alias("values"), label.alias("label")).mapInArrow(pack, "width long, block binary")
    return packed.rdd.map(lambda row: np.frombuffer(row.block, np.float64).reshape(-1, row.width))


def _distribution(raw: RDD) -> tuple[int, list[Points]]:
    """Number of rows, and the values of each feature; of many, points with the rows up to them."""
    limit = POINTS

    def fewer(values: np.ndarray, counts: np.ndarray) -> Points:
        if len(values) <= limit:
            return values, counts
        up_to = np.cumsum(counts)
        kept = np.unique(np.searchsorted(up_to, up_to[-1] * np.arange(1, limit + 1) / limit))
        return values[kept], np.diff(up_to[kept], prepend=0)

    def both(a: Points, b: Points) -> Points:
        values, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
        return fewer(values, np.bincount(place, np.concatenate([a[1], b[1]])).astype(np.int64))

    def merged(a: tuple, b: tuple) -> tuple:
        if not (a[0] and b[0]):
            return a if a[0] else b
        return a[0] + b[0], a[1] + b[1], [both(x, y) for x, y in zip(a[2], b[2])]

    def run(own: Iterator[np.ndarray]) -> Iterator[tuple]:
        total: tuple = (0, 0, [])
        for values in own:
            known = np.isfinite(values[:, :-1]).all(axis=1) & np.isin(values[:, -1], [0.0, 1.0])
            columns = [fewer(*np.unique(values[known, f], return_counts=True)) for f in range(values.shape[1] - 1)]
            total = merged(total, (len(values), int((~known).sum()), columns))
        yield total

    n, wrong, points = raw.mapPartitions(run).treeReduce(merged)
    if wrong:
        raise ValueError(f"{wrong} rows have a label other than 0 and 1, or a feature that is no finite number")
    return n, points


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between values, all of them or those that part the rows most evenly."""
    middles = values[:-1] / 2 + values[1:] / 2
    if len(middles) < bins:
        return middles
    up_to = np.cumsum(counts)
    wanted = up_to[-1] * np.arange(1, bins) / bins
    at = np.clip(np.searchsorted(up_to, wanted), 1, len(values) - 1)
    at -= np.abs(up_to[at - 1] - wanted) <= np.abs(up_to[at] - wanted)
    return middles[np.unique(np.minimum(at, len(middles) - 1))]


def _passes(cuts: list[np.ndarray], bits: int, size: int, rate: float, seed: int) -> tuple[Callable, Callable, Callable]:
    """Functions of the tasks: arrays of bins from rows, histograms of a level, and the step to the next tree.

    A block has its name, codes (bins of two features in a number), labels -1 and 1, margins, residuals, and by place
    the squared residuals that the last tree was fitted to.
    """
    width, pairs, together = len(cuts), (len(cuts) + 1) // 2, TOGETHER

    def joined(own: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        parts, n = [], 0
        for values in own:
            parts.append(values)
            n += len(values)
            if n >= together:
                yield np.concatenate(parts)
                parts, n = [], 0
        if parts:
            yield np.concatenate(parts)

    def binned(index: int, own: Iterator[np.ndarray]) -> Iterator[tuple]:
        for k, values in enumerate(joined(own)):
            codes = np.zeros((pairs, len(values)), np.uint16)
            for f, cut in enumerate(cuts):
                bins = np.searchsorted(cut, np.ascontiguousarray(values[:, f])).astype(np.uint16)
                codes[f // 2] |= bins if f % 2 else bins << bits
            labels = (2 * values[:, -1] - 1).astype(np.int8)
            yield (index, k), codes, labels, np.zeros(len(labels), np.float32), labels.astype(np.float32), np.zeros(size)

    def placed(codes: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
        at = np.ones(codes.shape[1], np.uint16)
        for place in sorted(splits):
            feature, cut = splits[place]
            rows = slice(None) if place == 1 else np.flatnonzero(at == place)
            own = codes[feature // 2][rows]
            own = own & ((1 << bits) - 1) if feature % 2 else own >> bits
            at[rows] = 2 * place + (own > cut)
        return at

    def sampled(name: tuple[int, int], n: int, number: int) -> np.ndarray:
        if rate >= 1.0:
            return np.ones(n, bool)
        return np.random.default_rng([seed % 2**64, number, *name]).random(n, np.float32) < rate

    def histograms(number: int, splits: dict[int, tuple[int, int]], chosen: list[int]) -> Callable:
        """Rows and residuals of the chosen places by feature and bin, and the squares of the last tree."""

        def run(own: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            slot_of = np.full(size, -1, np.int64)
            slot_of[chosen] = np.arange(len(chosen))
            cells = len(chosen) << 2 * bits
            sums, squares = np.zeros((2, pairs, cells)), np.zeros(size)
            for name, codes, labels, _, residuals, squared in own:
                squares += squared
                if not cells:
                    continue
                slots = slot_of[placed(codes, splits)]
                rows = np.flatnonzero((slots >= 0) & sampled(name, len(labels), number))
                base, weights = slots[rows] << 2 * bits, residuals[rows].astype(np.float64)
                for pair, line in enumerate(codes):
                    cell = base + line[rows]
                    sums[0, pair] += np.bincount(cell, minlength=cells)
                    sums[1, pair] += np.bincount(cell, weights, cells)
            each = sums.reshape(2, pairs, len(chosen), 1 << bits, 1 << bits)
            both = np.stack([each.sum(axis=4), each.sum(axis=3)], axis=2)  # the pair's first and second feature
            both = both.reshape(2, 2 * pairs, len(chosen), 1 << bits)[:, :width]
            yield both.swapaxes(1, 2).copy(), squares

        return run

    def advance(number: int, splits: dict[int, tuple[int, int]], values: np.ndarray) -> Callable:
        def run(block: tuple) -> tuple:
            name, codes, labels, margins, residuals, _ = block
            at = placed(codes, splits)
            rows = np.flatnonzero(sampled(name, len(labels), number))
            squared = np.bincount(at[rows], residuals[rows].astype(np.float64) ** 2, size)
            margins = margins + values[at]
            with np.errstate(over="ignore"):  # exp of a large number: a residual of 0
                residuals = 4.0 * labels / (1.0 + np.exp(2.0 * labels * margins))
            return name, codes, labels, margins, residuals.astype(np.float32), squared

        return run

    return binned, histograms, advance


def grow(passed: Callable[[dict, list[int]], np.ndarray], estimator: GBTClassifier) -> Tree:
    """A tree, level by level; ``passed`` gives the histograms (rows and residuals, place, feature, bin) of places."""
    tree, least = Tree(), estimator.getMinInstancesPerNode()
    found = {1: passed({}, [1])[:, 0]}
    tree.sums[1] = tuple(found[1][:, 0].sum(axis=1))
    for level in range(estimator.getMaxDepth()):
        split = []
        for place, histogram in found.items():
            best = best_split(histogram, least, estimator.getMinInfoGain())
            if best is not None:
                tree.gains[place], *tree_split = best
                tree.splits[place] = tuple(tree_split)
                left = histogram[:, tree_split[0], : tree_split[1] + 1].sum(axis=1)
                tree.sums[2 * place] = tuple(left)
                tree.sums[2 * place + 1] = tuple(np.array(tree.sums[place]) - left)
                split.append(place)
        if not split or level + 1 == estimator.getMaxDepth():
            break
        smaller = [min(2 * place, 2 * place + 1, key=lambda k: tree.sums[k][0]) for place in split]
        counted = passed(tree.splits, smaller)
        own = {place: counted[:, k] for k, place in enumerate(smaller)}
        found = own | {place ^ 1: found[place // 2] - histogram for place, histogram in own.items()}
    return tree


def best_split(histogram: np.ndarray, least: int, least_gain: float) -> tuple[float, int, int] | None:
    """(gain, feature, last bin that goes left) of the split that lowers the variance most, the first of equals."""
    left = np.cumsum(histogram, axis=2)[:, :, :-1]
    whole = histogram[:, :1].sum(axis=2, keepdims=True)
    right = whole - left
    allowed = (left[0] >= max(least, 1)) & (right[0] >= max(least, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        gains = (left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]) / whole[0]
    gains = np.where(allowed, gains, -np.inf)
    equal = gains >= gains.max(initial=-np.inf) * (1.0 - 1e-9)  # but for rounding
    feature, cut = np.unravel_index(int(equal.argmax()), gains.shape)
    gain = float(gains[feature, cut])
    return None if gain <= ROUNDING or gain < least_gain else (gain, int(feature), int(cut))


def _nodes(tree: Tree, cuts: list[np.ndarray]) -> list[tuple]:
    """The nodes as they are stored, numbered in the order root, left, right."""
    out: list[tuple] = []

    def squares(place: int) -> float:
        return tree.squares[place] if place not in tree.splits else squares(2 * place) + squares(2 * place + 1)

    def add(place: int) -> int:
        number, (n, total), squared = len(out), tree.sums[place], squares(place)
        out.append(())
        spread = max((squared - total * total / n) / n, 0.0)
        told = (number, total / n, spread, [n, total, squared], int(n))
        if place in tree.splits:
            feature, cut = tree.splits[place]
            children = add(2 * place), add(2 * place + 1)
            out[number] = (*told, tree.gains[place], *children, (feature, [float(cuts[feature][cut])], -1))
        else:
            out[number] = (*told, -1.0, -1, -1, (-1, [], -1))
        return number

    add(1)
    return [tuple(float(x) if isinstance(x, np.floating) else [float(y) for y in x] if isinstance(x, list) else x for x in node)
            for node in out]


def _model(spark: SparkSession, estimator: GBTClassifier, trees: list[Tree], cuts: list[np.ndarray]) -> GBTClassificationModel:
    """The estimator's model with these trees, by way of its file: that of a fit of one tree, with other trees."""
    one, path = work_path(spark, "boosting"), work_path(spark, "boosting")
    names = [estimator.getFeaturesCol(), estimator.getLabelCol()]
    rows = spark.createDataFrame([(Vectors.dense([0.0] * len(cuts)), 0.0), (Vectors.dense([1.0] * len(cuts)), 1.0)], names)
    estimator.fit(rows, {estimator.maxIter: 1, estimator.maxDepth: 1}).save(one)
    about = json.loads(spark.read.text(f"{one}/metadata").first()[0])
    about |= {"numTrees": len(trees), "numFeatures": len(cuts)}
    kind = json.loads(spark.read.parquet(f"{one}/treesMetadata").first()[1])
    for told in (about, kind):
        for name in ("maxIter", "maxDepth"):
            if name in told["paramMap"]:
                told["paramMap"][name] = estimator.getOrDefault(name)
    kinds = [(k, json.dumps(kind), estimator.getStepSize() if k else 1.0) for k in range(len(trees))]
    nodes = [(k, node) for k, tree in enumerate(trees) for node in _nodes(tree, cuts)]
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(kinds, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def _remove(spark: SparkSession, folders: list[str]) -> None:
    """Tables of margins that no later pass needs."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
