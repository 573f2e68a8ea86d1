"""Probability calibration per week, all weeks in one job: logistic (Platt) or isotonic.

The fits run on the distinct scores of the calibration share, as they are. The logistic fit is
Newton's method on sums per week: one aggregate per step. The isotonic fit is the lower convex hull of
the cumulative counts; hulls of score ranges merge into that of the week, so no task sees all points.
"""

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursebeacon.operators.ranking import BUCKET_WIDTH, enough_of_both, score_histogram
from coursebeacon.operators.splitting import with_exact_split
from coursebeacon.session import staged

CALIBRATION_FRACTION = 0.3
CALIBRATION_SEED = "calibration-42"
#: Newton steps at most, and the slope of the mean loss at which a fit is done.
STEPS, SLOPE = 200, 1e-12


def calibration_points(scored: DataFrame, key: str = "student_uid", written: bool = False) -> DataFrame:
    """(week, p, pos, neg): distinct scores of the calibration share with their positives and negatives.

    The share is exactly 30 % (rounded) of the rows of each week and label, chosen by a hash of the
    key; a missing label counts as 0. ``written`` says that ``scored`` is a written table.
    """
    rows = scored.withColumn("_label", F.coalesce("label", F.lit(0)))
    share = with_exact_split(rows, CALIBRATION_FRACTION, CALIBRATION_SEED, key, ["week", "_label"], written)
    return staged(score_histogram(share.filter("split = 'test'"), ["week"]), "calibration-points")


def _by_week(values: dict[int, float]) -> Column:
    return F.create_map(*[F.lit(x) for week, value in values.items() for x in (week, float(value))])[F.col("week")]


def _slopes(points: DataFrame, fits: dict[int, tuple[float, float]]) -> dict[int, dict[str, float]]:
    """Per week: loss, first and second derivatives at the parameters given."""
    a, b = (_by_week({week: fit[i] for week, fit in fits.items()}) for i in (0, 1))
    z, n, p = a * F.col("p") + b, F.col("pos") + F.col("neg"), F.col("p")
    q = 1.0 / (1.0 + F.exp(-z))
    error, weight = n * q - F.col("pos"), n * q * (1.0 - q)
    above = F.log1p(F.exp(-F.abs(z)))  # log(1 + exp(x)) is max(x, 0) and this
    loss = F.col("pos") * (F.greatest(-z, F.lit(0.0)) + above) + F.col("neg") * (F.greatest(z, F.lit(0.0)) + above)
    rows = points.filter(F.col("week").isin(list(fits))).groupBy("week").agg(
        F.sum(loss).alias("loss"), F.sum(error * p).alias("g0"), F.sum(error).alias("g1"),
        F.sum(weight * p * p).alias("h00"), F.sum(weight * p).alias("h01"), F.sum(weight).alias("h11"),
    )
    out = {}
    for row in rows.collect():
        slope = fits[row["week"]][0]
        penalty = {"loss": slope * slope / 2, "g0": slope, "h00": 1.0}  # L2 strength 1 on the slope, none on the intercept
        out[row["week"]] = {k: row[k] + penalty.get(k, 0.0) for k in ("loss", "g0", "g1", "h00", "h01", "h11")}
    return out


def fit_platt(points: DataFrame) -> dict[int, tuple[float, float]]:
    """(slope, intercept) of each week with both labels: a logistic fit on the score, L2 strength 1 as a sum over the rows.

    A step that does not lower a week's loss is halved.
    """
    sums = points.groupBy("week").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos > 0 AND neg > 0").collect()
    size = {r["week"]: r["pos"] + r["neg"] for r in sums}
    trial = {r["week"]: (0.0, math.log(r["pos"] / r["neg"])) for r in sums}
    best: dict[int, tuple[tuple[float, float], float]] = {}
    for _ in range(STEPS):
        if not trial:
            break
        for week, s in _slopes(points, trial).items():
            at = trial[week]
            if week in best and s["loss"] > best[week][1] + 1e-12 * abs(best[week][1]):
                kept = best[week][0]
                trial[week] = ((at[0] + kept[0]) / 2, (at[1] + kept[1]) / 2)
                if trial[week] == at or trial[week] == kept:
                    del trial[week]
                continue
            best[week] = (at, s["loss"])
            det = s["h00"] * s["h11"] - s["h01"] ** 2
            if max(abs(s["g0"]), abs(s["g1"])) <= SLOPE * size[week] or det <= 0:
                del trial[week]
                continue
            trial[week] = (at[0] - (s["h11"] * s["g0"] - s["h01"] * s["g1"]) / det,
                           at[1] - (s["h00"] * s["g1"] - s["h01"] * s["g0"]) / det)
    return {week: fit for week, (fit, _) in sorted(best.items())}


def _hull(points: list[tuple], kept: list[tuple] | None = None) -> list[tuple]:
    """Lower convex hull of (n, s, ...), both rising in n, from (0, 0) or from a hull on; of points in line only the ends.

    Whole numbers of any size, so no slope is rounded.
    """
    kept = [(0, 0)] if kept is None else kept
    for point in points:
        while len(kept) > 1:
            (n0, s0), (n1, s1) = kept[-2][:2], kept[-1][:2]
            if (point[1] - s1) * (n1 - n0) > (s1 - s0) * (point[0] - n1):
                break
            kept.pop()
        kept.append(point)
    return kept


def _range_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hull of each week in a range of ordered rows; its last point holds the range's totals.

    Batches add to the hull of the week, so that the rows of a range are never held together.
    """
    week, first, kept = None, None, [(0, 0)]

    def done() -> pd.DataFrame:
        out = pd.DataFrame(kept[1:], columns=["n", "s", "p", "after"])
        return out.assign(week=week, first=first)[["week", "first", "n", "s", "p", "after"]]

    for batch in batches:
        for at, rows in batch.groupby("week", sort=False):
            scores = rows["p"].tolist()
            if at != week:
                if week is not None:
                    yield done()
                week, first, kept = at, scores[0], [(0, 0)]
            n, s = kept[-1][:2]
            if n:
                kept[-1] = (*kept[-1][:3], scores[0])
            positives = (rows["pos"].cumsum() + s).tolist()
            sizes = ((rows["pos"] + rows["neg"]).cumsum() + n).tolist()
            kept = _hull(list(zip(sizes, positives, scores, [*scores[1:], None])), kept)
    if week is not None:
        yield done()


def _week_knots(rows: pd.DataFrame) -> pd.DataFrame:
    """Blocks of the fit of a week from the hulls of its ranges: both ends of each block."""
    rows = rows.sort_values(["first", "n"])
    columns = [rows[c].tolist() for c in ("n", "s", "p", "after", "first")]
    points, base, total, before = [], (0, 0), (0, 0), None
    for n, s, p, after, first in zip(*columns):
        if first != before:
            if points:
                points[-1] = (*points[-1][:3], first)
            base, before = total, first
        total = (base[0] + n, base[1] + s)
        points.append((*total, p, after))
    kept = _hull(points)
    start, knots = rows["first"].iloc[0], []
    for (n0, s0, *_), (n1, s1, p, after) in zip(kept, kept[1:]):
        value = (s1 - s0) / (n1 - n0)
        knots += [(start, value)] if start == p else [(start, value), (p, value)]
        start = after
    return pd.DataFrame(knots, columns=["p", "fitted"]).assign(week=rows["week"].iloc[0])


def fit_isotonic(points: DataFrame) -> DataFrame:
    """(week, p, fitted): the increasing fit with least squares, at both ends of each of its levels.

    A range of scores keeps only its hull, which has few points: the levels of a fit of n rows are at
    most about n^(2/3), whatever the scores. Ranges are partitions of the ordered points, each run through once.
    """
    week = points.schema["week"].dataType.simpleString()
    ordered = points.select("week", "p", "pos", "neg").repartitionByRange("week", "p").sortWithinPartitions("week", "p")
    hulls = ordered.mapInPandas(_range_hulls, f"week {week}, first double, n long, s long, p double, after double")
    return hulls.groupBy("week").applyInPandas(_week_knots, f"week {week}, p double, fitted double")


def apply_isotonic(scores: DataFrame, knots: DataFrame) -> DataFrame:
    """Distinct (week, p) with the value of the fit: linear between knots, the end values outside.

    The knots around a score are looked for in its range of scores first, then in the nearest range
    that has one: two windows, neither over a whole week of scores.
    """
    knot = F.struct("p", "fitted")
    both = scores.select("week", "p", F.lit(None).cast("double").alias("fitted"), F.lit(True).alias("asked")).distinct()
    both = both.unionByName(knots.select("week", "p", "fitted", F.lit(False).alias("asked")))
    both = both.withColumn("bucket", F.floor(F.col("p") / F.lit(BUCKET_WIDTH)))
    both = both.withColumn("knot", F.when(F.col("fitted").isNotNull(), knot))
    ranges = both.groupBy("week", "bucket").agg(
        F.max_by("knot", F.when(F.col("knot").isNotNull(), F.col("p"))).alias("highest"),
        F.min_by("knot", F.when(F.col("knot").isNotNull(), F.col("p"))).alias("lowest"),
    )
    over = Window.partitionBy("week").orderBy("bucket")
    ranges = ranges.select(
        "week", "bucket",
        F.last("highest", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("range_before"),
        F.first("lowest", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("range_after"),
    )
    inside = Window.partitionBy("week", "bucket").orderBy("p")
    placed = both.select(
        "week", "bucket", "p", "asked",
        F.last("knot", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("own_before"),
        F.first("knot", ignorenulls=True).over(inside.rangeBetween(0, Window.unboundedFollowing)).alias("own_after"),
    ).filter("asked").join(ranges, ["week", "bucket"])
    low, high = F.coalesce("own_before", "range_before"), F.coalesce("own_after", "range_after")
    placed = placed.select("week", "p", low.alias("low"), high.alias("high"))
    share = (F.col("p") - F.col("low.p")) / F.nullif(F.col("high.p") - F.col("low.p"), F.lit(0.0))
    between = F.col("low.fitted") + F.coalesce(share, F.lit(0.0)) * (F.col("high.fitted") - F.col("low.fitted"))
    return placed.select("week", "p", F.coalesce(between, F.col("low.fitted"), F.col("high.fitted")).alias("fitted"))


def calibrate_weekly(scored: DataFrame, method: str) -> DataFrame:
    """Calibrated scores, where a week has both classes with at least five rows; else unchanged."""
    if method not in ("platt", "isotonic"):
        raise ValueError(f"unknown calibration {method!r}")
    scored = staged(scored, "scored")  # read by the guard, the share and the result
    guard = enough_of_both(score_histogram(scored, ["week"]), ["week"]).filter("calibratable").select("week")
    points = calibration_points(scored, written=True)
    classes = points.groupBy("week").agg((F.least(F.sum("pos"), F.sum("neg")) > 0).alias("both")).filter("both").select("week")
    usable = staged(guard.join(classes, "week"), "calibrated-weeks")
    points = points.join(usable, "week", "left_semi")
    if method == "platt":
        fits = fit_platt(points)
        if not fits:
            return scored
        line = F.create_map(*[x for w, (a, b) in fits.items()
                              for x in (F.lit(w), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
        fit = F.try_element_at(line, F.col("week"))
        calibrated = 1.0 / (1.0 + F.exp(-(fit["a"] * F.col("score") + fit["b"])))
        return scored.withColumn("score", F.coalesce(calibrated, F.col("score").cast("double")))
    columns = [F.col(c) for c in scored.columns if c != "score"]
    p = F.col("score").cast("double").alias("p")
    fitted = apply_isotonic(scored.select("week", p), staged(fit_isotonic(points), "isotonic-knots"))
    fitted = staged(fitted, "isotonic-scores").select(F.col("week"), F.col("p").alias("_p"), "fitted")
    joined = scored.withColumn("_p", F.col("score").cast("double")).join(fitted, ["week", "_p"], "left")
    return joined.select(*columns, F.coalesce("fitted", "_p").alias("score")).select(*scored.columns)
