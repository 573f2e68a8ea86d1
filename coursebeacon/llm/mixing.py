"""Mixing sources to target weights by Sainte-Lague apportionment of words, taken in equal blocks.

Each source's documents lie in a seeded order on tapes, one per shard, cut into blocks of equal
length. The seats (words of the whole mix) go to sources by highest quotients of their targets,
then to the shards of a source by their sizes. Within a shard all is taken as often as its quota
goes round, and a seeded choice of blocks once more, the last of them as far as the quota reaches.
The length of a block thus does not depend on any target. Only per-source sums come to the driver.
"""

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursebeacon.llm.shipping import ship
from coursebeacon.session import staged

SEED = 20240601
#: Documents of a shard, whose tape is laid out in one task.
SHARD_DOCS = 2_000
#: Sources that a mix may have; their sums are planned on the driver.
MAX_SOURCES = 100_000
#: Words of a block, whatever the sources: what is left of a document is cut no finer.
BLOCK_WORDS = 1024
#: A prime above any number of blocks of a shard; blocks are chosen by multiplying with it.
PRIME = 2_147_483_647


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    trimmed = F.trim(inner)
    spaces = F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Targets of ``share`` of all sizes in proportion to weights, none above ``cap`` of its size.

    What a capped source cannot take is shared among the others by weight, until none is above.
    """
    result = [0.0] * len(sizes)
    free = {i for i, n in enumerate(sizes) if n > 0 and weights[i] > 0}
    left = share * sum(sizes)
    while free:
        total = sum(weights[i] for i in sorted(free))
        over = {i for i in free if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in free:
                result[i] = left * weights[i] / total
            break
        for i in over:
            result[i] = float(cap * sizes[i])
        left -= sum(result[i] for i in sorted(over))
        free -= over
    return result


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 * seats + 1); ties go to the earlier one.

    Starts from rounded shares, then hands out or takes back the few seats that are missing.
    """
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    result = [math.floor(seats * v / total + 0.5) for v in votes]
    gap = seats - sum(result)
    if gap > 0:
        queue = [(-v / (2 * result[i] + 1), i) for i, v in enumerate(votes)]
        heapq.heapify(queue)
        for _ in range(gap):
            _, i = heapq.heappop(queue)
            result[i] += 1
            heapq.heappush(queue, (-votes[i] / (2 * result[i] + 1), i))
    elif gap < 0:
        queue = [(v / (2 * result[i] - 1), -i) for i, v in enumerate(votes) if result[i]]
        heapq.heapify(queue)
        for _ in range(-gap):
            _, i = heapq.heappop(queue)
            result[-i] -= 1
            if result[-i]:
                heapq.heappush(queue, (votes[-i] / (2 * result[-i] - 1), i))
    return result


def _quotas(shards: DataFrame, cap: float) -> DataFrame:
    """shards: _source, _shard, _total, _seats (of the source) -> quota of each shard in words."""

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_shard")
        quota = sainte_lague(rows["_total"].tolist(), int(rows["_seats"].iloc[0]))
        room = (rows["_total"] * cap).astype("int64")
        return rows.assign(_quota=pd.Series(quota, index=rows.index).clip(upper=room))

    return shards.groupBy("_source").applyInPandas(
        divide, "_source int, _shard long, _total long, _seats long, _quota long"
    )


def extra_of(number: Column, blocks: Column, total: Column, rest: Column, block: int, seed: int) -> Column:
    """Words at the start of a block that are taken once more: blocks follow in a seeded order until ``rest`` is reached."""
    shift = F.pmod(F.xxhash64(F.lit(seed), F.col("_source"), F.col("_shard")), blocks)
    turn = lambda b: F.pmod(b * F.lit(PRIME) % blocks + shift, blocks)
    final = blocks - 1  # may be shorter than the others
    short = blocks * block - total
    before = turn(number) * block - F.when(turn(number) > turn(final), short).otherwise(F.lit(0))
    length = F.lit(block) - F.when(number == final, short).otherwise(F.lit(0))
    return F.greatest(F.lit(0), F.least(rest - before, length))


def mix(
    docs: DataFrame, weights: Sequence[float], share: float = 1.5, cap: int = 2, id_col: str = "doc_id",
    source_col: str = "source", text_col: str = "text", size_col: str | None = None, seed: int = SEED,
    shard_docs: int = SHARD_DOCS, block_words: int | None = None,
) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, taken and pieces added.

    Sources in code point order, null last, get the weights in turn. ``pieces`` lists the parts of a
    document by the blocks it lies in: first and last of its words and how often the mix takes them;
    ``taken`` is the words that makes. Blocks have ``block_words`` (1,024) words in every source; one
    block of a shard may be taken in part, so that words, not blocks, meet the targets. ``size_col`` names a column that holds the sizes already (``docs`` is
    read three times). Null texts have no words and are never taken; null ids have one place in the
    order; rows equal in id and size may change places, which changes nothing in the result. An
    empty table gives an empty result; columns of ``docs`` named like the added ones are replaced.
    """
    spark = ship(docs.sparkSession)
    size = F.col(size_col).cast("long") if size_col else n_words(F.col(text_col))
    sized = docs.withColumn("size", size).drop("source_size", "target", "taken", "pieces")
    sums = sized.groupBy(F.col(source_col).alias("name")).agg(
        F.sum("size").alias("size"), F.count("*").alias("docs")
    )
    rows = sums.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["name"] is None, r["name"] or ""))
    given = [float(weights[i % len(weights)]) for i in range(len(rows))]
    goals = targets([r["size"] for r in rows], given, share, cap)
    block = block_words or BLOCK_WORDS
    seats = sainte_lague(goals, round(sum(goals)))
    plan = spark.createDataFrame(
        [(r["name"], i, r["size"], float(goals[i]), seats[i], max(1, -(-r["docs"] // shard_docs))) for i, r in enumerate(rows)],
        "_name string, _source int, source_size long, target double, _seats long, _shards long",
    )
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    placed = (
        sized.join(F.broadcast(plan), F.col(source_col).eqNullSafe(F.col("_name")))
        .withColumn("_order", order).withColumn("_shard", F.pmod(F.xxhash64("_order"), F.col("_shards")))
    )
    shards = placed.groupBy("_source", "_shard").agg(F.sum("size").alias("_total"), F.max("_seats").alias("_seats"))
    quotas = staged(_quotas(shards, cap), "mix-quotas").drop("_seats")
    tape = Window.partitionBy("_source", "_shard").orderBy("_order", id_col, "size")
    before = tape.rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        placed.withColumn("_at", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(quotas, ["_source", "_shard"])
        .withColumn("_blocks", F.floor((F.col("_total") + block - 1) / block))
    )
    end = F.col("_at") + F.col("size")
    numbers = F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + size - 1) div {block}"))
    rounds, rest = F.expr("_quota div _total"), F.expr("_quota % _total")

    def parts(b: Column) -> Column:
        start, stop = F.greatest(b * block, F.col("_at")), F.least((b + 1) * block, end)
        cut = b * block + extra_of(b, F.col("_blocks"), F.col("_total"), rest, block, seed)
        cut = F.least(F.greatest(cut, start), stop)
        part = lambda low, high, times: F.struct(
            (low - F.col("_at")).alias("first"), (high - F.col("_at") - 1).alias("last"), times.alias("times")
        )
        return F.array(part(start, cut, rounds + 1), part(cut, stop, rounds))

    pieces = F.filter(F.flatten(F.transform(numbers, parts)), lambda p: p["first"] <= p["last"])
    none = F.array().cast("array<struct<first:bigint,last:bigint,times:bigint>>")
    total = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + (p["last"] - p["first"] + 1) * p["times"])
    return (
        laid.withColumn("pieces", F.when(F.col("size") > 0, pieces).otherwise(none))
        .withColumn("taken", total)
        .drop("_name", "_source", "_seats", "_shards", "_order", "_shard", "_total", "_quota", "_at", "_blocks")
    )


def with_mixed_text(mixed: DataFrame, text_col: str = "text", cap: int = 2) -> DataFrame:
    """A result of ``mix`` whose texts are the words taken: once round for each time, parted by a line end.

    A text that is taken whole and once stays as it is.
    """
    text, words = F.col(text_col), F.col("_words")
    split = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    whole = F.forall("pieces", lambda p: p["times"] == 1)

    def turn(n: int) -> Column:
        taken = F.flatten(F.transform(
            F.filter("pieces", lambda p: p["times"] >= n),
            lambda p: F.slice(words, (p["first"] + 1).cast("int"), (p["last"] - p["first"] + 1).cast("int")),
        ))
        return F.array_join(taken, " ")

    turns = F.filter(F.array(*[turn(n) for n in range(1, cap + 1)]), lambda t: t != "")
    parted = mixed.withColumn("_words", F.when(~whole, split))  # a column of its own: split once
    return parted.withColumn(text_col, F.when(words.isNull(), text).otherwise(F.array_join(turns, "\n"))).drop("_words")
