"""SimHash near-duplicates by covering locality-sensitive hashing.

A radius of r bits takes 2^(r+1) - 1 tables. Every bit position has a vector of r + 1 bits, not all
zero, and the mask of table v holds the positions whose vector has an odd product with v. Any r
positions leave some v with an even product to all of them, so two fingerprints that differ in at
most r bits agree under that mask and meet in its table: no pair within the radius is missed.

Fingerprints that meet are held against each other without listing pairs: those within the radius
share a fingerprint halfway between them, so each emits what lies within half the radius of it, and
equal ones link. What meets at one place is bounded by the radius, not by the data.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coursebeacon.llm.components import components
from coursebeacon.llm.shipping import ship
from coursebeacon.llm.words import utf8
from coursebeacon.session import staged

BITS = 64
SHINGLE = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 14


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the XXH64 of all shingles, repeats included; no words give zero."""
    words = utf8(text).lower().split()  # bytes.lower changes A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    places = zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist())
    hashes = np.array([digest(line[a:b], seed) for a, b in places], ">u8")
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(hashes)).tobytes(), "big")


def with_fingerprint(
    docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, out: str = "simhash"
) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; null and empty texts have zero."""
    ship(docs.sparkSession)
    kept = docs.drop(out)
    names = kept.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            values = [signed(fingerprint(t.as_py(), shingle, seed)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*names, out])

    return kept.mapInArrow(add, StructType([*kept.schema.fields, StructField(out, LongType())]))


def covering_masks(radius: int) -> list[int]:
    """The masks of all tables, as unsigned integers."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)
    ]


def _meeting(prints: DataFrame, radius: int) -> DataFrame:
    """(simhash, free): fingerprints that meet another, and the bits outside the masks they met under."""
    tables = F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("simhash").bitwiseAND(F.lit(signed(mask))).alias("key"),
                 F.lit(signed(~mask & (2**64 - 1))).alias("free"))
        for i, mask in enumerate(covering_masks(radius))
    ])
    buckets = prints.select("simhash", F.inline(tables))
    full = buckets.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1").select("table", "key")
    full = staged(full, "simhash-buckets")
    return buckets.join(full, ["table", "key"]).groupBy("simhash").agg(F.bit_or("free").alias("free"))


def _around(radius: int) -> Column:
    """All fingerprints within ``radius`` bits of simhash that differ from it in free bits only."""
    flips = [0] + [
        sum(1 << i for i in chosen) for n in range(1, radius + 1) for chosen in combinations(range(BITS), n)
    ]
    table = F.array(*[F.lit(signed(x)) for x in flips])
    allowed = F.filter(table, lambda x: x.bitwiseAND(F.bitwise_not(F.col("free"))) == 0)
    return F.transform(allowed, lambda x: F.col("simhash").bitwiseXOR(x))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints linked within ``radius`` bits.

    For an even radius r, everything within r / 2 bits of one place is within r of each other, and
    two fingerprints within r have a place in common: each is linked to the smallest at each place.
    For an odd radius one half is a bit longer, and the pairs of a near and a far one are linked.
    """
    near, far = radius // 2, radius - radius // 2
    met = staged(_meeting(prints, radius), "simhash-met")
    if near == far:
        places = met.select("simhash", F.explode(_around(near)).alias("place"))
        smallest = places.groupBy("place").agg(F.collect_set("simhash").alias("all")).filter(F.size("all") > 1)
        return smallest.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct()
    inner = met.select(F.col("simhash").alias("a"), F.explode(_around(near)).alias("place"))
    outer = met.select(F.col("simhash").alias("b"), F.explode(_around(far)).alias("place"))
    return inner.join(outer, "place").filter("a <> b").select("a", "b").distinct()


def _rooted(slim: DataFrame, radius: int) -> DataFrame:
    """slim: simhash and _first -> each distinct fingerprint with its smallest _first and the root of its component."""
    prints = staged(slim.groupBy("simhash").agg(F.min("_first").alias("_first")), "simhash-prints")
    groups = components(links(prints, radius)).select(F.col("node").alias("simhash"), "root")
    rooted = prints.join(groups, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    return staged(rooted, "simhash-roots")


def linked(hashed: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """All rows of ``hashed``, which has a column simhash, with component_id added.

    ``hashed`` is read twice: give a written table where it is costly to make.
    """
    rooted = _rooted(hashed.select(F.col(id_col).alias("_first"), "simhash"), radius)
    least = staged(rooted.groupBy("root").agg(F.min("_first").alias("component_id")), "simhash-least")
    named = staged(rooted.join(least, "root").select("simhash", "component_id"), "simhash-components")
    return hashed.drop("component_id").join(named, "simhash")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    radius: int = RADIUS, seed: int = SEED,
) -> DataFrame:
    """All rows of ``docs`` with simhash (signed long) and component_id added.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest id reachable, itself included (null ids are ignored, a component of them alone has
    null). Null and empty texts have fingerprint zero and are linked like any other. Repeated rows
    are in one component. An empty table gives an empty result; columns of ``docs`` named like the
    added ones are replaced. Texts are shuffled once, by id, when the result is joined to them.
    """
    docs = docs.drop("simhash", "component_id")
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))  # tells apart rows that share an id
    slim = docs.select(F.col(id_col).alias("_id"), tag.alias("_tag"), F.col(text_col).alias("_text"))
    hashed = with_fingerprint(slim, "_text", shingle, seed).drop("_text").dropDuplicates(["_id", "_tag"])
    found = staged(linked(staged(hashed, "simhash-documents"), "_id", radius), "simhash-found")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (tag == F.col("_tag"))
    return docs.join(found, same).drop("_id", "_tag")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    radius: int = RADIUS, seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: exactly one row of each component stays.

    That is the one with the smallest id, null last; among rows of one id that with the smallest
    XXH64 of its text, a null text counting as empty; among those one of them, by a number that each
    row gets in a written table. Components are told apart by fingerprints, not by ids, so neither
    an id in two components nor null ids lose one. An empty table gives an empty result.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "simhash-rows")
    tag = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), tag.alias("tag"), "_row")
    slim = rows.select(first.alias("_first"), F.col(text_col).alias("_text"))
    hashed = staged(with_fingerprint(slim, "_text", shingle, seed).drop("_text"), "simhash-documents")
    kept = _rooted(hashed, radius).groupBy("root").agg(F.min("_first").alias("_first")).select("_first._row")
    return rows.join(staged(kept, "simhash-kept"), "_row", "left_semi").select(*docs.columns)
