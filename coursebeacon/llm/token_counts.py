"""Token counts: pieces are counted once per distinct pre-token and joined to documents' frequencies.

Pre-tokens are the runs between ASCII white space, which the tokenizer drops. The most frequent of
them, as many as a fixed bound lets be broadcast, are looked up where the documents are read; the
others are joined by shuffle. No ids are kept anywhere.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursebeacon.llm import tokenizing
from coursebeacon.llm.shipping import ship
from coursebeacon.llm.words import utf8
from coursebeacon.session import staged

#: Pre-tokens that are broadcast, and the bytes one of them has at most: 32 MB of them in all.
HEAD = 1 << 19
HEAD_BYTES = 64
#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 1 << 20


def _frequencies(docs: DataFrame) -> DataFrame:
    """(piece, n) of all texts, added up within tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def pieces() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["piece", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                held.update(utf8(text.as_py()).split())
                if len(held) > HELD:
                    yield pieces()
                    held.clear()
        if held:
            yield pieces()

    return docs.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(piece, n, tokens): every distinct pre-token, how often it stands and its tokens."""
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [p.decode("utf-8", "surrogatepass") for p in batch.column(0).to_pylist()]
            tokens = pa.array(tokenizing.counts(tokenizer, pieces), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], names=["piece", "n", "tokens"])

    found = _frequencies(docs.select(text_col)).mapInArrow(measure, "piece binary, n long, tokens long")
    return staged(found, "token-vocabulary")


def head(words: DataFrame, limit: int = HEAD) -> dict[bytes, int]:
    """Tokens of the most frequent short pre-tokens, ``limit`` at most.

    The least frequency comes from a histogram of its logarithm; a level that would not fit whole
    stays out.
    """
    short = words.filter(F.octet_length("piece") <= HEAD_BYTES)
    level = F.floor(F.log2("n") * 16)
    levels = sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for row in levels:
        total += row["count"]
        if total > limit:
            break
        least = row["level"]
    if least is None:
        return {}
    chosen = short.filter(level >= least).select("piece", "tokens")
    return {bytes(row["piece"]): row["tokens"] for row in chosen.toLocalIterator()}


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", head_size: int = HEAD
) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes (UTF-8) and n_tokens.

    Null texts are empty and have no tokens. Rows that share an id, nulls included, are told apart
    by a hash of their text; rows equal in both have a result each. An empty table gives an empty
    result. ``tokenizer`` drops white space before it splits words, as its file tells it.
    """
    spark = ship(docs.sparkSession)
    words = vocabulary(docs, tokenizer, text_col)
    known = spark.sparkContext.broadcast(head(words, head_size))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        fields = [pa.field("piece", pa.binary()), pa.field("n", pa.int64()), pa.field("n_bytes", pa.int64())]
        for batch in batches:
            edges, pieces, ns, sizes = [0], [], [], []
            for tag, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = utf8(text.as_py())
                counted = Counter(raw.split())
                total, own = 0, len(pieces)
                pieces.append(b" %d" % tag)  # the document itself: no pre-token, its known tokens
                ns.append(0)
                for piece, n, tokens in zip(counted, counted.values(), map(get, counted)):
                    if tokens is None:
                        pieces.append(piece)
                        ns.append(n)
                    else:
                        total += n * tokens
                ns[own] = total
                sizes.append(len(raw))
                sizes.extend([None] * (len(pieces) - own - 1))
                edges.append(len(pieces))
            entries = pa.StructArray.from_arrays(
                [pa.array(pieces, pa.binary()), pa.array(ns, pa.int64()), pa.array(sizes, pa.int64())], fields=fields
            )
            lists = pa.ListArray.from_arrays(pa.array(np.array(edges), pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["id", "tag", "entries"])

    schema = f"id {id_type}, tag long, entries array<struct<piece:binary,n:long,n_bytes:long>>"
    each = slim.mapInArrow(look_up, schema).select("id", "tag", F.inline("entries"))
    sums = each.join(words.select("piece", "tokens"), "piece", "left").groupBy("id", "tag").agg(
        F.count("n_bytes").alias("copies"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("all"),
    )
    return sums.select(
        F.col("id").alias(id_col), "n_bytes", F.expr("all div copies").alias("n_tokens"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
