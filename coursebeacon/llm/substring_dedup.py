"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

A task hashes all windows of its documents and keeps, of each hash, the first place; later places in
the same task are repeats already. First places go to buckets by a second, independent hash, packed
as arrays; a bucket finds the globally first place of each hash and reports the others, again packed,
to groups of documents. Repeated windows of a document merge into maximal intervals, which are
removed.

Two windows count as equal if their 64-bit hashes agree and they fall in the same bucket, so the
effective width is 64 bits and the logarithm of the number of buckets, which grows with the input.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coursebeacon.llm.shipping import ship
from coursebeacon.llm.words import spaced_words, unused, utf8
from coursebeacon.session import staged

WINDOW = 20
#: Bytes of text whose windows are hashed and sorted together (some 20 times that in memory).
BLOCK_BYTES = 12 << 20
#: Bytes of text behind one bucket, hence some 20 MB of windows to sort at a time.
BUCKET_BYTES = 8 << 20
#: Odd multipliers of the polynomials over bytes and over words, and of the mixing step.
BYTE_BASE, WORD_BASE, BUCKET_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
FULL = 1 << 64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    result = np.full(n, base, np.uint64)
    if n:
        result[0] = 1
    return np.cumprod(result, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of all words of a byte string at once."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, raw: bytes) -> np.ndarray:
        letters = np.frombuffer(raw, np.uint8)
        if len(letters) + 1 > len(self.up):
            n = max(1 << 20, 2 * len(letters) + 1)
            self.up, self.down = _powers(BYTE_BASE, n), _powers(pow(BYTE_BASE, -1, FULL), n)
        inside = ~WHITE[letters]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * self.up[: len(letters)], out=sums[1:])
        return _mixed((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def window_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``window`` words, by doubling the length of the runs."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    result, size = None, 0
    run, length = words, 1  # hashes of runs of 1, 2, 4, ... words
    for bit in bin(window)[:1:-1]:
        if bit == "1":
            if result is None:
                result, size = run, length
            else:  # run first, what is there behind it
                n = len(words) - (size + length) + 1
                result = run[:n] * np.uint64(pow(base, size, FULL)) + result[length : length + n]
                size += length
        if 2 * length <= window:
            n = len(words) - 2 * length + 1
            run = run[:n] * np.uint64(pow(base, length, FULL)) + run[length : length + n]
            length *= 2
    return _mixed(result)


def _deltas(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _undeltas(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


#: A message to a bucket: first places with their hashes, or repeats for a group of documents (then
#: without hashes). Documents are listed once; a place is the index of its document and its start.
SENT = pa.schema([
    ("bucket", pa.int32()), ("documents", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("at", pa.binary()),
    ("hashes", pa.binary()),
])
SENT_SQL = "bucket int, documents int, docs binary, tags binary, at binary, hashes binary"
MARKS_SQL = "doc long, tag long, starts array<int>"


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first value of each run of equal values, edges of the runs)."""
    edges = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1 if len(owner) else 0))
    return owner[edges], np.append(edges, len(owner))


def _filled(columns: dict[str, list]) -> pa.RecordBatch:
    n = len(columns["docs"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in SENT], schema=SENT
    )


def _packed(rows: dict[str, list], doc: np.ndarray, tag: np.ndarray, index: np.ndarray, start: np.ndarray) -> None:
    """Adds places to a message; ``index`` into doc and tag has equal values side by side."""
    used, runs = _runs(index)
    rows["docs"].append(_deltas(doc[used]))
    rows["tags"].append(tag[used].tobytes())
    rows["at"].append(_deltas((np.repeat(np.arange(len(used)), np.diff(runs)) << 32) + start))


def _places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tag, start) of the places in a message."""
    at = _undeltas(row["at"])
    index = at >> 32
    return _undeltas(row["docs"])[index], np.frombuffer(row["tags"], np.int64)[index], at & 0xFFFFFFFF


def _repeated(doc: np.ndarray, tag: np.ndarray, index: np.ndarray, start: np.ndarray, groups: int) -> pa.RecordBatch:
    """Messages about repeats, one for each group of documents; a document's places are side by side."""
    group = (_mixed(doc.view(np.uint64) ^ _mixed(tag.view(np.uint64))) % np.uint64(groups)).astype(np.int32)[index]
    order = np.argsort(group, kind="stable")
    index, start = index[order], start[order]
    numbers, edges = _runs(group[order])
    rows: dict[str, list] = {"bucket": numbers.tolist(), "documents": numbers.tolist(), "docs": [], "tags": [], "at": []}
    for a, b in zip(edges[:-1], edges[1:]):
        _packed(rows, doc, tag, index[a:b], start[a:b])
    return _filled(rows)


class Block:
    """Windows of some documents, to be sent together; documents with equal keys are one."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.rows: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def add(self, key: tuple[int, int], hashes: np.ndarray, bucket: np.ndarray, size: int) -> None:
        self.rows[key] = (hashes, bucket)
        self.size += size

    def send(self) -> Iterator[pa.RecordBatch]:
        """Repeats within the block by document, then first places by bucket."""
        if not self.rows:
            return
        keys = sorted(self.rows)
        doc, tag = (np.array([key[i] for key in keys], np.int64) for i in (0, 1))
        values = np.concatenate([self.rows[key][0] for key in keys])
        bucket = np.concatenate([self.rows[key][1] for key in keys])
        offsets = np.concatenate([[0], np.cumsum([len(self.rows[key][0]) for key in keys])])
        owner = np.repeat(np.arange(len(keys)), np.diff(offsets))
        rank = np.argsort(values, kind="stable")  # equal hashes stay in the order of their places
        same = np.zeros(len(rank), bool)
        same[1:] = (values[rank][1:] == values[rank][:-1]) & (bucket[rank][1:] == bucket[rank][:-1])
        first = np.ones(len(rank), bool)
        first[rank[same]] = False
        repeats = np.flatnonzero(~first)
        if len(repeats):
            yield _repeated(doc, tag, owner[repeats], repeats - offsets[owner[repeats]], self.buckets)
        places = np.flatnonzero(first)
        places = places[np.argsort(bucket[places], kind="stable")]
        numbers, edges = _runs(bucket[places])
        rows: dict[str, list] = {"bucket": numbers.tolist(), "docs": [], "tags": [], "at": [], "hashes": []}
        for a, b in zip(edges[:-1], edges[1:]):
            own = places[a:b]
            _packed(rows, doc, tag, owner[own], own - offsets[owner[own]])
            rows["hashes"].append(values[own].tobytes())
        yield _filled(rows)


def _windows(docs: DataFrame, buckets: int, window: int, block_bytes: int) -> DataFrame:
    """``docs`` has doc, tag and text."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, block = WordHasher(), Block(buckets)
        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = utf8(text.as_py())
                words = hasher(raw)
                if len(words) < window:
                    continue
                aside = window_hashes(words, window, BUCKET_BASE) % np.uint64(buckets)
                block.add((doc, tag), window_hashes(words, window, WORD_BASE), aside.astype(np.int32), len(raw))
                if block.size >= block_bytes:
                    yield from block.send()
                    block = Block(buckets)
        yield from block.send()

    return docs.select("doc", "tag", "text").mapInArrow(hashes, SENT_SQL)


def _repeats(group: pa.Table, groups: int) -> pa.Table:
    """Messages about all places of a bucket but the first of each hash, beside those it brings."""
    ready = group.filter(pc.is_null(group["hashes"]))
    found = [ready]
    doc, tag, start, values = [], [], [], []
    for row in group.filter(pc.is_valid(group["hashes"])).to_pylist():
        for into, part in zip((doc, tag, start), _places(row)):
            into.append(part)
        values.append(np.frombuffer(row["hashes"], np.uint64))
    if values:
        values = np.concatenate(values)
        rank = np.argsort(values)
        ordered = values[rank]
        like = ordered[1:] == ordered[:-1]
        shared = rank[np.append(like, False) | np.append(False, like)]
        doc, tag, start = (np.concatenate(x)[shared] for x in (doc, tag, start))
        values = values[shared]
        by = np.lexsort((start, tag, doc, values))
        doc, tag, start, values = doc[by], tag[by], start[by], values[by]
        _, edges = _runs(values)
        run = np.repeat(edges[:-1], np.diff(edges))
        later = (doc != doc[run]) | (tag != tag[run]) | (start != start[run])
        doc, tag, start = doc[later], tag[later], start[later]
        if len(doc):
            by = np.lexsort((start, tag, doc))
            doc, tag, start = doc[by], tag[by], start[by]
            own = _edges(doc, tag)
            index = np.repeat(np.arange(len(own) - 1), np.diff(own))
            batch = _repeated(doc[own[:-1]], tag[own[:-1]], index, start, groups)
            found.append(pa.Table.from_batches([batch]).cast(ready.schema))
    return pa.concat_tables(found).combine_chunks()


def _edges(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Where the places of another document begin, and the end."""
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
    return np.append(np.flatnonzero(new), len(doc))


def _gathered(group: pa.Table) -> pa.Table:
    """One row per document of a group: the starts of its repeated windows."""
    doc, tag, start = (np.concatenate(x) for x in zip(*map(_places, group.to_pylist())))
    by = np.lexsort((start, tag, doc))
    doc, tag, start = doc[by], tag[by], start[by]
    edges = _edges(doc, tag)
    starts = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(start, pa.int32()))
    return pa.table({"doc": doc[edges[:-1]], "tag": tag[edges[:-1]], "starts": starts})


def removal_spans(n_words: int, starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words (first, last) that windows at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    breaks = np.flatnonzero(np.diff(starts) > window)
    firsts = starts[np.concatenate([[0], breaks + 1])]
    lasts = starts[np.concatenate([breaks, [len(starts) - 1]])] + window - 1
    return list(zip(firsts.tolist(), np.minimum(lasts, n_words - 1).tolist()))


ADDED = ("n_words", "n_removed", "removed", "kept_text")
ADDED_SQL = "n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept_text string"


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """All rows of ``docs`` with n_words, n_removed, removed (spans of words) and kept_text added.

    A word goes if a window over it also starts earlier: in a smaller id (a long; null comes last),
    or earlier in the same document. Rows that share an id are told apart by a hash of their text;
    rows equal in both are one document and share its result. Windows are judged on the input. Null
    texts have no words and an empty kept_text. An empty table gives an empty result; columns of
    ``docs`` named like the added ones are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*ADDED)
    names = docs.columns
    doc, tag, starts = (unused(names) + end for end in ("doc", "tag", "starts"))
    keyed = docs.withColumns({
        doc: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)),
        tag: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    })
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = 1 + total // bucket_bytes
    slim = keyed.select(F.col(doc).alias("doc"), F.col(tag).alias("tag"), F.col(text_col).alias("text"))
    sent = _windows(slim, buckets, window, block_bytes)
    sent = sent.repartition(buckets, "bucket")  # as many tasks as the input needs, whatever the session's default
    repeats = sent.groupBy("bucket").applyInArrow(lambda group: _repeats(group, buckets), SENT_SQL)
    marked = staged(repeats.groupBy("documents").applyInArrow(_gathered, MARKS_SQL), "repeated-windows")
    joined = keyed.join(marked.toDF(doc, tag, starts), [doc, tag], "left")
    fields = docs.schema.fields

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            counts, gone, spans, kept = [], [], [], []
            for text, at in zip(columns[text_col], columns[starts]):
                words = spaced_words(text.as_py())
                own = removal_spans(len(words), at.values.to_numpy() if at.is_valid else (), window)
                counts.append(len(words))
                gone.append(sum(b - a + 1 for a, b in own))
                spans.append([{"first": a, "last": b} for a, b in own])
                for a, b in reversed(own):
                    del words[a : b + 1]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [columns[name] for name in names] + [
                    pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string()),
                ], names=[*names, *ADDED],
            )

    schema = StructType([*fields, *StructType.fromDDL(ADDED_SQL).fields])
    return joined.select(*[f"`{c}`" for c in names], starts).mapInArrow(cut, schema)
