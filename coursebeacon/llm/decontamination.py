"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

Benchmark texts become windows of consecutive words; the automaton over all windows reads each
document once, and what it finds is mapped back to words and to offsets in the original text. The
benchmark is a reference set: its windows are collected in blocks of bounded size, one automaton per
block, so a large benchmark takes more passes but never more memory.
"""

import bisect
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from coursebeacon.llm.shipping import ship
from coursebeacon.llm.words import WORD, plain_words, utf8

WINDOW = 10
#: Benchmark words that one automaton takes (some 200 MB in a task), hence the size of a broadcast.
WORDS_PER_AUTOMATON = 50_000
FOUND = "n_words long, items array<string>, word_spans array<struct<first:int,last:int>>, char_spans array<struct<start:int,end:int>>"


def windows(words: list[bytes], window: int) -> Iterator[bytes]:
    """Runs of ``window`` words, one space around each word; fewer words are one run, none no run."""
    for i in range(max(min(len(words), 1), len(words) - window + 1)):
        yield b" " + b" ".join(words[i : i + window]) + b" "


def automaton(items: list[tuple[str, list[bytes]]], window: int) -> ahocorasick.Automaton:
    """Automaton whose values are (words in the window, items that have it)."""
    owners: dict[bytes, set[str]] = {}
    sizes: dict[bytes, int] = {}
    for item, words in items:
        for run in windows(words, window):
            owners.setdefault(run, set()).add(item)
            sizes[run] = min(window, len(words))
    machine = ahocorasick.Automaton()
    for run, names in owners.items():
        machine.add_word(run.decode("latin-1"), (sizes[run], tuple(sorted(names))))
    if len(machine):
        machine.make_automaton()
    return machine


def scan(text: str | None, machine: ahocorasick.Automaton) -> tuple[int, list[str], list[tuple[int, int]]]:
    """(number of words, items found, spans of hit words as (first, last))."""
    words = plain_words(text)
    if not len(machine) or not words:
        return len(words), [], []
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ends: list[int] | None = None
    items: set[str] = set()
    spans: list[tuple[int, int]] = []
    for end, (size, names) in machine.iter(line):
        if ends is None:
            ends, at = [], 0
            for word in words:
                at += len(word) + 1
                ends.append(at)  # the space behind the word
        last = bisect.bisect_left(ends, end)
        items.update(names)
        spans.append((last - size + 1, last))
    return len(words), sorted(items), spans


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as [start, end) code points of the original text."""
    if not spans:
        return []
    raw = utf8(text)
    places = [m.span() for m in WORD.finditer(raw)]
    points = lambda b: len(raw[:b].decode("utf-8", "surrogatepass"))
    return [(points(places[first][0]), points(places[last][1])) for first, last in spans]


ADDED = ("n_words", "items", "word_spans", "char_spans")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    result: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if result and first <= result[-1][1] + 1:
            result[-1] = (result[-1][0], max(last, result[-1][1]))
        else:
            result.append((first, last))
    return result


def _found(docs: DataFrame, text_col: str, items: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """One pass over ``docs``; what an earlier pass has found is kept and added to."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(items)
    own = [f for f in docs.schema.fields if f.name not in ADDED]
    names = [f.name for f in own]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value, window)
        words_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        chars_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            counts, items, spans, chars = [], [], [], []
            before = zip(column["items"].to_pylist(), column["word_spans"].to_pylist()) if "items" in column else None
            for text in column[text_col].to_pylist():
                n, hit, places = scan(text, machine)
                if before is not None:
                    old, old_places = next(before)
                    hit = sorted({*hit, *old})
                    places = places + [(p["first"], p["last"]) for p in old_places]
                places = _merged(places)
                counts.append(n)
                items.append(hit)
                spans.append([{"first": a, "last": b} for a, b in places])
                chars.append([{"start": a, "end": b} for a, b in char_spans(text, places)])
            yield pa.RecordBatch.from_arrays(
                [column[name] for name in names] + [
                    pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, words_type), pa.array(chars, chars_type),
                ], names=[*names, *ADDED],
            )

    return docs.mapInArrow(judge, StructType([*own, *StructType.fromDDL(FOUND).fields]))


def blocks(
    items: Iterator[tuple[str, list[bytes]]], window: int, limit: int
) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``limit`` words; a longer item is cut into overlapping pieces."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, words in items:
        for i in range(0, max(1, len(words) - window + 1), limit):
            piece = words[i : i + limit + window - 1]
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_cols: tuple[str, ...] = ("text",), window: int = WINDOW,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """All rows of ``docs`` with n_words, items, word_spans and char_spans added.

    ``items`` are the ids (as strings, null as ``""``) of benchmark rows of which a window occurs;
    questions and answers are columns of ``item_text_cols``, and each makes windows of its own.
    ``word_spans`` are the hit words (first and last, merged), ``char_spans`` the same as code point
    offsets of the original text. Null texts have no words. Repeated rows are judged one by one,
    repeated items are one. An empty benchmark finds nothing, empty documents give an empty result.
    Columns of ``docs`` named like the added ones are replaced.
    """
    texts = [
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(c).alias("text"))
        for c in item_text_cols
    ]
    items = reduce(DataFrame.unionByName, texts).dropna(subset=["text"]).distinct().orderBy("item", "text")
    rows = ((row["item"], plain_words(row["text"])) for row in items.toLocalIterator())
    found = docs.drop(*ADDED)
    for block in blocks(rows, window, words_per_automaton):
        found = _found(found, text_col, block, window)
    return found
