"""Phrase collocations against counting whole phrases in Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from coursebeacon.llm import collocations
from tests.llm import helpers


def brute(docs, least, top, absorbed=50):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", helpers.lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    rows = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= absorbed * a for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def mined(docs, **options):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = collocations.collocations(docs, **options)
    assert found.columns == names
    return sorted(tuple(r) for r in found.collect())


EXTRA = [
    (20, "a b c a b c, a b c. a b a b a b! a\tb  c; A B\nC " * 5, "en"), (21, "new york city " * 40 + "york. new", "en"),
    (22, "é è é è é è é è é è é è" * 3, None), (23, "x", "en"), (24, "!?.,", "en"), (25, "of the of the of the " * 20, "fr"),
]


@pytest.mark.parametrize("bits", [64, 9, 4])
def test_against_brute_force(spark, bits):
    docs = helpers.awkward(spark, EXTRA)
    rows = [(r.lang, r.text) for r in docs.collect()]
    docs = docs.withColumnRenamed("kept", "row").withColumnRenamed("size", "phrase").withColumnRenamed("score", "lang ")
    for least, top in ((2, 2000), (10, 5)):
        found = mined(docs, least=least, top=top, bits=bits, slots=64 if bits == 9 else 1 << 16, partition_bytes=20_000)
        assert found == brute(rows, least, top)
    assert mined(docs.limit(0)) == []


def test_texts_are_cut_at_breaks_only(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 50)
    monkeypatch.setattr(collocations.Miner, "HELD", 10)
    rows = [("en", "one two three. " * 30 + "no break here at all " * 20), ("en", "no break here. one two"), ("en", None)] * 4
    assert mined(spark.createDataFrame(rows, "lang string, text string"), least=3) == brute(rows, 3, 2000)


def test_messages_round_trip():
    draw = np.random.default_rng(1)
    grams = collocations.Grams(
        draw.integers(0, 2**64, 1000, np.uint64), draw.integers(0, 2**31, 1000).astype(np.uint64),
        draw.integers(1, 2**40, 1000), draw.integers(0, 2**62, 1000),
    )
    for part in (grams, grams.chosen(np.zeros(1000, bool))):
        again = collocations.Grams.unpacked(part.packed())
        assert all((getattr(again, f) == getattr(part, f)).all() for f in part.__dataclass_fields__)
    merged = collocations.Grams.merged([grams, grams])
    assert (merged.counts.sum() == 2 * grams.counts.sum()) and len(merged.prints) == 1000
    other = collocations.Grams(grams.prints, grams.checks ^ np.uint64(1), grams.counts, grams.rows)
    assert (collocations.Grams.merged([grams, other]).checks >= 2**31).all()


def test_scores_beyond_64_bits(spark):
    a, left, right = 10**15, 10**15 + 7, 3 * 10**15
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations._score("a", "l", "r")).first()
    assert row[0] == 1000000 * a * a // (left * right)
