"""Exact, near and substring duplicates against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from coursebeacon.llm import simhash, stages, substring_dedup
from coursebeacon.llm.components import components
from coursebeacon.llm.exact_dedup import exact_dedup
from tests.llm import helpers


def test_exact_dedup(spark):
    docs = helpers.awkward(spark)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    rows = docs.collect()
    for r in rows:
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    for slots in (64, 1 << 16):  # a full bit table only costs work
        found = exact_dedup(docs, slots=slots).collect()
        assert len(found) == len(rows)
        for r in found:
            group = groups[norm(r.text)]
            assert r.group_size == len(group)
            assert r.keep_id == min(group, key=lambda x: (x[0], x[1], x[2] or 0))[2]
            assert r.kept == (r.doc_id == r.keep_id)


def test_exact_dedup_hash_and_empty(spark):
    docs = helpers.awkward(spark)
    from coursebeacon.llm.exact_dedup import full_hash

    one = docs.filter("doc_id = 1").select(full_hash(F.col("text")).alias("h")).first().h
    assert one == hashlib.sha256(b"Thequickbrownfoxjumpsoverthelazydog").hexdigest()
    assert exact_dedup(docs.limit(0)).count() == 0


def test_covering_masks_meet_every_pair():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        rng = np.random.default_rng(radius)
        for _ in range(300):
            flips = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
            assert any(mask & flips == 0 for mask in masks)
        assert all(mask for mask in masks)


def test_fingerprint_matches_brute_force(spark):
    for row in helpers.awkward(spark).collect():
        if len(row.text or "") < 50000:
            assert simhash.fingerprint(row.text) == helpers.simhash(row.text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_of_crowded_fingerprints(spark, radius):
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 62))
    prints = [0, centre, *[int(rng.integers(0, 1 << 63)) for _ in range(20)]]
    for _ in range(80):  # a chain and a crowd
        prints.append(prints[-1] ^ (1 << int(rng.integers(0, 64))))
        prints.append(centre ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 4)), replace=False)))
    ids = [int(i) for i in rng.permutation(len(prints))]
    rows = [(i, simhash.signed(p)) for i, p in zip(ids, prints)] + [(None, simhash.signed(centre))]
    found = simhash.linked(spark.createDataFrame(rows, "doc_id long, simhash long"), radius=radius)
    expected = dict(zip(ids, helpers.components(prints, ids, radius)))
    expected[None] = expected[ids[1]]
    assert {r.doc_id: r.component_id for r in found.collect()} == expected


def test_near_duplicates_of_awkward_rows(spark):
    docs = helpers.awkward(spark).filter("length(coalesce(text, '')) < 50000")
    rows = docs.collect()
    expected = helpers.components([helpers.simhash(r.text) for r in rows], [r.doc_id for r in rows], 2)
    found = simhash.near_duplicates(docs)
    assert found.columns == [*docs.columns, "simhash", "component_id"] or set(found.columns) == {*docs.columns, "simhash", "component_id"}
    by = {(r.doc_id, r.text): r.component_id for r in found.collect()}
    assert all(by[r.doc_id, r.text] == c for r, c in zip(rows, expected))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, an id with two near-duplicate texts or with two different ones, groups of null ids."""
    line = " ".join(f"word{i}" for i in range(1000))
    extra = [(200, line, "en"), (200, line + " more", "en"), (201, line, "en"), (None, line, "en")]
    extra += [(None, "nobody knows this one at all", "fr")] * 4 + [(300, "said three times over", "de")] * 3
    docs = helpers.awkward(spark, extra).filter("length(coalesce(text, '')) < 50000")
    rows = docs.collect()
    prints = [helpers.simhash(r.text) for r in rows]
    assert (helpers.simhash(line) ^ helpers.simhash(line + " more")).bit_count() <= 2
    groups = defaultdict(list)
    for r, root in zip(rows, helpers.components(prints, range(len(rows)), 2)):
        groups[root].append((r.doc_id is None, r.doc_id or 0, helpers.xx(r.text), r.text or ""))
    kept = stages.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, helpers.xx(r.text), r.text or "") for r in kept.collect())
    assert got == sorted(min(g) for g in groups.values()) and len(got) < len(rows) - 8
    assert stages.simhash_stage(spark, docs.limit(0), "").count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (7, 6), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(roots) == 61 + 40 and len({roots[i] for i in range(61)}) == 1
    assert len({roots[1000 + i] for i in range(40)}) == 1 and len(set(roots.values())) == 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_window_hashes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    for window in (1, 2, 3, 7, 19, 20):
        full = (1 << 64) - 1
        expected = []
        for i in range(len(words) - window + 1):
            h = 0
            for j in range(window):
                h = h + int(words[i + j]) * pow(substring_dedup.WORD_BASE, window - 1 - j, 1 << 64) & full
            expected.append(h)
        got = substring_dedup.window_hashes(words, window, substring_dedup.WORD_BASE)
        assert (got == substring_dedup._mixed(np.array(expected, np.uint64))).all()


def test_word_hasher_tells_words_apart():
    hasher = substring_dedup.WordHasher()
    a = hasher(b"  one two\tone \x0b three\n")
    assert len(a) == 4 and a[0] == a[2] and len(set(a.tolist())) == 3
    assert hasher(b"x" * 3_000_000 + b" one")[1] == a[0]
    assert len(hasher(b"")) == len(hasher(b" \n")) == 0


@pytest.mark.parametrize("window,block,bucket", [(20, 1 << 20, 1 << 20), (5, 200, 300), (3, 50, 1 << 20)])
def test_substring_dedup(spark, window, block, bucket):
    docs = helpers.awkward(spark)
    kept = helpers.without_substrings([(r.doc_id, r.text) for r in docs.collect()], window)
    found = substring_dedup.substring_dedup(docs, window=window, block_bytes=block, bucket_bytes=bucket)
    rows = found.collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(found.columns)
    for r in rows:
        expected = kept[r.doc_id, r.text or ""]
        assert r.kept_text == " ".join(expected), (r.doc_id, r.removed)
        assert r.n_removed == r.n_words - len(expected) == sum(s.last - s.first + 1 for s in r.removed)
    assert any(r.n_removed for r in rows)
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0
