"""Simple-8b, token files, token counts, mixing and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from coursebeacon.llm import mixing, queries, simple8b, token_counts, token_files, tokenizing
from tests.llm import helpers

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1))), st.integers(1, 70))
def test_simple8b_round_trip(values, block):
    values = np.array(values, np.uint64)
    words, offsets, exceptions = simple8b.pack(values, block)
    assert (simple8b.unpack(words, offsets, exceptions, len(values), block) == values).all()
    ids = [None, -5, 2**62]
    raw = simple8b.to_bytes(ids, np.array([len(values), 0, 0]), values, block)
    again = simple8b.from_bytes(raw)
    assert again[0] == ids and (again[2] == values).all() and again[1].sum() == len(values)


def test_simple8b_packs_densely():
    assert len(simple8b.pack(np.zeros(1024, np.uint64))[0]) == 18  # 60 to a word
    assert len(simple8b.pack(np.full(1000, 2**19, np.uint64))[0]) == 334  # 3 to a word
    with pytest.raises(ValueError):
        simple8b.from_bytes(b"\0" * 100)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.,!?:;'sté 1\n\t \u2003\xa0<|>endoftx\u0301$%&*#-_()[]{}~^@\"\\/`", max_size=40))
def test_pieces_make_up_the_ids(text):
    own = tokenizing.encoder(BYTES)
    assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    words = tokenizing.load(WORDS)
    parts = [p.decode() for p in text.encode().split()]
    assert sum(tokenizing.counts(WORDS, parts)) == len(words.encode(text, add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aeinrst thoé", max_size=80), max_size=6))
def test_words_merged_together(texts):
    own = tokenizing.encoder(BYTES)
    expected = [own.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [ids.tolist() for ids in own.encode_all(texts)] == expected
    words = [word.encode() for text in texts for word in text.split() if word]
    alone = [own.tokenizer.encode(word.decode(), add_special_tokens=False).ids for word in words]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in own.merges.encode(words, together=3)] == alone


def test_only_plain_merges():
    with pytest.raises(ValueError):
        tokenizing.Merges(tokenizing.load(WORDS))


def test_equal_rows_are_spread_over_partitions(spark, tmp_path):
    """A third of the rows, and more, under one id and with one text."""
    docs = spark.createDataFrame([(None, "one text for all") for _ in range(2000)] + [(i, "own") for i in range(100)], "doc_id int, text string")
    manifest = token_files.write_token_files(docs.repartition(4), f"{tmp_path}/files", BYTES, 2, partition_bytes=400)
    parts = [r["n"] for r in manifest.groupBy("partition").agg({"n_docs": "sum"}).toDF("p", "n").collect()]
    assert len(parts) > 20 and max(parts) < 300 and sum(parts) == 2100
    with pytest.raises(ValueError):
        token_files.token_output(docs.withColumn("doc_id", mixing.F.lit("a")), BYTES, 2)


def test_encoder_forgets_and_learns_again():
    own = tokenizing.Encoder(BYTES, limit=3)
    for text in ("one two three four five", "six seven eight nine ten", "one six", ""):
        assert own.encode(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, tmp_path):
    docs = helpers.awkward(spark)
    tokenizer = tokenizing.load(BYTES)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, helpers.xx(r.text)))
    at, expected = 0, []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected.append((r.doc_id, at, len(ids), helpers.crc(ids), ids))
        at += len(ids)
    folder = f"{tmp_path}/files"
    manifest = token_files.write_token_files(docs, folder, BYTES, 2, partition_bytes=40_000, file_ids=50)
    assert manifest.agg({"n_ids": "sum"}).first()[0] == at and manifest.count() > 3
    starts = token_files.file_starts(manifest)
    read = token_files.read_token_files(spark, folder, with_ids=True).join(starts, "name").collect()
    got = sorted((r.file_start + r.position, r.id, r.n_tokens, r.ids_crc32, r.ids) for r in read)
    assert [(i, a, n, c, ids) for a, i, n, c, ids in got] == expected
    whole = token_files.token_output(docs, BYTES, 2).collect()
    assert sorted((r.start, r.n_tokens, r.ids_crc32) for r in whole) == [(a, n, c) for _, a, n, c, _ in expected]
    assert token_files.token_output(docs.limit(0), BYTES, 2).count() == 0


@pytest.mark.parametrize("head", [1 << 19, 4, 0])
def test_token_counts(spark, head):
    docs = helpers.awkward(spark)
    tokenizer = tokenizing.load(WORDS)
    expected = sorted(
        (str(r.doc_id), len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
        for r in docs.collect()
    )
    found = token_counts.token_counts(docs, WORDS, head_size=head)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found.collect()) == expected
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0


def test_token_queries_against_the_libraries(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    tokenizer, at, expected = tokenizing.load(BYTES), 0, {}
    for r in docs:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected[r.doc_id] = (at, len(ids), helpers.crc(ids))
        at += len(ids)
    found = queries.QUERIES["op8_token_output"](spark, small).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected
    tokenizer = tokenizing.load(WORDS)
    found = queries.QUERIES["op9_token_counts"](spark, small).collect()
    counts = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    assert {r.doc_id: r.n_tokens for r in found} == counts
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found)


def quotients(votes, seats):
    result = [0] * len(votes)
    for _ in range(seats):
        result[max(range(len(votes)), key=lambda i: (votes[i] / (2 * result[i] + 1), -i))] += 1
    return result


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12), st.integers(0, 200))
def test_sainte_lague_is_by_highest_quotients(votes, seats):
    got = mixing.sainte_lague(votes, seats)
    if not sum(votes):
        assert got == [0] * len(votes)
        return
    assert sum(got) == seats
    best = quotients(votes, seats)
    taken = lambda r: sorted(v / (2 * k + 1) for v, n in zip(votes, r) for k in range(n))
    assert taken(got) == pytest.approx(taken(best))


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([10, 0, 1000], [3, 1, 2], 1.5, 2) == pytest.approx([20, 0, 1495])
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0], [1], 1.5, 2) == [0]


def test_mix_comes_near_its_targets(spark):
    extra = [(1000 + i, "word " * (i * 37 % 400), "en") for i in range(300)]
    docs = helpers.awkward(spark, extra).filter("length(coalesce(text, '')) < 50000")
    mixed = mixing.mix(docs, (3, 1, 2), shard_docs=40).withColumn("out", mixing.F.col("text"))
    mixed = mixing.with_mixed_text(mixed, "out")
    rows = mixed.collect()
    assert len(rows) == docs.count()
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        words = helpers.spaced_words(r.text)
        assert r.size == len(words) and 0 <= r.taken <= 2 * r.size
        assert len(helpers.spaced_words(r.out)) == r.taken
        assert sum((p.last - p.first + 1) * p.times for p in r.pieces) == r.taken
        if r.taken == r.size and all(p.times == 1 for p in r.pieces):
            assert r.out == r.text
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = mixing.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    assert [goal[s] for s in names] == pytest.approx(expected)
    assert all(r.source_size == sizes[r.source] for r in rows)
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(8, 0.05 * goal[s]), (s, taken[s], goal[s])
    again = {(r.doc_id, r.text): r.taken for r in mixing.mix(docs, (3, 1, 2), shard_docs=40).collect()}
    assert all(again[r.doc_id, r.text] == r.taken for r in rows)
    assert mixing.mix(docs.limit(0), (3, 1, 2)).count() == 0


def test_mix_with_a_tiny_source_keeps_long_runs(spark):
    """A source of 100 words beside large ones: whole blocks in every source, targets met to the word."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(700 + i % 300)), f"big{i % 3}") for i in range(240)]
    rows += [(1000, " ".join(f"tiny{j}" for j in range(100)), "a-tiny"), (1001, "long " * 60_000, "big0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.with_mixed_text(mixing.mix(docs, (3, 1, 2), shard_docs=30).withColumn("out", mixing.F.col("text")), "out")
    found, taken, goal = mixed.collect(), defaultdict(int), {}
    assert len(found) == len(rows) and any(r.taken < r.size for r in found) and any(r.taken > r.size for r in found)
    for r in found:
        assert len(r.pieces) <= 2 * (r.size // mixing.BLOCK_WORDS + 2)
        assert [p.first for p in r.pieces] == [0, *[p.last + 1 for p in r.pieces[:-1]]] and r.pieces[-1].last == r.size - 1
        words, out = helpers.spaced_words(r.text), helpers.spaced_words(r.out)
        assert out == [w for n in (1, 2) for p in r.pieces if p.times >= n for w in words[p.first : p.last + 1]]
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(taken[s] - goal[s]) <= 3 for s in goal), (taken, goal)
    short = sum(p.last - p.first < 100 for r in found for p in r.pieces if r.source != "a-tiny")
    assert short < 0.25 * sum(len(r.pieces) for r in found if r.source != "a-tiny")


def test_pipeline_against_brute_force(spark, small):
    """Each stage on what its predecessor kept."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    from tests.llm.test_text import hits

    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    known = steps["language ID"](spark, docs, small)
    assert known.columns == columns
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in known.collect()} == letters
    single = steps["SimHash near-dedup"](spark, known, small)
    rows = known.collect()
    least = helpers.components([helpers.simhash(r.text) for r in rows], [r.doc_id for r in rows], 2)
    assert {r.doc_id for r in single.collect()} == set(least) and single.columns == columns
    clean = steps["benchmark decontamination"](spark, single, small)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not hits(r.text, bench, 10)[0]}
    mixed = steps["mixing sources to target weights"](spark, clean, small)
    assert mixed.columns == columns
    texts = {r.doc_id: r for r in mixed.collect()}
    before = {r.doc_id: r.text for r in clean.collect()}
    total = sum(len(helpers.spaced_words(r.text)) for r in texts.values())
    assert set(texts) <= set(before) and abs(total - 1.5 * sum(len(t.split()) for t in before.values())) < 0.02 * total
    assert all(r.n_chars == len(r.text) for r in texts.values())
    assert all(set(helpers.spaced_words(r.text)) <= set(helpers.spaced_words(before[r.doc_id])) for r in texts.values())
    tokens = corpus_pipeline.run(spark, small).collect()
    encode = tokenizing.load(BYTES).encode
    at = 0
    for r in sorted(tokens, key=lambda r: r.doc_id):
        ids = [*encode(texts[r.doc_id].text, add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(tokens) == len(texts) and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
