"""SentencePiece encoding against the library."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from coursebeacon.llm import queries, sentence_pieces
from tests.llm import helpers

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abeinst THE.,!?'\n\t▁é́½ß中文한😀𝔘\x00\x7f<>/s0xÿ　�"


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=ALPHABET, max_size=60), st.text(alphabet=" ▁ab", max_size=70)))
def test_ids_are_those_of_the_library(text):
    text = text.encode("utf-8", "ignore").decode()  # no lone surrogates in a table's text
    own = sentence_pieces.encoder(MODEL)
    ids = own.encode(text).tolist()
    assert ids == own.model.encode(text)
    assert own.decode(ids) == own.model.decode(own.model.encode(text))


def test_every_prefix_has_its_last_piece():
    own = sentence_pieces.encoder(MODEL)
    text = "▁internationalisation▁▁▁▁of▁thenntions"
    for end, token in enumerate(own.table(text)[1:], 1):
        plain = text[1:end].replace("▁", " ")  # the library puts the first space there itself
        assert end == 1 or token == own.model.encode(plain)[-1]


def test_forgetting_changes_nothing():
    own = sentence_pieces.PrefixEncoder(MODEL, remembered=4, pairs=10)
    for text in ("one two three four five six", "seven eight one two", "", " ", "x" * 5000, "one" + " " * 3000 + "two"):
        assert own.encode(text).tolist() == own.model.encode(text)


def test_encode_and_decode_tables(spark):
    docs = helpers.awkward(spark).withColumnRenamed("kept", "ids").withColumnRenamed("size", "_text")
    library = sentence_pieces.encoder(MODEL).model
    found = sentence_pieces.encode(docs, MODEL, decoded="score")
    assert sorted(found.columns) == sorted(docs.columns)
    rows = found.collect()
    assert len(rows) == docs.count()
    for row in rows:
        expected = library.encode(row.text or "")
        assert row.ids == expected and row.score == library.decode(expected) and row._text == 5
    again = sentence_pieces.decode(found.drop("text"), MODEL).collect()
    assert sorted(r.text for r in again) == sorted(r.score for r in rows)
    assert sentence_pieces.encode(docs.limit(0), MODEL).count() == 0
    assert sentence_pieces.decode(found.limit(0), MODEL).count() == 0
    nulls = spark.createDataFrame([(None, 1), ([], 2)], "ids array<int>, k int")
    assert [r.text for r in sentence_pieces.decode(nulls, MODEL).collect()] == ["", ""]


def test_batches_are_cut_by_size(spark, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "BATCH_BYTES", 20)
    docs = spark.createDataFrame([(i, f"text number {i}" if i % 3 else None) for i in range(50)], "doc_id long, text string")
    library = sentence_pieces.encoder(MODEL).model
    found = sentence_pieces.encode(docs.coalesce(1), MODEL, keep=["doc_id"]).collect()
    assert {r.doc_id: r.ids for r in found} == {r.doc_id: library.encode(r.text or "") for r in docs.collect()}


def test_query(spark, small):
    library = sentence_pieces.encoder(MODEL).model

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = {}
    for row in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(row.text or "")
        expected[row.doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    found = queries.QUERIES["op11_sentencepiece"](spark, small).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == expected


def test_other_normalisation_is_refused(tmp_path):
    with pytest.raises(Exception):
        sentence_pieces.PrefixEncoder(f"{tmp_path}/none.model")
