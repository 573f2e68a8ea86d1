"""The stages of the pipeline on awkward rows, empty tables and columns named like their own."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coursebeacon.llm import decontamination, language_id, license_scan, substring_dedup
from tests.llm import helpers

STAGES = dict(corpus_pipeline.STAGES)
NAMES = list(STAGES)
#: Every name that an operator or a stage uses for a column of its own.
OWN = ["carried", "lang_score", "_lang", "_score", "n_words", "items", "word_spans", "char_spans", "size", "source_size", "target",
       "taken", "pieces", "simhash", "component_id", "doc", "tag", "id", "_hash", "score", "_row", "text_", "_words"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    rows = [("q1", " ".join(f"passage{i}" for i in range(12))), ("q2", None), (None, "")]
    spark.createDataFrame(rows, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(100 + i, f"english words and more of them number {'a' * i}", "en") for i in range(30)]
    extra += [(200 + i, f"deutsche Worte und mehr davon Nummer {'b' * i}", "de") for i in range(30)]
    table = helpers.awkward(spark, extra).select("doc_id", "text", "lang", "source", "n_chars")
    odd = F.struct(F.lit(1).alias("a field"), F.lit("x").alias("b"))
    return table.withColumns({name: F.lit(f"own {name}") for name in OWN} | {"a struct": odd})


@pytest.mark.parametrize("name", NAMES[:-1])
def test_stages_carry_other_columns_past(spark, docs, folder, name):
    found = STAGES[name](spark, docs, folder)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    rows = found.collect()
    assert rows and all(r[c] == f"own {c}" for r in rows for c in OWN)
    assert all(r["a struct"]["a field"] == 1 and r["a struct"]["b"] == "x" for r in rows)
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0
    texts = {r.text for r in docs.collect()}
    if name != NAMES[3]:
        assert {r.text for r in rows} <= texts


def test_rows_each_stage_keeps(spark, docs, folder):
    keys = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    before = docs.collect()
    letters = [r for r in before if any(c.isalpha() for c in r.text or "")]
    known = STAGES["language ID"](spark, docs, folder)
    assert keys(known) == sorted((str(r.doc_id), r.text) for r in letters)
    assert all(r.lang in ("en", "de", "fr") for r in known.collect())
    clean = STAGES["benchmark decontamination"](spark, docs, folder)
    hit = " ".join(f"passage{i}" for i in range(10))
    assert keys(clean) == sorted((str(r.doc_id), r.text or "") for r in before if hit not in helpers.lowered(r.text))
    mixed = STAGES["mixing sources to target weights"](spark, docs, folder)
    assert all(r.n_chars == len(r.text) > 0 for r in mixed.collect())


def test_the_predicted_language_takes_effect(spark, folder):
    """A mislabelled and an unlabelled document have the language of their text afterwards."""
    rows = [(i, f"the house and the garden of the {'xyz'[i % 3]} man {i}", "en") for i in range(60)]
    rows += [(100 + i, f"das Haus und der Garten von dem {'xyz'[i % 3]} Mann {i}", "de") for i in range(60)]
    unseen = next(i for i in range(300, 400) if zlib.crc32(str(i).encode()) % 4 == 2)  # nothing is learned from it
    rows += [(unseen, "the garden and the house of the man", "de"), (401, "der Garten und das Haus von dem Mann", None)]
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.lang for r in STAGES["language ID"](spark, table, folder).collect()}
    assert found[unseen] == "en" and found[401] == "de" and len(found) == len(rows)
    bare = table.withColumn("lang", F.lit(None).cast("string"))
    assert STAGES["language ID"](spark, bare, folder).count() == len(rows)


def test_token_output_of_awkward_rows(spark, docs, folder):
    found = STAGES[NAMES[-1]](spark, docs, folder).collect()
    assert len(found) == docs.count() and min(r.n_tokens for r in found) == 1
    assert STAGES[NAMES[-1]](spark, docs.limit(0), folder).count() == 0


def test_substring_dedup_replaces_nothing_of_the_input(spark, docs):
    added = docs.columns + [c for c in ("n_words", "n_removed", "removed", "kept_text") if c not in docs.columns]
    found = substring_dedup.substring_dedup(docs)
    assert sorted(found.columns) == sorted(added)
    assert {r.doc for r in found.collect()} == {"own doc"} and {r.tag for r in found.collect()} == {"own tag"}


def test_operators_take_columns_of_any_name(spark, docs, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    model = language_id.Model(families={"only xx": ["xx"]})
    for found in (decontamination.decontaminate(docs, benchmark), language_id.predict(docs, model), license_scan.license_scan(docs)):
        assert set(docs.columns) <= set(found.columns)
        assert {r["a struct"]["a field"] for r in found.collect()} == {1}
    with pytest.raises(ValueError, match="languages"):
        language_id.train(docs.withColumn("lang", F.col("doc_id").cast("string")), max_languages=20)
