"""The stages of the corpus pipeline: documents in, documents out, and token files at the end.

Each stage calls one operator and lets its decisions take effect. All but the last return the
columns of documents, whatever further ones there are and whatever their names: those that an
operator does not need are carried past it in one column of their own.

Null texts count as empty texts. Repeated rows, ties and rows without id are judged as the operators
tell it. An empty table gives an empty one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.llm import decontamination, language_id, mixing, simhash, token_files
from coursebeacon.session import staged

MIX_WEIGHTS = (3, 1, 2)
END_ID = 2


CARRIED = "carried"


def carried(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others in one."""
    others = [docs[f"`{c}`"] for c in docs.columns if c not in used]
    return docs.select(*[docs[f"`{c}`"] for c in used], (F.struct(*others) if others else F.lit(None)).alias(CARRIED))


def restored(found: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, those ``used`` as they are now."""
    return found.select(*[F.col(c) if c in used else F.col(CARRIED)[c].alias(c) for c in docs.columns])


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null texts and those without a letter. The others
    have the predicted language as their ``lang`` from here on, whatever it was before.

    Without a labelled document to learn from, ``lang`` stays as it is (null).
    """
    model = language_id.train(docs.filter(~language_id.held_out()))
    if not model.families:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(carried(docs, "text"), model, out="lang", score="lang_score")
    return restored(found.filter(F.col("lang") != language_id.UNKNOWN), docs, "text", "lang")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates exactly one row stays, one with the smallest id (null last)."""
    used = "doc_id", "text"
    return restored(simhash.one_of_each(carried(docs, *used)), docs, *used)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark text go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(carried(docs, "text"), benchmark)
    return restored(found.filter(F.size("word_spans") == 0), docs, "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's text becomes the blocks that the mix takes of it, repeats included; ``n_chars`` follows."""
    used = "doc_id", "source", "text"
    sized = staged(carried(docs, *used).withColumn("size", mixing.n_words(F.col("text"))), "mix-documents")
    mixed = mixing.with_mixed_text(mixing.mix(sized, MIX_WEIGHTS, size_col="size").filter("taken > 0"))
    result = restored(mixed, docs, *used)
    return result.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else result


def token_output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes what is left as token files; one row per document as read back from them."""
    return token_files.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
