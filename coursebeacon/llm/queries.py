"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebeacon.llm import collocations, conversation_repair, decontamination, exact_dedup, language_id, license_scan
from coursebeacon.llm import mixing, sentence_pieces, simhash, substring_dedup, token_counts, token_files, url_reputation
from coursebeacon.llm.oracle import STATEMENTS
from coursebeacon.session import staged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
MIX_WEIGHTS = (3, 1, 2)
END_ID, TOKEN_LIMIT = 2, 2048
LICENSE_PHRASES = {
    "under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc",
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", exact_dedup.full_hash(F.col("text")).alias("text_sha256")
    )
    result = exact_dedup.exact_dedup(docs, hash_col="text_sha256")
    return result.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op2_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, folder, "benchmark"))
    hits = F.aggregate("word_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


@query
def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """A label's id names the page; a page of low quality or a toxic one is bad."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = F.col("toxic").isNotNull() | F.col("quality").isNotNull()
    outcomes = table(spark, folder, "labels").filter(known).select(
        F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad")
    )
    result = url_reputation.url_filter(table(spark, folder, "pages"), outcomes, URL_RULES)
    return result.select("page_id", "host", "path", "rule", "verdict")


@query
def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = license_scan.license_scan(docs, phrases=LICENSE_PHRASES)
    starts = F.transform("base", lambda p: p["start"])
    base = F.transform("base", lambda p: p["label"])
    labels = F.concat(base, F.transform("detections", lambda d: d["label"]))
    joined = lambda names: F.array_join(F.sort_array(F.array_distinct(names)), ",")
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(labels).alias("labels"),
        F.when(F.size("base") > 0, F.greatest(best, F.lit(0.95))).otherwise(best).alias("score"),
    )


@query
def op5_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(staged(docs, "mix-sizes"), MIX_WEIGHTS, size_col="size")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs.drop("lang"), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op7_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    prints = staged(simhash.with_fingerprint(docs).drop("text"), "simhash-documents")
    found = simhash.linked(prints)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op8_token_output(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_files.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = substring_dedup.substring_dedup(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op11_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = sentence_pieces.encode(docs, model, decoded="decoded", keep=["doc_id"])
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a hash of conversation and turn; nulls are one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text = spaced("text")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    marked = rows.withColumn("kind", kind).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )
    return marked.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_copy")


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(damaged(rows)).withColumnRenamed("conv_id", "_conv_id")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents").select("text", "lang"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: STATEMENTS[name] for name in QUERIES if name in STATEMENTS}
