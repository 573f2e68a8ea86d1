"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

One pass over the texts writes the length and the prefix hash of each; both first levels read that
table alone. What survives is passed on as a bit table of a fixed number of slots, so that the texts
are never shuffled: a row whose slot is empty is alone for certain, and only rows whose slots are set
on both levels are read whole and hashed, which decides.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebeacon.session import staged

#: Bits of a survivor table. It is broadcast as at most SLOTS / 64 rows of two longs (1 MB here).
SLOTS = 1 << 22
PREFIX_CHARS = 64
WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    result = F.coalesce(text, F.lit(""))
    for character in WHITE_SPACE:
        result = F.replace(result, F.lit(character), F.lit(""))
    return result


def full_hash(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots))


def _survivors(keys: DataFrame, slots: int) -> DataFrame:
    """Bit table of the keys that occur more than once: (word, bits), slots / 64 rows at most."""
    repeated = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    slot = repeated.select(_slot(F.col("key"), slots).alias("slot"))
    table = slot.groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")
    )
    return staged(table, "exact-survivors")


def _marked(rows: DataFrame, key: Column, table: DataFrame, slots: int, out: str) -> DataFrame:
    """``rows`` with a column that says whether the key's slot is set."""
    marked = rows.withColumn("_slot", _slot(key, slots)).withColumn("_word", F.expr("_slot div 64"))
    table = F.broadcast(table.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    hit = F.expr("(shiftright(coalesce(_bits, 0L), cast(_slot % 64 as int)) & 1L) = 1")
    return marked.join(table, "_word", "left").withColumn(out, hit).drop("_slot", "_word", "_bits")


def _normal_rows(docs: DataFrame, text_col: str, prefix_chars: int) -> DataFrame:
    """``docs`` with _norm, _length and _prefix; the text is normalised once, however often these are used."""
    once = F.inline(F.array(F.struct(normalised(docs[f"`{text_col}`"]).alias("_norm"))))
    length = F.char_length("_norm")
    prefix = F.xxhash64(length, F.substring("_norm", 1, prefix_chars))
    return docs.select("*", once).withColumns({"_length": length, "_prefix": prefix})


def _levels(docs: DataFrame, text_col: str, prefix_chars: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """Bit tables of the lengths, and of the prefixes of rows with such a length."""
    slim = _normal_rows(docs.select(docs[f"`{text_col}`"].alias("text")), "text", prefix_chars).select("_length", "_prefix")
    slim = staged(slim, "exact-lengths")
    lengths = _survivors(slim.select(F.col("_length").alias("key")), slots)
    left = _marked(slim, F.col("_length"), lengths, slots, "_hit").filter("_hit")
    return lengths, _survivors(left.select(F.col("_prefix").alias("key")), slots)


def _candidates(docs: DataFrame, text_col: str, levels: tuple[DataFrame, DataFrame], prefix_chars: int, slots: int) -> DataFrame:
    """``docs`` with the full hash of rows that survive both levels; the others have their prefix hash in its
    place, which is shorter than any full one, so that a join on it does not send them all to one task.
    """
    rows = _normal_rows(docs, text_col, prefix_chars)
    rows = _marked(rows, F.col("_length"), levels[0], slots, "_hit1")
    rows = _marked(rows, F.col("_prefix"), levels[1], slots, "_hit2")
    both = F.col("_hit1") & F.col("_hit2")
    full = F.when(both, F.sha2("_norm", 256)).otherwise(F.hex("_prefix"))
    return rows.withColumn("_hash", full).withColumn("_survives", both).drop("_hit1", "_hit2", "_length", "_prefix", "_norm")


def _groups(hashed: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), "_id"))
    groups = hashed.filter("_survives").groupBy("_hash").agg(best.alias("_best"), F.count("*").alias("group_size"))
    return groups.filter("group_size > 1").select(
        F.col("_hash").alias("content_hash"), F.col("_best._id").alias("keep_id"), "group_size"
    )


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[f"`{text_col}`"]
    return docs.select(docs[f"`{id_col}`"].alias("_id"), F.char_length(F.coalesce(text, F.lit(""))).alias("_points"), text.alias("_text"))


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS, slots: int = SLOTS,
) -> DataFrame:
    """One row per text that occurs more than once: content_hash, keep_id, group_size.

    The row with the most code points in the original text stays, then the smallest id; null ids
    come last. Null texts count as empty texts and are equal to those of white space only.
    """
    slim = _slim(docs, id_col, text_col)
    return _groups(_candidates(slim, "_text", _levels(slim, "_text", prefix_chars, slots), prefix_chars, slots))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_col: str | None = None,
    prefix_chars: int = PREFIX_CHARS, slots: int = SLOTS,
) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size and kept added.

    Null texts are empty texts. A null id is a value of its own and stays only where no other row of
    its group has an id. Rows that repeat an id with equal text count one by one in group_size; they
    are kept or dropped alike. An empty table gives an empty result. Columns of ``docs`` that have
    the names of the added ones are replaced. ``hash_col`` names a column that already holds
    ``full_hash(text)``.
    """
    slim = _slim(docs, id_col, text_col)
    levels = _levels(slim, "_text", prefix_chars, slots)
    groups = staged(_groups(_candidates(slim, "_text", levels, prefix_chars, slots)), "exact-groups")
    groups = groups.select(
        F.col("content_hash").alias("_hash"), F.col("keep_id").alias("_keep"),
        F.col("group_size").alias("_size"),
    )
    if hash_col:
        hashed = docs.withColumn("_hash", F.col(hash_col))
    else:
        hashed = _candidates(docs, text_col, levels, prefix_chars, slots)
    keep = F.when(F.col("_size").isNull(), F.col(id_col)).otherwise(F.col("_keep"))
    return (
        hashed.join(groups, "_hash", "left")
        .withColumns({"keep_id": keep, "group_size": F.coalesce("_size", F.lit(1).cast("long"))})
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
        .drop("_hash", "_survives", "_keep", "_size")
    )
