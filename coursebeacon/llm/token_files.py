"""Token-ID output: documents as binary files of Simple-8b coded ids, and back.

Documents are range-partitioned by id, so that files in the order of their names hold them in
ascending order. A file is written under a name of its own attempt and then moved, so a task that is
run again, or twice at a time, leaves the same file.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from coursebeacon.llm import simple8b, tokenizing
from coursebeacon.llm.shipping import filesystem, ship
from coursebeacon.session import staged, work_path

#: Bytes of text behind one partition, and ids in a file at most (one document can be larger).
PARTITION_BYTES = 16 << 20
FILE_IDS = 1 << 21
#: Partitions whose totals are added up in one task.
GROUP = 4096
#: Characters whose new words are merged together.
SLICE_CHARS = 1 << 20
#: Equal rows are spread over so many range keys.
SALTS = 1024


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, so many at a time as make up ``SLICE_CHARS``."""
    docs, texts, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        docs.append(doc)
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= SLICE_CHARS:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id",
    text_col: str = "text", partition_bytes: int = PARTITION_BYTES, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Writes ``docs`` to files in ``folder``, a path of the shared store; the manifest of the files.

    Ids are those of the tokenizers file ``tokenizer`` without added special tokens, then
    ``end_id``. Documents are in ascending id order, null ids first, rows of one id by a hash of
    their text. Null texts are empty texts. No documents make no files. Ids other than integers or null
    are an error. The manifest has partition,
    number, name, n_docs, n_ids.
    """
    if not isinstance(docs.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"column {id_col} must hold integers: files store ids as such")
    spark = ship(docs.sparkSession)
    store, path = filesystem(folder)
    store.create_dir(path)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    slim = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    # rows of one id, and equal rows (exchangeable), are spread over partitions as well
    tie, salt = F.xxhash64("text").alias("tie"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    order = [F.col("id").asc_nulls_first(), "tie", "salt"]
    ranged = slim.select("id", "text", tie, salt).repartitionByRange(1 + total // partition_bytes, *order)
    ranged = ranged.sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get()
        encode_all = tokenizing.encoder(tokenizer).encode_all
        store, path = filesystem(folder)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, parts, size, number
            name = f"part-{own.partitionId():07d}-{number:05d}.s8b"
            lengths = np.array([len(p) for p in parts], np.int64)
            raw = simple8b.to_bytes(doc_ids, lengths, np.concatenate(parts))
            attempt = f"{path}/_{name}.{own.taskAttemptId()}"
            with store.open_output_stream(attempt) as out:
                out.write(raw)
            store.move(attempt, f"{path}/{name}")
            row = {"partition": [own.partitionId()], "number": [number], "name": [name], "n_docs": [len(parts)], "n_ids": [size]}
            doc_ids, parts, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for docs, texts in _slices(batch):
                for doc, ids in zip(docs, encode_all(texts)):
                    doc_ids.append(doc)
                    parts.append(np.concatenate([ids, tail]))
                    size += len(parts[-1])
                    if size >= file_ids:
                        yield flush()
        if parts:
            yield flush()

    manifest = ranged.mapInArrow(write, "partition long, number long, name string, n_docs long, n_ids long")
    return staged(manifest, "token-manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: name, id, position in the file, n_tokens, ids_crc32, ids."""
    ship(spark)
    schema = "name string, id long, position long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, values = simple8b.from_bytes(content.as_py())
                ends = np.cumsum(lengths)
                small = values.astype("<u4")
                columns = [
                    pa.array([name] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(small[b - n : b].tobytes()) for b, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
                ]
                if with_ids:
                    edges = pa.array(np.append(ends - lengths, ends[-1:]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(edges, pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder)
    name = F.substring_index("path", "/", -1).alias("name")
    return files.select(name, "content").mapInArrow(read, schema)


def file_starts(manifest: DataFrame) -> DataFrame:
    """(name, file_start): ids in all files before; sums go by groups of partitions, then over those."""
    grouped = manifest.withColumn("group", F.floor(F.col("partition") / GROUP))
    sums = grouped.groupBy("group").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("group", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("group").orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    return grouped.withColumn("own", own).join(starts, "group").select("name", (F.col("base") + F.col("own")).alias("file_start"))


def token_output(
    docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Writes token files and reads them back: one row per document.

    Columns: the id (named as in ``docs``), start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids. Ids must be integers or null. ``folder`` defaults to a new one
    below the shared folder. An empty table gives an empty result; other columns do not matter.
    """
    spark = docs.sparkSession
    folder = folder or work_path(spark, "tokens")
    manifest = write_token_files(docs, folder, tokenizer, end_id, id_col, text_col)
    if manifest.isEmpty():
        schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
        return spark.createDataFrame([], schema)
    starts = staged(file_starts(manifest), "token-starts")
    more = ["ids"] if with_ids else []
    return read_token_files(spark, folder, with_ids).join(starts, "name").select(
        F.col("id").alias(id_col), (F.col("file_start") + F.col("position")).alias("start"), "n_tokens", "ids_crc32", *more
    )
