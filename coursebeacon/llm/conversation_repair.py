"""Conversation structure repair: the cheapest edits that make the roles alternate.

Turns are sorted over range partitions of conversation and turn. A conversation that lies inside one
partition is repaired there. One that reaches over the border of partitions, however many, is repaired
by sections: a section maps each vector of costs behind it to the one in front (`repair_tables`), these
maps meet in one small group per conversation, and each section is then edited where it lies. So no
task holds more than a partition's share of a conversation.
"""

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from coursebeacon.llm import repair_tables
from coursebeacon.llm.repair_tables import GONE, INITIALS, OTHER, TRUNCATED, Tables
from coursebeacon.llm.shipping import ship
from coursebeacon.session import staged

#: Bytes of turns behind one partition.
PARTITION_BYTES = 16 << 20
#: Bytes of repaired text that go to the digest of a long conversation in one row.
PIECE_BYTES = 16 << 10
#: Equal rows of one turn are spread over so many range keys.
SALTS = 1024
WHITE_SPACE = " \t\n\x0b\x0c\r"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
SUMS = ["blank", "duplicate", "truncated", "illegal"]


@cache
def tables() -> Tables:
    return Tables()


def symbols_of(roles: list[str], texts: list[str], first: set[int] | None = None) -> tuple[bytes, dict[str, int]]:
    """The symbol of each turn and the number of each fault. ``first`` holds the places of the turns that
    repeat none before them; without it they are found among the given ones.
    """
    seen: set[tuple[str, str]] = set()
    symbols, faults = bytearray(), dict.fromkeys(SUMS, 0)
    last = None
    for at, (role, text) in enumerate(zip(roles, texts)):
        initial = role[:1]
        if last is not None and (last, initial) not in LEGAL:
            faults["illegal"] += 1
        last = initial
        said = text.rstrip(WHITE_SPACE)
        if first is None:
            repeated = (role, text) in seen
            seen.add((role, text))
        else:
            repeated = at not in first
        if not said or repeated:
            faults["duplicate" if said else "blank"] += 1
            symbols.append(GONE)
        else:
            cut = said[-1] not in ".!?"
            faults["truncated"] += cut
            symbols.append(INITIALS.get(initial, OTHER) + TRUNCATED * cut)
    return bytes(symbols), faults


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _sorted_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, partition_bytes: int) -> DataFrame:
    slim = turns.select(
        turns[f"`{conv_col}`"].alias("conv"), turns[f"`{turn_col}`"].cast("long").alias("turn"),
        F.coalesce(turns[f"`{role_col}`"], F.lit(" ")).alias("role"), F.coalesce(turns[f"`{text_col}`"], F.lit(" ")).alias("text"),
    )
    size = slim.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 16)).first()[0] or 0
    keyed = slim.withColumns({
        "tie": F.xxhash64("text"), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"),
    })
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie"]
    ranged = keyed.repartitionByRange(1 + size // partition_bytes, *order, "salt")
    return ranged.sortWithinPartitions(*order, "salt").select("conv", "turn", "role", "text")


SECTION = [
    StructField("section", LongType()), StructField("edge", BooleanType()), StructField("cost", LongType()),
    *[StructField(name, LongType()) for name in SUMS],
    StructField("min_turn", LongType()), StructField("max_turn", LongType()), StructField("turns", LongType()),
    StructField("audit", StringType()), StructField("repaired_sha256", StringType()),
    StructField("roles", ArrayType(StringType())), StructField("texts", ArrayType(StringType())),
    StructField("lines", ArrayType(StringType())),
]


def _batch(rows: list[dict], schema: StructType, conv: pa.DataType) -> pa.RecordBatch:
    """Rows as a batch of the schema; the ids of conversations keep the type they came with."""
    kinds = [conv if f.name == "conv" else to_arrow_type(f.dataType) for f in schema.fields]
    columns = [pa.array([row.get(name) for row in rows], kind) for name, kind in zip(schema.names, kinds)]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _sections(rows: DataFrame, with_lines: bool) -> DataFrame:
    """A row per conversation and partition: repaired, or (the first and the last of a partition) as it is."""
    schema = StructType([rows.schema["conv"], *SECTION])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        own: tuple[list, list, list] = ([], [], [])
        current, any_yet, at_start, kind = None, False, True, None
        out: list[dict] = []

        def close(edge: int | None) -> dict:
            turns, roles, texts = own
            known = [t for t in turns if t is not None]
            row = {"conv": current, "edge": edge is not None, "turns": len(set(known)),
                   "min_turn": min(known, default=None), "max_turn": max(known, default=None)}
            if edge is not None:
                return row | {"section": 2 * partition + edge, "roles": roles, "texts": texts}
            symbols, faults = symbols_of(roles, texts)
            cost, audit = tables().repair(symbols)
            lines = repair_tables.lines(roles, texts, audit)
            row |= faults | {"cost": cost, "audit": audit, "repaired_sha256": digest(lines)}
            return row | {"lines": lines} if with_lines else row

        def flush() -> pa.RecordBatch:
            batch = _batch(out, schema, kind)
            out.clear()
            return batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if any_yet and conv != current:
                    out.append(close(0 if at_start else None))
                    at_start, own = False, ([], [], [])
                    if len(out) >= 1000:
                        yield flush()
                current, any_yet = conv, True
                own[0].append(turn)
                own[1].append(role)
                own[2].append(text)
        if any_yet:
            out.append(close(1))
            yield flush()

    return rows.mapInArrow(run, schema)


def _firsts(edges: DataFrame) -> DataFrame:
    """(section, first): places of the turns that repeat none before them, among all sections of their conversation."""
    each = edges.select("conv", "section", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn")).select(
        "conv", (F.col("section") * (1 << 32) + F.col("at")).alias("place"), F.col("turn.roles").alias("role"),
        F.sha2("turn.texts", 256).alias("text"),
    )
    first = each.groupBy("conv", "role", "text").agg(F.min("place").alias("place"))
    place = F.expr("place div 4294967296").alias("section"), F.expr("cast(place % 4294967296 as int)").alias("at")
    return first.select(*place).groupBy("section").agg(F.collect_list("at").alias("first"))


def _maps(edges: DataFrame) -> DataFrame:
    """Each section's symbols, faults, outer initials and its map from vectors behind to vectors in front."""
    lists = ["symbols", "front", "cost_added", "exits"]
    fields = [edges.schema["conv"], StructField("section", LongType()), *[StructField(n, LongType()) for n in SUMS],
              StructField("initials", StringType()), StructField("symbols", BinaryType()),
              *[StructField(n, ArrayType(LongType())) for n in lists[1:]]]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                symbols, faults = symbols_of(row["roles"], row["texts"], set(row["first"] or ()))
                front, cost, exits = tables().section(symbols)
                found = faults | {
                    "conv": row["conv"], "section": row["section"], "symbols": symbols, "front": front, "cost_added": cost,
                    "exits": exits, "initials": f"{row['roles'][0][:1] or ' '}{row['roles'][-1][:1] or ' '}",
                }
                yield _batch([found], schema, batch.schema.field(0).type)

    joined = edges.select("conv", "section", "roles", "texts").join(_firsts(edges), "section", "left")
    return joined.select("conv", "section", "roles", "texts", "first").mapInArrow(run, schema)


def _settled(maps: DataFrame) -> DataFrame:
    """(section, behind, state, last, cost, joints): what each section needs of the others, one group of
    small rows (as many as partitions at most) per conversation. Cost stands in the last section's row.
    """
    schema = "section long, behind long, state long, last boolean, cost long, joints long"

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["section"])
        own, vector, cost, behind = tables(), 0, 0, []
        for row in reversed(rows):
            behind.append(vector)
            cost += row["cost_added"][vector]
            vector = row["front"][vector]
        cost += int(own.vectors[vector][repair_tables.START])
        state, out = repair_tables.START, []
        for i, (row, vector) in enumerate(zip(rows, reversed(behind))):
            illegal = i > 0 and (rows[i - 1]["initials"][1], row["initials"][0]) not in LEGAL
            last = i == len(rows) - 1
            out.append({"section": row["section"], "behind": vector, "state": state, "last": last,
                        "cost": cost if last else 0, "joints": int(illegal)})
            state = row["exits"][4 * vector + state]
        kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2
        names = ["section", "behind", "state", "last", "cost", "joints"]
        return pa.table([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds)], names=names)

    slim = maps.select("conv", "section", "front", "cost_added", "exits", "initials")
    return slim.groupBy("conv").applyInArrow(run, schema)


def _edited(edges: DataFrame, maps: DataFrame) -> DataFrame:
    """The sections with their edits and repaired lines; the last one of a conversation has its ending."""
    schema = StructType([edges.schema["conv"], StructField("section", LongType()), StructField("audit", StringType()),
                         StructField("lines", ArrayType(StringType()))])
    found = _settled(maps).select("section", "behind", "state", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                audit = tables().section_edits(row["symbols"], row["behind"], row["state"])
                if row["last"]:
                    _, _, exits = tables().section(row["symbols"])
                    audit += repair_tables.ending(exits[4 * row["behind"] + row["state"]])
                lines = repair_tables.lines(row["roles"], row["texts"], audit, row["state"])
                found = {"conv": row["conv"], "section": row["section"], "audit": audit, "lines": lines}
                yield _batch([found], schema, batch.schema.field(0).type)

    rows = edges.select("conv", "section", "roles", "texts").join(maps.select("section", "symbols"), "section")
    rows = rows.join(found, "section").select("conv", "section", "roles", "texts", "symbols", "behind", "state", "last")
    return rows.mapInArrow(run, schema)


def _digests(edited: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256) of conversations in sections, read in order and in small pieces."""
    conv = edited.schema["conv"]
    pieces = StructType([conv, StructField("section", LongType()), StructField("number", LongType()),
                         StructField("audit", StringType()), StructField("piece", BinaryType())])
    schema = StructType([conv, StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = b"".join(b"\n" + line.encode("utf-8", "surrogatepass") for line in row["lines"])
                parts = [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)] or [b""]
                n = len(parts)
                arrays = [pa.array([row["conv"]] * n, batch.schema.field(0).type), pa.array([row["section"]] * n),
                          pa.array(range(n), pa.int64()), pa.array([row["audit"], *[""] * (n - 1)]), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=pieces.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, audit, sha, begun, any_yet, kind = None, [], hashlib.sha256(), False, False, None

        def row() -> pa.RecordBatch:
            return _batch([{"conv": current, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema, kind)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, _, _, letters, piece in zip(*[c.to_pylist() for c in batch.columns]):
                if any_yet and conv != current:
                    yield row()
                    audit, sha, begun = [], hashlib.sha256(), False
                current, any_yet = conv, True
                audit.append(letters)
                sha.update(piece if begun else piece[1:])  # no newline in front of the first line
                begun = begun or bool(piece)
        if any_yet:
            yield row()

    cuts = edited.select("conv", "section", "audit", "lines").mapInArrow(cut, pieces)
    order = cuts.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "section", "number")
    return order.mapInArrow(add, schema)


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    with_lines: bool = False, partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Turns are taken by turn, nulls first, those of one turn by role and then by a hash of the text. Null
    roles and texts count as one space. A null id is a conversation of its own. Repeated rows are
    duplicates. Other columns do not matter, whatever their names. An empty table gives an empty
    result. The edits of ``audit`` (Keep, Rerole, Delete, Insert) cost least and are, of those, the first
    in ASCII order. ``with_lines`` gives instead a row per conversation and section of it, with the
    section's repaired turns as role:text in ``lines``, sections in the order of ``section`` (null for
    one that is whole).
    """
    ship(turns.sparkSession)
    rows = _sorted_turns(turns, conv_col, turn_col, role_col, text_col, partition_bytes)
    found = staged(_sections(rows, with_lines), "repair-sections")
    edges = found.filter("edge")
    maps = staged(_maps(edges), "repair-maps")
    edited = staged(_edited(edges, maps), "repair-edited")
    whole = found.filter("NOT edge")
    if with_lines:
        lines = whole.select("conv", "section", "lines").unionByName(edited.select("conv", "section", "lines"))
        return lines.withColumnRenamed("conv", conv_col)
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).cast("long")
    result = ["conv", gaps.alias("gaps"), *SUMS, "cost", "audit", "repaired_sha256"]
    # turns of two sections can be the same one: sections' outer turns decide
    counted = maps.select("section", *SUMS).join(_settled(maps).select("section", "cost", "joints"), "section")
    counted = counted.withColumn("illegal", F.col("illegal") + F.col("joints")).drop("joints")
    spans = edges.select("conv", "section", "min_turn", "max_turn", "turns").join(counted, "section")
    bounds = F.array_sort(F.collect_list(F.when(F.col("turns") > 0, F.struct("section", "min_turn", "max_turn"))))
    shared = F.aggregate(
        F.sequence(F.lit(1), F.size("bounds") - 1), F.lit(0),
        lambda n, i: n + F.when(F.col("bounds")[i]["min_turn"] == F.col("bounds")[i - 1]["max_turn"], 1).otherwise(0),
    )
    sums = spans.groupBy("conv").agg(
        bounds.alias("bounds"), F.min("min_turn").alias("min_turn"), F.max("max_turn").alias("max_turn"),
        F.sum("turns").alias("all"), *[F.sum(n).alias(n) for n in [*SUMS, "cost"]],
    ).withColumn("turns", F.col("all") - F.when(F.size("bounds") > 1, shared).otherwise(0))
    digests = _digests(edited).withColumnRenamed("conv", "_conv")
    joined = sums.join(digests, F.col("conv").eqNullSafe(F.col("_conv")))
    everything = whole.select(*result).unionByName(joined.select(*result))
    return everything.withColumnRenamed("conv", conv_col)
