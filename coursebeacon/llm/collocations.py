"""Phrase collocations by Rabin-Karp fingerprints of every n-gram.

Prefix polynomials over the bytes of a block of texts give the fingerprint of each of its n-grams
without cutting any out. Fingerprints are counted by a shuffle, with the row of one occurrence and
with the least and the greatest value of a second polynomial, which tells phrases apart that share a
fingerprint. A phrase is at most as frequent as its parts, so longer ones are sent only where bit
tables of a fixed size have their parts as frequent. Only frequent phrases are read from the texts,
at the row that their count names; those with a shared fingerprint are counted anew by their text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from coursebeacon.llm.shipping import ship
from coursebeacon.llm.words import utf8
from coursebeacon.session import staged

WORDS = 3
LEAST, TOP = 10, 2000
#: A phrase goes if a longer one around it has at least this percentage of its occurrences.
ABSORBED = 50
#: Bytes of text whose n-grams are hashed and sorted together (some 80 times that in memory at most).
BLOCK_BYTES = 1 << 20
#: Slots of a bit table; 8 MB are broadcast. A full table costs work, not results.
SLOTS = 1 << 26
#: An odd multiplier for sums that wrap at 64 bits; a prime of 31 bits and a multiplier below it.
BASE, PRIME, PRIME_BASE = 0x9E3779B97F4A7C15, (1 << 31) - 1, 1_103_515_245
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
UNKNOWN_LANGUAGE = "und"

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BREAKS, BLANKS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANKS[list(b" \t")] = True


def _powers(base: int, count: int, modulus: int) -> np.ndarray:
    """base^0, base^1, ... by doubling."""
    found = np.ones(1, np.uint64)
    while len(found) < count:
        step = np.uint64(pow(base, len(found), modulus))
        more = found * step
        found = np.concatenate([found, more if modulus == 1 << 64 else more % np.uint64(modulus)])
    return found[:count]


_kept: list[np.ndarray] = [np.zeros(0, np.uint64)] * 4


def _tables(count: int) -> list[np.ndarray]:
    """Powers and inverse powers of both bases: one set of arrays per worker, made longer when needed."""
    if len(_kept[0]) < count:
        full, size = 1 << 64, -(-count // (1 << 18)) << 18
        _kept[:] = [
            _powers(BASE, size, full), _powers(pow(BASE, -1, full), size, full),
            _powers(PRIME_BASE, size, PRIME), _powers(pow(PRIME_BASE, -1, PRIME), size, PRIME),
        ]
    return _kept


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


class Block:
    """The words of some texts in one line, blanks reduced to one, and the polynomials over its bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]).translate(LOWER), np.uint8)
        breaks = BREAKS[raw]
        inside = ~(breaks | BLANKS[raw])
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        starts, ends = edges[::2], edges[1::2]  # the last byte is a break, so every word ends
        inside[ends] = True  # one byte behind each word stays, as a space
        self.line = raw[inside]
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.line[self.ends] = 32
        self.piece = np.cumsum(breaks, dtype=np.int32)[starts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text = np.searchsorted(np.cumsum(lengths), starts, side="right")
        power, self.inverse, prime_power, self.prime_inverse = _tables(len(self.line) + 1)
        letters = self.line.astype(np.uint64) + np.uint64(1)
        self.sums, self.prime_sums = np.zeros(len(letters) + 1, np.uint64), np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * power[: len(letters)], out=self.sums[1:])
        letters *= prime_power[: len(letters)]
        letters %= np.uint64(PRIME)
        np.cumsum(letters, out=self.prime_sums[1:])
        self.prime_sums %= np.uint64(PRIME)

    def places(self, size: int) -> np.ndarray:
        """First words of the n-grams that lie within a piece."""
        if len(self.piece) < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - size + 1] == self.piece[size - 1 :])

    def fingerprints(self, at: np.ndarray, size: int, seeds: np.ndarray, bits: int) -> np.ndarray:
        """Of the n-grams from the words ``at`` on; texts of one language have one seed."""
        a, b = self.starts[at], self.ends[at + size - 1]
        h = _mixed((self.sums[b] - self.sums[a]) * self.inverse[a] ^ seeds[self.text[at]])
        return h >> np.uint64(64 - bits)

    def checks(self, at: np.ndarray, size: int) -> np.ndarray:
        a, b, p = self.starts[at], self.ends[at + size - 1], np.uint64(PRIME)
        return (self.prime_sums[b] + p - self.prime_sums[a]) % p * self.prime_inverse[a] % p

    def phrase(self, at: int, size: int) -> str:
        return self.line[self.starts[at] : self.ends[at + size - 1]].tobytes().decode("utf-8", "surrogatepass")


@dataclass
class Grams:
    """Distinct fingerprints in ascending order: their check (bit 31 marks several phrases), count and least row."""

    prints: np.ndarray
    checks: np.ndarray
    counts: np.ndarray
    rows: np.ndarray

    SHARED = np.uint64(1 << 31)

    @classmethod
    def merged(cls, parts: list["Grams"]) -> "Grams":
        prints, checks, counts, rows = (np.concatenate([getattr(p, f) for p in parts]) for f in cls.__dataclass_fields__)
        if not len(prints):
            return cls(prints, checks, counts, rows)
        order = np.argsort(prints, kind="stable")
        prints, checks = prints[order], checks[order]
        first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
        plain = checks & (cls.SHARED - np.uint64(1))
        least, greatest = np.minimum.reduceat(plain, first), np.maximum.reduceat(plain, first)
        shared = (np.maximum.reduceat(checks, first) >= cls.SHARED) | (least != greatest)
        return cls(
            prints[first], least | np.where(shared, cls.SHARED, np.uint64(0)),
            np.add.reduceat(counts[order], first), np.minimum.reduceat(rows[order], first),
        )

    def chosen(self, where: np.ndarray) -> "Grams":
        return Grams(self.prints[where], self.checks[where], self.counts[where], self.rows[where])

    def packed(self) -> bytes:
        """Byte by byte of all values, so that the leading zeros of small ones lie together."""
        base = int(self.rows.min()) if len(self.rows) else 0
        columns = [self.prints.astype("<u8"), self.checks.astype("<u4"), self.counts.astype("<u8"), (self.rows - base).astype("<u8")]
        planes = [c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
        return b"".join([len(self.prints).to_bytes(8, "little"), base.to_bytes(8, "little", signed=True), *planes])

    @classmethod
    def unpacked(cls, raw: bytes) -> "Grams":
        n, base = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little", signed=True)
        at, found = 16, []
        for width in (8, 4, 8, 8):
            plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
            found.append(np.ascontiguousarray(plane).view(f"<u{width}").ravel())
            at += n * width
        return cls(found[0], found[1].astype(np.uint64), found[2].astype(np.int64), found[3].astype(np.int64) + base)


def _cut(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that end at breaks; a longer piece stays whole."""
    breaks = [bytes([b]) for b in np.flatnonzero(BREAKS)]
    while len(raw) > BLOCK_BYTES:
        at = max(raw.rfind(b, 0, BLOCK_BYTES) for b in breaks)
        if at < 0:
            later = [p for p in (raw.find(b, BLOCK_BYTES) for b in breaks) if p >= 0]
            if not later:
                break
            at = min(later)
        yield raw[: at + 1]
        raw = raw[at + 1 :]
    yield raw


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list[str], np.ndarray, np.ndarray]]:
    """(block, language, row number and seed of each of its texts) of batches of lang, row, text."""
    texts, langs, rows, size = [], [], [], 0
    seeds: dict[str, int] = {}

    def block():
        own = [seeds.setdefault(lang, _seed(lang)) for lang in langs]
        return Block(texts), langs, np.array(rows, np.int64), np.array(own, np.uint64)

    for batch in batches:
        for lang, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            for part in _cut(utf8(text.as_py())):
                if texts and size + len(part) > BLOCK_BYTES:
                    yield block()
                    texts, langs, rows, size = [], [], [], 0
                texts.append(part)
                langs.append(lang)
                rows.append(row)
                size += len(part)
    if texts:
        yield block()


def _seed(lang: str) -> int:
    return int(_mixed(np.array([sum(pow(BASE, i + 1, 1 << 64) * (b + 1) for i, b in enumerate(utf8(lang))) % (1 << 64)], np.uint64))[0])


def _hit(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    slot = prints & np.uint64(len(bits) * 64 - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bit_table(prints: DataFrame, slots: int) -> np.ndarray:
    """A bit for each fingerprint, by its last bits: slots / 64 words, whatever comes in."""
    slot = F.col("fp").bitwiseAND(F.lit(slots - 1))
    words = prints.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")
    ).toArrow()
    table = np.zeros(slots // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


@dataclass
class Miner:
    """The texts, written with a number per row, and what all passes over them share."""

    texts: DataFrame
    partitions: int
    least: int
    bits: int
    slots: int
    HELD = 300_000  # fingerprints that a task holds before it sends them

    def counts(self, size: int, parts: DataFrame | None) -> DataFrame:
        """(fp, n, shared, row) of the n-grams that occur often enough; for single words also the
        words of each language as (lang, n). ``parts`` are the frequent n-grams of one word less.
        """
        partitions, least, bits, held = self.partitions, self.least, self.bits, self.HELD
        known = None if parts is None else self.texts.sparkSession.sparkContext.broadcast(_bit_table(parts, self.slots))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: list[Grams] = []
            totals: dict[str, int] = {}

            def messages() -> pa.RecordBatch:
                grams = Grams.merged(own)
                own.clear()
                bucket = (grams.prints % np.uint64(partitions)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(partitions + 1))
                spans = [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if a < b]
                payloads = [grams.chosen(order[a:b]).packed() for _, a, b in spans]
                return _message([i for i, _, _ in spans], payloads, [None] * len(spans), [None] * len(spans))

            for block, langs, rows, seeds in _blocks(batches):
                at = block.places(size)
                if size > 1:
                    inner = block.places(size - 1)
                    frequent = np.zeros(len(block.starts) + 1, bool)
                    frequent[inner[_hit(known.value, block.fingerprints(inner, size - 1, seeds, bits))]] = True
                    at = at[frequent[at] & frequent[at + 1]]
                else:
                    for text, n in zip(*[x.tolist() for x in np.unique(block.text, return_counts=True)]):
                        totals[langs[text]] = totals.get(langs[text], 0) + n
                prints = block.fingerprints(at, size, seeds, bits)
                ones = np.ones(len(at), np.int64)
                own.append(Grams.merged([Grams(prints, block.checks(at, size), ones, rows[block.text[at]])]))
                if sum(len(g.prints) for g in own) > held:
                    yield messages()
            if own:
                yield messages()
            if totals:
                buckets = [_seed(lang) % partitions for lang in totals]
                yield _message(buckets, [None] * len(totals), list(totals), list(totals.values()))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Grams.merged([Grams(*[np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64)])])
            waiting: list[Grams] = []
            totals: dict[str, int] = {}
            for batch in batches:
                for payload, lang, n in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                    if payload is None:
                        totals[lang] = totals.get(lang, 0) + n
                        continue
                    waiting.append(Grams.unpacked(payload))
                    if sum(len(g.prints) for g in waiting) > held:  # what is held are distinct ones, and these
                        found, waiting = Grams.merged([found, *waiting]), []
            found = Grams.merged([found, *waiting])
            found = found.chosen(found.counts >= least)
            columns = [pa.array(found.prints.view(np.int64)), pa.array(found.counts), pa.array(found.checks >= Grams.SHARED),
                       pa.array(found.rows), pa.nulls(len(found.rows), pa.string())]
            names = ["fp", "n", "shared", "row", "lang"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if totals:
                empty = [pa.nulls(len(totals), t) for t in (pa.int64(), pa.bool_(), pa.int64())]
                columns = [empty[0], pa.array(list(totals.values()), pa.int64()), *empty[1:], pa.array(list(totals))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        sent = self.texts.mapInArrow(send, "bucket long, payload binary, lang string, n long")
        summed = sent.repartition(partitions, "bucket").mapInArrow(add, "fp long, n long, shared boolean, row long, lang string")
        return staged(summed, f"collocations-{size}")

    def read(self, counts: DataFrame) -> DataFrame:
        """Phrases of the fingerprints of (fp, size, row), at those rows: lang, size, fp, phrase, parts."""
        bits = self.bits
        wanted = counts.groupBy("row").agg(F.collect_list(F.struct("size", "fp")).alias("wanted"))
        rows = self.texts.join(wanted, "row").select("lang", "row", "text", "wanted")

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wanted = [(w["size"], w["fp"]) for ws in batch.column(3).to_pylist() for w in ws]
                found: set[tuple[int, int]] = set()
                for block, langs, _, seeds in _blocks(iter([batch.select(["lang", "row", "text"])])):
                    for size in range(2, WORDS + 1):
                        at = block.places(size)
                        prints = block.fingerprints(at, size, seeds, bits).view(np.int64)
                        asked = np.array([fp for s, fp in wanted if s == size and (s, fp) not in found], np.int64)
                        prints, first = np.unique(prints, return_index=True)
                        here = np.isin(prints, asked)
                        found.update((size, fp) for fp in prints[here].tolist())
                        yield _phrases(block, at[first[here]], size, langs, seeds, bits)
                if len(found) < len(set(wanted)):
                    raise ValueError("a counted phrase is not in its text")

        return rows.mapInArrow(look, PHRASES)

    def recount(self, shared: DataFrame) -> DataFrame:
        """The n-grams of shared fingerprints (fp), each counted by its text: as ``read``, and n."""
        bits, context = self.bits, self.texts.sparkSession.sparkContext
        known = context.broadcast(_bit_table(shared, self.slots))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, langs, _, seeds in _blocks(batches):
                for size in range(1, WORDS + 1):
                    at = block.places(size)
                    at = at[_hit(known.value, block.fingerprints(at, size, seeds, bits))]
                    yield _phrases(block, at, size, langs, seeds, bits)

        each = self.texts.mapInArrow(look, PHRASES)
        return each.groupBy("lang", "size", "fp", "phrase", "parts").agg(F.count("*").alias("n"))


PHRASES = "lang string, size long, fp long, phrase string, parts array<struct<fp:long,phrase:string>>"


def _message(buckets: list, payloads: list, langs: list, counts: list) -> pa.RecordBatch:
    columns = [pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary()), pa.array(langs, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "payload", "lang", "n"])


def _phrases(block: Block, at: np.ndarray, size: int, langs: list[str], seeds: np.ndarray, bits: int) -> pa.RecordBatch:
    """The phrases from the words ``at`` on, with both parts of each cut: first words, then the rest."""
    spans = [span for k in range(1, size) for span in ((0, k), (k, size - k))]
    columns = [block.fingerprints(at + shift, n, seeds, bits).view(np.int64).tolist() for shift, n in spans]
    prints = block.fingerprints(at, size, seeds, bits).view(np.int64)
    places = at.tolist()
    parts = [
        [{"fp": column[i], "phrase": block.phrase(place + shift, n)} for column, (shift, n) in zip(columns, spans)]
        for i, place in enumerate(places)
    ]
    kind = pa.list_(pa.struct([("fp", pa.int64()), ("phrase", pa.string())]))
    arrays = [pa.array([langs[t] for t in block.text[at].tolist()], pa.string()), pa.array([size] * len(places), pa.int64()),
              pa.array(prints), pa.array([block.phrase(p, size) for p in places], pa.string()), pa.array(parts, kind)]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "size", "fp", "phrase", "parts"])


def _score(a: str, first: str, rest: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    whole = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    above = f"CAST({whole(a)} * {whole(a)} * CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(38,0))"
    return F.expr(f"{above} div CAST({whole(first)} * {whole(rest)} AS DECIMAL(38,0))")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
    absorbed: int = ABSORBED, partition_bytes: int = 8 << 20, bits: int = 64, slots: int = SLOTS,
) -> DataFrame:
    """The best ``top`` phrases of two and three words per language: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs ``a`` >= ``least`` times, its parts at the cut of the lowest score ``l`` and ``r``
    times, of n words of the language. Phrases lie within pieces between ``. , ; : ! ?`` and line ends;
    A-Z count as a-z. A phrase goes if a longer one that contains it has at least ``absorbed`` percent
    of its occurrences. Null texts are empty, a null language is ``und``; equal scores are
    ordered by a (the greater first), then by the phrase's bytes. Repeated rows and rows without id
    count each. Other columns do not matter. An empty table gives an empty result. ``bits`` of a
    fingerprint are used: fewer make more phrases be counted by their text, not other results.
    """
    spark = ship(docs.sparkSession)
    lang = F.coalesce(docs[f"`{lang_col}`"].cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang")
    text = F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text")
    texts = staged(docs.select(lang, F.monotonically_increasing_id().alias("row"), text), "collocations-texts")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    miner = Miner(texts, 1 + size // partition_bytes, least, bits, slots)
    words = miner.counts(1, None)
    totals = words.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    levels = [words.filter("lang IS NULL")]
    for n in range(2, WORDS + 1):
        levels.append(miner.counts(n, levels[-1].select("fp")))
    numbered = [level.select(F.lit(i).cast("long").alias("size"), "fp", "n", "shared", "row") for i, level in enumerate(levels, 1)]
    every = numbered[0]
    for level in numbered[1:]:
        every = every.unionByName(level)
    alone = every.filter("NOT shared")
    found = miner.read(alone.filter("size > 1")).join(alone.select("size", "fp", "n"), ["size", "fp"])
    counted = alone.select("size", "fp", F.lit(None).cast("string").alias("phrase"), "n")
    shared = every.filter("shared").select("fp")
    if not shared.isEmpty():
        recounted = staged(miner.recount(shared).join(every.filter("shared").select("size", "fp"), ["size", "fp"], "left_semi"),
                           "collocations-recounted")
        found = found.unionByName(recounted.filter((F.col("size") > 1) & (F.col("n") >= least)))
        counted = counted.unionByName(recounted.select("size", "fp", "phrase", "n"))
    found = staged(found.select("lang", "size", "fp", "phrase", "parts", F.col("n").alias("a")), "collocations-phrases")
    return _ranked(found, counted, not shared.isEmpty(), totals, top, absorbed)


def _ranked(found: DataFrame, counted: DataFrame, by_text: bool, totals: DataFrame, top: int, absorbed: int) -> DataFrame:
    part = found.select("lang", "phrase", "size", "a", F.posexplode("parts").alias("place", "part"))
    width = F.when(F.col("place") % 2 == 0, (F.col("place") / 2).cast("int") + 1).otherwise(
        F.col("size") - (F.col("place") / 2).cast("int") - 1
    )
    part = part.select("*", F.col("part.fp").alias("fp"), F.col("part.phrase").alias("own"), width.cast("long").alias("width"))
    known = counted.select(F.col("size").alias("width"), "fp", F.col("phrase").alias("text"), F.col("n").alias("f"))
    joined = part.join(known, ["width", "fp"])
    if by_text:
        joined = joined.filter(F.col("text").isNull() | (F.col("text") == F.col("own")))
    scored = joined.groupBy("lang", "phrase", "size", "a").agg(
        *[F.max(F.when(F.col("place") == i, F.col("f"))).alias(f"p{i}") for i in range(4)]
    ).withColumns({"first_cut": _score("a", "p0", "p1"), "second_cut": F.when(F.col("size") == 3, _score("a", "p2", "p3"))})
    second = F.coalesce(F.col("second_cut") < F.col("first_cut"), F.lit(False))
    pick = lambda x, y: F.when(second, F.col(x)).otherwise(F.col(y))
    scored = scored.select(
        "lang", "phrase", "a", pick("p2", "p0").alias("l"), pick("p3", "p1").alias("r"),
        pick("second_cut", "first_cut").alias("score"),
    )
    longer = found.filter("size = 3").select("lang", F.col("a").alias("around"), F.expr("inline(array(parts[1], parts[2]))"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = scored.join(longer, ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("around") < absorbed * F.col("a"), F.lit(True))
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = left.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
