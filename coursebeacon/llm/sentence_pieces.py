"""SentencePiece encoding by a table of prefixes, and decoding.

A text has one sequence of pieces under the model's merges, and so has each of its prefixes. The
table stores the last piece of every prefix: an automaton names the pieces that end at a position,
and the one that is right is the one that the last piece of the prefix before it stands beside,
unmerged, when the two are merged on their own. No two merges of the text need be replayed. The ids
are then read off backwards, from the end of the text.

Two neighbours stay apart in a text exactly if they stay apart on their own: the merges inside two
neighbouring pieces happen in the same order with and without the rest of the text, so a merge across
their border would come up in both or in neither.
"""

import math
from array import array
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from coursebeacon.llm.shipping import ship
from coursebeacon.llm.words import Forgetful, unused

SPACE = "▁"
#: Words and parts of words, and pairs of pieces, that a Python worker remembers (some 50 MB each).
REMEMBERED = 150_000
REMEMBERED_PAIRS = 400_000
#: Parts longer than this are not remembered.
LONGEST = 64
#: Bytes of text behind one batch of results.
BATCH_BYTES = 4 << 20


class Row(dict):
    """Whether each piece can follow a given last piece, found out when first asked."""

    def __init__(self, stays, left: int) -> None:
        super().__init__()
        self.stays, self.left = stays, left

    def __missing__(self, right: int) -> bool:
        value = self[right] = self.stays(self.left, right)
        return value


class Following(dict):
    """The row of each last piece."""

    def __init__(self, stays) -> None:
        super().__init__()
        self.stays = stays

    def __missing__(self, left: int) -> Row:
        value = self[left] = Row(self.stays, left)
        return value


class PrefixEncoder:
    """Ids of texts under a merge-type model without normalisation that puts a space in front."""

    def __init__(self, path: str, remembered: int = REMEMBERED, pairs: int = REMEMBERED_PAIRS) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ½\t ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}½\t{SPACE}":
            raise ValueError(f"{path} normalises texts or puts no space in front of them")
        self.pieces: list[str] = []
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        for i in range(model.vocab_size()):
            piece, plain = model.id_to_piece(i), ""
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[piece], plain = model.get_score(i), piece
            self.pieces.append(plain)
        #: Neighbouring characters of pieces: between any others no merge reaches across.
        self.joined = {piece[k : k + 2] for piece in self.scores for k in range(len(piece) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.joined):
            raise ValueError(f"{path} has pieces that reach across words")
        #: Characters that pieces have; those that are no pieces themselves count as such in tables.
        self.known = set("".join(self.scores))
        self.pieces += sorted(self.known - self.scores.keys())
        self.lengths = list(map(len, self.pieces))
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if piece:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.histories: dict[int, list[tuple[float, str, str]] | None] = {}
        self.following, self.pairs, self.most_pairs = Following(self.stays), 0, pairs
        self.parts = Forgetful(self._part, remembered // 4)
        self.words = Forgetful(self._word, remembered)

    def history(self, token: int) -> list[tuple[float, str, str]] | None:
        """The merges that make the piece out of its characters: the score of each, and the first and
        the last symbol before it; at the end the piece itself. None if they do not lead to the piece.
        """
        if token not in self.histories:
            symbols, scores, steps = list(self.pieces[token]), self.scores, []
            while len(symbols) > 1:
                found = [scores.get(a + b, -math.inf) for a, b in pairwise(symbols)]
                best = max(found)
                if best == -math.inf:
                    break
                at = found.index(best)  # the leftmost of equal ones
                steps.append((best, symbols[0], symbols[-1]))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((-math.inf, symbols[0], symbols[-1]))
            self.histories[token] = steps if len(symbols) == 1 else None
        return self.histories[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether two pieces merged side by side end as these two; with ``left`` -1, the right one alone."""
        self.pairs += 1
        own = self.history(right)
        if left < 0 or own is None:
            return own is not None
        other = self.history(left)
        if other is None:
            return False
        i = j = 0
        while True:
            (before, _, end), (after, start, _) = other[i], own[j]
            across = self.scores.get(end + start)
            # of equal scores the leftmost goes first: left piece, border, right piece
            if across is not None and across > before and across >= after:
                return False
            if before == after == -math.inf:
                return True
            if before >= after:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> list[int]:
        """The last piece of each prefix of a text of known characters; -1 for the empty prefix."""
        last = [-1] * (len(text) + 1)
        rows: list[Row | None] = [None] * (len(text) + 1)
        rows[0], following = self.following[-1], self.following
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if rows[end] is None and rows[end - length][token]:
                last[end], rows[end] = token, following[token]
        return last

    def _part(self, part: str) -> bytes:
        if not self.known.issuperset(part):  # a character of no piece, alone as no merge reaches it
            return array("I", [self.bytes[b] for b in part.encode("utf-8")]).tobytes()
        if self.pairs > self.most_pairs:  # forget them all; those needed come back
            self.following, self.pairs = Following(self.stays), 0
        last, lengths, pieces, at, found = self.table(part), self.lengths, self.pieces, len(part), []
        while at:
            token = last[at]
            at -= lengths[token]
            if pieces[token] in self.scores:
                found.append(token)
            else:
                found += [self.bytes[b] for b in reversed(part[at].encode("utf-8"))]
        found.reverse()
        return array("I", found).tobytes()

    def _pieced(self, text: str) -> bytes:
        """Ids of a text with its spaces marked, from those of the parts no merge reaches out of."""
        joined, parts, start, found = self.joined, self.parts, 0, []
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in joined]
        for cut in [*cuts, len(text)]:
            part = text[start:cut]
            found.append(parts[part] if cut - start <= LONGEST else self._part(part))
            start = cut
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        plain = word.isalpha() and self.known.issuperset(word)
        return self._part(SPACE + word) if plain else self._pieced(SPACE + word)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, without begin and end."""
        words = text.replace(SPACE, " ").split(" ")
        if "" in words or len(text) > LONGEST * len(words):  # spaces in a row, or words too long to remember
            raw = self._pieced((SPACE + text).replace(" ", SPACE)) if text else b""
        else:
            raw = b"".join(map(self.words.__getitem__, words))
        return np.frombuffer(raw, "<u4")

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_encoders: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a model; it stays for the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode(
    docs: DataFrame, model: str, text_col: str = "text", out: str = "ids", decoded: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with the ids of their whole texts and, if ``decoded`` names a column, the
    text that these ids give again.

    Ids are those of the sentencepiece library for the file ``model``, without begin and end. Null
    and empty texts have no ids and decode to the empty text. Rows are encoded one by one, so ids of
    documents, null or repeated, do not matter; an empty table gives an empty result. ``keep`` names
    the columns that are returned (all by default); those named like the added ones are replaced.
    """
    ship(docs.sparkSession)
    added = [out] if decoded is None else [out, decoded]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    slim = docs.select(*[docs[f"`{c}`"] for c in names], docs[f"`{text_col}`"].alias(unused(names)))
    fields = [*slim.schema.fields[:-1], StructField(out, ArrayType(IntegerType(), False))]
    schema = StructType(fields + [StructField(decoded, StringType())] if decoded else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            start, ids, texts, size = 0, [], [], 0
            column = batch.column(batch.num_columns - 1)
            for row, scalar in enumerate(column, 1):
                text = scalar.as_py() or ""
                found = own.encode(text)
                ids.append(found)
                if decoded:
                    texts.append(own.decode(found.tolist()))
                size += len(text)
                if size >= BATCH_BYTES or row == batch.num_rows:
                    edges = np.cumsum([0, *map(len, ids)])
                    columns = batch.columns[:-1]
                    columns = [c.slice(start, row - start) for c in columns]
                    flat = pa.array(np.concatenate(ids).astype(np.int32), pa.int32())
                    columns.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat))
                    if decoded:
                        columns.append(pa.array(texts, pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
                    start, ids, texts, size = row, [], [], 0

    return slim.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """All rows with the text of their ids; null and empty ids give the empty text.

    A column named like the added one is replaced. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c != out]
    slim = docs.select(*[docs[f"`{c}`"] for c in names], docs[f"`{ids_col}`"].alias(unused(names)))
    schema = StructType([*slim.schema.fields[:-1], StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return slim.mapInArrow(run, schema)
