"""Public tokenizers inside tasks, with the ids of pieces remembered between texts."""

import json
import os
import re
from collections.abc import Iterable
from struct import pack

import numpy as np

from coursebeacon.llm.words import Forgetful, ids_by_words

LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
#: A text is cut before white space, and before ASCII punctuation other than ' behind Latin letters.
#: The byte-level tokenizers part words at those places whatever stands around them, so ids of pieces
#: make up the ids of the text.
PIECES = re.compile(rf"[\t-\r ]*[{LATIN}]+(?=[!-&(-/:-@\[-`{{-~\t-\r ]|$)|[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
#: Other white space joins what stands before the cut; such texts are encoded whole.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Only letters, digits or punctuation, with or without a space before: one word to those tokenizers.
ONE_WORD = re.compile(rf"[ ]?(?:[{LATIN}]+|[0-9]+|[!-/:-@\[-`{{-~]+)")
#: Only letters: behind a space one word to those tokenizers.
SIMPLE = re.compile(rf"[{LATIN}]+")
#: Longer words and pieces are not merged with others.
LONGEST = 64
#: Words that a Python worker remembers: the last so many, twice as many at most (some 200 bytes each).
REMEMBERED = 300_000


def load(path: str):
    """A tokenizer of the tokenizers library; tasks are parallel, so it uses one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: themselves, or from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Byte-pair merges of many words at a time, a column per symbol; each round merges the best pair of each word."""

    NONE = np.int32(2**31 - 1)
    SLOTS = 20

    def __init__(self, tokenizer) -> None:
        model = json.loads(tokenizer.to_str())["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level merge model")
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.first = np.array([ids[c] for _, c in sorted(byte_characters().items())], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        # a table with one key a slot; the few keys that meet in a slot are looked for among all
        slot = self._slot(self.keys)
        self.slots = np.full(1 << self.SLOTS, -1, np.int64)
        self.slot_rank = np.full(1 << self.SLOTS, self.NONE)
        self.slots[slot], self.slot_rank[slot] = self.keys, self.rank_of
        self.crowded = np.bincount(slot, minlength=1 << self.SLOTS) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NONE for those that do not merge, ids below 0 included."""
        keys = left.astype(np.int64) << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = np.where(self.slots[slot] == keys, self.slot_rank[slot], self.NONE)
        again = np.flatnonzero(self.crowded[slot] & (found == self.NONE))
        if len(again):
            at = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            found[again] = np.where(self.keys[at] == keys[again], self.rank_of[at], self.NONE)
        return found

    def encode(self, words: list[bytes], together: int = 1 << 14) -> list[bytes]:
        """Ids of each word, as the bytes of unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))  # words of like length lie together
        for start in range(0, len(order), together):
            chosen = order[start : start + together]
            sizes = np.array([len(words[i]) for i in chosen])
            line = self.first[np.frombuffer(b"".join([words[i] for i in chosen]), np.uint8)]
            symbols = np.full((len(chosen), max(int(sizes[-1]), 2)), -1, np.int32)
            symbols[np.arange(symbols.shape[1]) < sizes[:, None]] = line
            symbols = self._merged(symbols)
            used = symbols >= 0
            raw = symbols[used].astype("<u4").tobytes()
            ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
            for i, a, b in zip(chosen, [0, *ends], ends):
                out[i] = raw[a:b]
        return out

    def _merged(self, symbols: np.ndarray) -> np.ndarray:
        rows = np.arange(len(symbols))
        own = symbols  # what still merges: rows ``rows`` of the whole
        ranks = self.ranks(own[:, :-1].ravel(), own[:, 1:].ravel()).reshape(len(own), -1)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            active = np.flatnonzero(best != self.NONE)
            if len(active) < len(own):
                if own is not symbols:
                    symbols[rows, : own.shape[1]] = own
                    symbols[rows, own.shape[1] :] = -1
                if not len(active):
                    return symbols
                own, ranks, rows, at, best = own[active], ranks[active], rows[active], at[active], best[active]
            n, width = own.shape
            lines, columns = np.arange(n), np.arange(width - 1)
            behind = columns > at[:, None]
            following = np.concatenate([own[:, 1:], np.full((n, 1), -1, np.int32)], axis=1)
            own = np.concatenate([np.where(behind, following[:, :-1], own[:, :-1]), following[:, -1:]], axis=1)
            own[lines, at] = self.merged[best]
            after = np.concatenate([ranks[:, 1:], np.full((n, 1), self.NONE)], axis=1)
            ranks = np.where(behind, after, ranks)
            ranks[lines, at] = self.ranks(own[lines, at], own[lines, at + 1])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.ranks(own[inner, at[inner] - 1], own[inner, at[inner]])


class Encoder:
    """Ids of texts by a byte-level tokenizer, by way of the remembered ids of words and pieces.

    Ids are kept as the bytes of unsigned 32-bit integers, so that those of a text are one join.
    """

    def __init__(self, path: str, limit: int = REMEMBERED) -> None:
        self.tokenizer = load(path)
        self.merges = Merges(self.tokenizer)
        self.pieces = Forgetful(self._piece, limit // 8)
        self.words = Forgetful(lambda word: self._pieces(" " + word), limit)

    def _piece(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text)))

    def _learn(self, words: list[str]) -> None:
        """Remembers what is new of distinct words, the single ones among it merged all at a time.

        Of a word with punctuation, letters behind its space are a word of their own and remembered as such.
        """
        parts: dict[str, list[str]] = {}
        new = self._new(words)
        for word in new:
            if not SIMPLE.fullmatch(word):
                parts[word] = PIECES.findall(" " + word)
        stems = {word: found[0][1:] for word, found in parts.items() if SIMPLE.fullmatch(found[0], 1)}
        plain = [word for word in {*new, *self._new(stems.values())} if word not in parts and len(word) < LONGEST]
        rest = {piece for word, found in parts.items() for piece in found[word in stems :]}
        rest = [piece for piece in rest if piece not in self.pieces and piece not in self.pieces.older]
        single = [piece for piece in rest if len(piece) < LONGEST and ONE_WORD.fullmatch(piece)]
        found = self.merges.encode([b" " + word.encode() for word in plain] + [piece.encode() for piece in single])
        self.pieces.add(dict(zip(single, found[len(plain) :])))
        self.words.add(dict(zip(plain, found)))
        get, piece_of = self.words.__getitem__, self.pieces.__getitem__
        self.words.add({
            word: get(stems[word]) + b"".join(map(piece_of, found[1:])) if word in stems else b"".join(map(piece_of, found))
            for word, found in parts.items()
        })

    def _new(self, words: Iterable[str]) -> list[str]:
        """Those not remembered; what was remembered longest ago is taken along."""
        older = self.words.older
        unknown = [word for word in words if word not in self.words]
        again = {word: older[word] for word in unknown if word in older}
        self.words.update(again)
        return [word for word in unknown if word not in again]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        self._learn(words)
        return list(map(self.words.__getitem__, words))

    def _first(self, word: str) -> np.ndarray:
        return np.frombuffer(self._pieces(word), "<u4")  # no space in front

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, as the library gives them without added special tokens."""
        out: list[np.ndarray | None] = [None] * len(texts)
        spaced = []
        for i, text in enumerate(texts):
            if OTHER_SPACE.search(text):
                out[i] = np.frombuffer(self._piece(text), "<u4")
            elif "  " in text or text[-1:] == " ":  # spaces that belong together
                out[i] = np.frombuffer(self._pieces(text), "<u4")
            else:
                spaced.append(i)
        if spaced:
            for i, ids in zip(spaced, ids_by_words([texts[i] for i in spaced], self._ids_of, self._first)):
                out[i] = ids
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}
_tokenizers: dict = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer; it stays for the worker's later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def counts(path: str, pieces: Iterable[str], batch: int = 4096) -> list[int]:
    """Tokens of each piece."""
    if path not in _tokenizers:
        _tokenizers[path] = load(path)
    tokenizer, pieces, found = _tokenizers[path], list(pieces), []
    for i in range(0, len(pieces), batch):
        found += [len(e) for e in tokenizer.encode_batch_fast(pieces[i : i + batch], add_special_tokens=False)]
    return found
