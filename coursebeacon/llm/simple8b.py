"""Simple-8b: unsigned integers packed into 64-bit words, vectorised both ways.

The top four bits of a word are its selector, which says how many values of how many bits the other
sixty hold. Values of more than 60 bits escape: the word holds an index into a list of exceptions.
Values come in blocks of equal length, each starting a word of its own, so that blocks can be packed
side by side and found by their offsets.
"""

import struct

import numpy as np

BLOCK = 1024
#: Blocks that are packed side by side.
BLOCKS = 512
#: Fixed by the coding: values in a word by selector; each takes 60 // count bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15
MAGIC, VERSION = b"S8BT", 1
HEADER = struct.Struct("<4sIQQIQQ")


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Exact up to 53 bits, above that at most one too many, which costs space only."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets of the blocks in words, exceptions)."""
    words, lengths, exceptions, known = [], [np.zeros(1, np.int64)], [], 0
    for i in range(0, len(values), BLOCKS * block):
        part = _pack(np.ascontiguousarray(values[i : i + BLOCKS * block], np.uint64), block, known)
        words.append(part[0])
        lengths.append(part[1])
        exceptions.append(part[2])
        known += len(part[2])
    join = lambda parts: np.concatenate([np.empty(0, np.uint64), *parts])
    return join(words), np.cumsum(np.concatenate(lengths)).astype(np.uint64), join(exceptions)


def _pack(values: np.ndarray, block: int, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, exceptions) of some blocks; ``known`` exceptions came before."""
    n_blocks = -(-len(values) // block)
    width = block + COUNTS[0]
    padded = np.zeros((n_blocks, width), np.uint64)
    whole = np.zeros(n_blocks * block, np.uint64)
    whole[: len(values)] = values
    padded[:, :block] = whole.reshape(n_blocks, block)
    bits = _bit_lengths(padded.ravel()).reshape(padded.shape)
    escaped = bits > 60
    exceptions = padded[escaped]
    padded[escaped] = np.arange(known, known + len(exceptions), dtype=np.uint64)
    # the most values that fit, for every place: a place keeps the first selector that fits it
    spans, length = {1: bits}, 1
    while 2 * length <= COUNTS[0]:
        low = spans[length]
        spans[2 * length] = np.maximum(low[:, : low.shape[1] - length], low[:, length:])
        length *= 2
    choice = np.full((n_blocks, block), ESCAPE, np.uint8)
    for selector in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[selector]
        half = 1 << (count.bit_length() - 1)
        most = np.maximum(spans[half][:, :block], spans[half][:, count - half : count - half + block])
        choice[most <= 60 // count] = selector
    choice[escaped[:, :block]] = ESCAPE
    step = np.array([*COUNTS, 0, 1], np.int64)
    ends = np.full(n_blocks, block, np.int64)
    ends[-1] = len(values) - (n_blocks - 1) * block
    rows, at, found = np.arange(n_blocks), np.zeros(n_blocks, np.int64), []
    while (going := at < ends).any():
        place = np.where(going, at, 0)
        found.append(np.where(going, place, -1))
        at = at + np.where(going, step[choice[rows, place]], 0)
    places = np.stack(found, 1)  # by block, then in order
    used = places >= 0
    of, place = np.nonzero(used)[0], places[used]
    chosen = choice[of, place].astype(np.uint64)
    words = chosen << np.uint64(60)
    flat, base = padded.ravel(), of * width + place
    for selector in np.unique(chosen):
        own = np.flatnonzero(chosen == selector)
        count = int(step[int(selector)])
        size = 60 // count
        for j in range(count):
            words[own] |= flat[base[own] + j] << np.uint64(size * j)
    return words, used.sum(1), exceptions


def unpack(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The values of ``pack``, as unsigned 64-bit integers."""
    result = np.empty(n, np.uint64)
    if not n:
        return result
    step = np.array([*COUNTS, 0, 1], np.int64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = step[selector]
    before = np.concatenate([[0], np.cumsum(counts)])
    firsts = offsets[:-1].astype(np.int64)
    lengths = np.diff(offsets.astype(np.int64))
    number = np.repeat(np.arange(len(firsts)), lengths)
    inside = before[:-1] - before[firsts][number]
    start = number * block + inside
    end = np.minimum((number + 1) * block, n)
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        count = int(step[s])
        size = 60 // count
        for j in range(count):
            kept = own[start[own] + j < end[own]]
            part = payload[kept] >> np.uint64(size * j)
            part &= np.uint64((1 << size) - 1)
            result[start[kept] + j] = exceptions[part.astype(np.int64)] if s == ESCAPE else part
    return result


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, values: np.ndarray, block: int = BLOCK) -> bytes:
    """A file: header, then for each document validity, id and length, block offsets, words, exceptions."""
    words, offsets, exceptions = pack(values, block)
    valid = np.array([i is not None for i in doc_ids], np.uint8)
    ids = np.array([i or 0 for i in doc_ids], "<i8")
    head = HEADER.pack(MAGIC, VERSION, len(doc_ids), len(values), block, len(words), len(exceptions))
    parts = (valid, ids, lengths.astype("<u8"), offsets.astype("<u8"), words.astype("<u8"), exceptions.astype("<u8"))
    return head + b"".join(p.tobytes() for p in parts)


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, values) of a file."""
    magic, version, n_docs, n, block, n_words, n_exceptions = HEADER.unpack_from(raw)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a token file")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(raw, kind, count, at)
        at += part.nbytes
        return part

    valid, ids, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs)
    offsets = take("<u8", -(-n // block) + 1)
    words, exceptions = take("<u8", n_words), take("<u8", n_exceptions)
    values = unpack(words, offsets, exceptions, n, block)
    return [i if v else None for i, v in zip(ids.tolist(), valid)], lengths.astype(np.int64), values
