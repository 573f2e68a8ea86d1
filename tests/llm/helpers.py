"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns; brute force."""

import re
import zlib

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score string"


def awkward(spark, extra=()):
    """Documents with every awkward case; the last three columns clash with names of results."""
    common = " ".join(f"passage{i}" for i in range(30))
    texts = [
        (0, "The quick brown fox  jumps\tover the lazy dog", "en"),
        (1, "Thequickbrown foxjumps over thelazydog", "en"),
        (2, None, "en"), (3, "", None), (4, " \t\n\x0b\x0c\r", "de"), (5, None, None),
        (None, "an id is missing here", "en"), (None, "an id is missing here", "en"),
        (7, "repeated row", "fr"), (7, "repeated row", "fr"), (7, "same id, other text", "fr"),
        (8, "Ärger über Öl, naïve café", "de"), (9, "1234 5678 !!! ...", "en"),
        (10, "start of ten " + common + " end of ten", "en"), (11, "eleven " + common + " eleven", "en"),
        (12, common, "en"), (13, "long " * 30000 + common, "en"), (14, "x" * 100000, "en"),
        (15, "\u2003wide\u00a0space <|endoftext|> it's 3.14,don't a.b", "en"),
        (16, common + " " + common, "en"),
    ]
    rows = [(i, t, lang, None if i in (3, 9) else f"src{(i or 0) % 3}", -1, 5, True, "clash") for i, t, lang in [*texts, *extra]]
    return spark.createDataFrame(rows, SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text, k=3):
    words = spaced_words(lowered(text))
    if not words:
        return 0
    k = min(k, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, radius):
    """Smallest id reachable from each document."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def without_substrings(docs, window):
    """{(id, text): kept words}; null ids last, rows equal in both are one document."""
    keys = sorted({(d is None, d or 0, xx(t), t or "") for d, t in docs})
    first, kept = {}, {}
    words = {key: spaced_words(key[3]) for key in keys}
    for key in keys:
        for i in range(len(words[key]) - window + 1):
            first.setdefault(tuple(words[key][i : i + window]), (key, i))
    for key in keys:
        gone = set()
        for i in range(len(words[key]) - window + 1):
            if first[tuple(words[key][i : i + window])] != (key, i):
                gone.update(range(i, i + window))
        kept[(None if key[0] else key[1], key[3])] = [w for i, w in enumerate(words[key]) if i not in gone]
    return kept


def xx(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return value - (1 << 64) if value >= 1 << 63 else value
