"""Words of a text in the two senses the operators use, on UTF-8 bytes; names and memories that they share."""

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z become a-z, every other ASCII byte outside 0-9 and a-z becomes a space, the rest stays.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the A-Z lower-cased text."""
    return utf8(text).translate(WORD_TABLE).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split parts at exactly that white space."""
    return utf8(text).split()


def unused(names: list[str]) -> str:
    """A name that is longer than all of these."""
    return max([*names, ""], key=len) + "_"


class Forgetful(dict):
    """Results of a function; ``limit`` recent ones are kept at least, twice as many at most."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self._make_room()
        self[key] = value
        return value

    def _make_room(self) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()

    def add(self, found: dict) -> None:
        """Results made elsewhere."""
        self._make_room()
        self.update(found)


def ids_by_words(texts: list[str], ids_of: Callable[[list[str]], list[bytes]], first: Callable[[str], np.ndarray] | None = None) -> list[np.ndarray]:
    """Ids of texts whose words stand between single spaces: those of the distinct words (bytes of unsigned
    32-bit integers) are put in the words' places. The first word of a text can have ids of its own.
    """
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    place = coded.indices.to_numpy()
    raws = ids_of(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
    flat, starts = np.frombuffer(b"".join(raws), "<u4"), np.cumsum(sizes) - sizes
    edges = split.offsets.to_numpy()
    lengths = sizes[place]
    if first is not None:
        lengths[edges[:-1]] = 0
    ends = np.cumsum(lengths)
    ids = flat[np.repeat(starts[place] - (ends - lengths), lengths) + np.arange(ends[-1])]
    bounds = np.concatenate([[0], ends[edges[1:] - 1]]).tolist()
    parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
    if first is None:
        return parts
    return [np.concatenate([first(text.split(" ", 1)[0]), part]) for text, part in zip(texts, parts)]
