"""Cheapest edits of a sequence of turns by block tables (the method of the Four Russians).

A turn is one of nine symbols: what it may be kept as, and whether it lacks its end, or that it must
go. Read from the right, the costs of what is left to do from each of four states, less their least,
take few values; so the step over any block of symbols is looked up by the costs behind the block.
The edits are read off from the left: a block is expanded backwards from the costs behind it, and of
the edits that lead on at least cost the first in ASCII order is taken.
"""

import math
from functools import lru_cache

import numpy as np

#: Symbols 0 to 3: system, user, assistant, another role; 4 more if truncated; 8 must be deleted.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, TRUNCATED, GONE, SYMBOLS = 3, 4, 8, 9
#: States: nothing said yet, the system, the user or the assistant spoke last. Two of them may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state in which a turn that continues properly leaves, by the state before it.
FOLLOWING = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, LACKS_END = 3, 2, 2, 1
BLOCK = 4

Costs = tuple[float, ...]


def with_inserts(costs: Costs) -> Costs:
    """Costs from each state if turns may be put in first."""
    best = list(costs)
    for _ in range(2):
        best = [min(best[q], INSERT + best[FOLLOWING[q]]) for q in range(4)]
    return tuple(best)


END = with_inserts((0, math.inf, math.inf, 0))


def kept_as(symbol: int, state: int) -> int | None:
    """The state after a turn that is kept, or None where it may not stand."""
    role = symbol % 4
    if symbol == GONE or role == OTHER:
        return None
    if role == INITIALS["s"]:
        return SYSTEM if state == START else None
    return FOLLOWING[state] if (role == INITIALS["u"]) == (FOLLOWING[state] == USER) else None


def choices(symbol: int, state: int) -> list[tuple[str, float, int]]:
    """(letter, cost, state after) of the edits that use up the symbol, in ASCII order."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        extra = LACKS_END if symbol >= TRUNCATED else 0
        kept = kept_as(symbol, state)
        if kept is not None:
            found.append(("K", extra, kept))
        found.append(("R", REROLE + extra, FOLLOWING[state]))
    return found


def before(symbol: int, costs: Costs) -> Costs:
    """Costs in front of a symbol from those behind it."""
    return with_inserts(tuple(min(c + costs[q2] for _, c, q2 in choices(symbol, q)) for q in range(4)))


class Tables:
    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.vectors: list[Costs] = [END]
        number = {END: 0}
        following, added = [], []
        for costs in self.vectors:  # grows while it is read: every vector that can come up
            following.append([])
            added.append([])
            for symbol in range(SYMBOLS):
                found = before(symbol, costs)
                least = min(found)
                found = tuple(c - least for c in found)
                if found not in number:
                    number[found] = len(self.vectors)
                    self.vectors.append(found)
                following[-1].append(number[found])
                added[-1].append(int(least))
        self.one_following, self.one_added = np.array(following), np.array(added)
        # (vectors, 9^block): the vector in front of a block and what it adds, by the one behind
        self.following = np.repeat(np.arange(len(self.vectors))[:, None], SYMBOLS**block, axis=1)
        self.added = np.zeros_like(self.following)
        codes = np.arange(SYMBOLS**block)
        for place in reversed(range(block)):
            symbol = codes // SYMBOLS**place % SYMBOLS
            self.added += self.one_added[self.following, symbol]
            self.following = self.one_following[self.following, symbol]
        self.edits = lru_cache(1 << 17)(self._edits)

    def blocks(self, symbols: bytes) -> list[bytes]:
        return [symbols[i : i + self.block] for i in range(0, len(symbols), self.block)]

    def over(self, part: bytes, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors in front of a block and the cost added, for vectors behind it."""
        if len(part) == self.block:
            code = sum(s * SYMBOLS**i for i, s in enumerate(part))
            return self.following[behind, code], self.added[behind, code]
        added = np.zeros_like(behind)
        for symbol in reversed(part):
            added = added + self.one_added[behind, symbol]
            behind = self.one_following[behind, symbol]
        return behind, added

    def _edits(self, part: bytes, behind: int, state: int) -> tuple[str, int]:
        """Letters of the edits of a block, and the state behind it."""
        costs = [self.vectors[behind]]
        for symbol in reversed(part):
            costs.append(before(symbol, costs[-1]))
        costs.reverse()
        letters = []
        for i, symbol in enumerate(part):
            while True:
                now = costs[i][state]
                fitting = {letter: q for letter, c, q in choices(symbol, state) if c + costs[i + 1][q] == now}
                if INSERT + costs[i][FOLLOWING[state]] == now:
                    fitting["I"] = FOLLOWING[state]
                letter = min(fitting)
                letters.append(letter)
                state = fitting[letter]
                if letter != "I":
                    break
        return "".join(letters), state

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost of a whole sequence and the edits, of equal ones the first in ASCII order."""
        parts = self.blocks(symbols)
        behind, cost, at = [], 0, np.array([0])
        for part in reversed(parts):
            behind.append(int(at[0]))
            at, added = self.over(part, at)
            cost += int(added[0])
        audit, state = self.edits_of(parts, behind[::-1], START)
        return cost + int(self.vectors[int(at[0])][START]), audit + ending(state)

    def edits_of(self, parts: list[bytes], behind: list[int], state: int) -> tuple[str, int]:
        letters = []
        for part, vector in zip(parts, behind):
            found, state = self.edits(part, vector, state)
            letters.append(found)
        return "".join(letters), state

    def section(self, symbols: bytes) -> tuple[list[int], list[int], list[int]]:
        """A section of a sequence, for every vector that may stand behind it: the vector in front, the
        cost added, and (four to a vector) the state behind it by the state in front.
        """
        vectors = np.arange(len(self.vectors))
        at, cost = vectors, np.zeros_like(vectors)
        ends = np.tile(np.arange(4), (len(vectors), 1))
        for part in reversed(self.blocks(symbols)):
            exits = np.zeros_like(ends)
            for vector in np.unique(at).tolist():
                exits[at == vector] = [self.edits(part, vector, q)[1] for q in range(4)]
            ends = np.take_along_axis(ends, exits, axis=1)
            at, added = self.over(part, at)
            cost = cost + added
        return at.tolist(), cost.tolist(), ends.ravel().tolist()

    def section_edits(self, symbols: bytes, behind: int, state: int) -> str:
        """Edits of a section from the vector behind it and the state in front."""
        parts, vectors, at = self.blocks(symbols), [], np.array([behind])
        for part in reversed(parts):
            vectors.append(int(at[0]))
            at, _ = self.over(part, at)
        return self.edits_of(parts, vectors[::-1], state)[0]


def ending(state: int) -> str:
    """Turns put in behind the last one."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def lines(roles: list[str], texts: list[str], audit: str, state: int = START) -> list[str]:
    """The repaired turns as role:text, from a state on."""
    found, rows = [], iter(zip(roles, texts))
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = FOLLOWING[state]
        found.append(f"{role if letter == 'K' else ROLES[state]}:{text}")
    return found
