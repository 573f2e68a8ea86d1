"""Conversation repair against a search over all edits and a plain dynamic program."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from coursebeacon.llm import conversation_repair, queries
from coursebeacon.llm.repair_tables import Tables

WHITE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}  # who speaks after whom


def every_way(symbols, longest):
    """(cost, letters) of all edits of at most ``longest`` letters that give a proper sequence."""
    for size in range(len(symbols), longest + 1):
        for letters in product("DIKR", repeat=size):
            if size - letters.count("I") != len(symbols):
                continue
            cost, roles, rows = 0, "", iter(symbols)
            for letter in letters:
                symbol = 0 if letter == "I" else next(rows)
                if letter == "D":
                    cost += 3
                    continue
                if symbol == 8:
                    break
                cost += (letter in "IR") * 2 + (letter != "I" and symbol > 3)
                roles += "sua?"[symbol % 4] if letter == "K" else NEXT[roles[-1:]] if roles[-1:] != "?" else "?"
            else:
                rest = roles[1:] if roles[:1] == "s" else roles
                if rest == "ua" * (len(rest) // 2) and (rest or not roles):
                    yield cost, "".join(letters)


def test_tables_against_all_edits():
    draw, tables = random.Random(3), {b: Tables(b) for b in (1, 2, 4)}
    for size in range(6):
        for _ in range(40 if size < 4 else 5):
            symbols = bytes(draw.randrange(9) for _ in range(size))
            best = min(every_way(symbols, size + (4 if size < 4 else 2)))
            assert {t.repair(symbols) for t in tables.values()} == {best}, symbols


def initial(role):
    return role[:1]


def brute(rows):
    """rows of one conversation after damage, in order: the contract read literally, by forward steps."""
    turns = [t for t, _, _ in rows if t is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0}
    out["illegal"] = sum(initial(a[1]) + initial(b[1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    seen, best = set(), {"": (0, "", ())}  # by who spoke last

    def insert(best):
        for _ in range(2):
            for last, (cost, audit, lines) in list(best.items()):
                who = NEXT[last]
                offer = (cost + 2, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[who]))
                if who not in best or offer < best[who]:
                    best[who] = offer
        return best

    for _, role, text in rows:
        said = text.strip(WHITE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            out[fault] += 1
        after = {}

        def offer(last, value):
            if last not in after or value < after[last]:
                after[last] = value

        for last, (cost, audit, lines) in insert(best).items():
            offer(last, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra, who = int(fault == "truncated"), NEXT[last]
            if initial(role) == who or (initial(role) == "s" and last == ""):
                offer(initial(role), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            name = {"u": "user", "a": "assistant"}[who]
            offer(who, (cost + 2 + extra, audit + "R", (*lines, f"{name}:{text}")))
        best = after
    cost, audit, lines = min(v for last, v in insert(best).items() if last in ("", "a"))
    out |= {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out, list(lines)


def by_conversation(rows):
    """Sorted rows of each conversation: turn (nulls first), role, hash of the text."""
    from tests.llm.helpers import xx

    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], xx(r[2]))
    return {conv: sorted(found, key=key) for conv, found in groups.items()}


AWKWARD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hello."),
    (2, 0, "user", "no end"), (2, 0, "user", "no end"), (2, 3, "assistant", " \t"), (2, 4, "tool", "Result."),
    (3, None, "assistant", "First."), (3, None, "assistant", "First."), (3, 5, None, "Who?"), (3, 6, "user", None),
    (None, 0, "user", "No id!"), (None, 1, "assistant", "No id?"), (4, None, None, None), (5, 1, "", "no role"),
    (6, 2, "unknown", "u, but not user."), (6, 3, "Assistant", "A."), (7, 1, "system", "Only a system."),
    (8, 0, "user", "x" * 50000 + "."), (8, 10, "assistant", "é" * 30000), (9, 1, "user", "a\nb."), (9, 2, "assistant", "c\n."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA + ", audit string, section long, conv string")


def compare(spark, rows, **options):
    found = conversation_repair.repair(table(spark, rows).repartition(3), **options)
    got = {r.conv_id: r.asDict() for r in found.collect()}
    for conv, group in by_conversation(rows).items():
        expected, _ = brute(group)
        assert {k: got[conv][k] for k in expected} == expected, (conv, group[:5])
    assert len(got) == len(by_conversation(rows))


@pytest.mark.parametrize("partition_bytes", [1 << 24, 1])
def test_awkward_conversations(spark, partition_bytes):
    compare(spark, AWKWARD, partition_bytes=partition_bytes)


def test_conversations_over_many_partitions(spark):
    draw, rows = random.Random(5), []
    for conv in (None, 1, 2, 3, 4):
        for _ in range(300 if conv in (None, 2) else draw.randrange(60)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, draw.choice([None, *range(40)]), role, draw.choice(["Yes.", "No", "", "Why?", None, f"{draw.random()}!"])))
    rows += [(2, 7, "user", "Same.")] * 200  # equal rows over several partitions
    compare(spark, rows, partition_bytes=400)
    found = conversation_repair.repair(table(spark, rows), with_lines=True, partition_bytes=400).collect()
    lines = {}
    for r in sorted(found, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.section or 0)):
        lines.setdefault(r.conv_id, []).extend(r.lines)
    assert max(len([1 for r in found if r.conv_id == c]) for c in lines) > 3
    assert lines == {conv: brute(group)[1] for conv, group in by_conversation(rows).items()}


def test_many_conversations_in_one_partition(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c}.") for c in range(2500) for t in range(c % 3)]
    found = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA)).groupBy("audit").count().collect()
    assert {r["audit"]: r["count"] for r in found} == {"KI": 833, "KK": 833}


def test_no_rows(spark):
    assert conversation_repair.repair(table(spark, AWKWARD).limit(0)).count() == 0


def damaged(rows):
    for conv, turn, role, text in rows:
        conv_text, turn_text = [" " if x is None else x for x in (conv, turn)]
        role, text = [" " if x is None else x for x in (role, text)]
        kind = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        for _ in range(1 + (kind == 3)):
            yield conv, turn, "user" if kind == 4 else role, text


def test_query(spark, small, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    table(spark, rows + AWKWARD).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r.asDict() for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    groups = by_conversation(damaged(rows + AWKWARD))
    assert found.keys() == {r[0] for r in rows + AWKWARD}
    for conv, row in found.items():
        expected, _ = brute(groups.get(conv, []))
        assert {k: row[k] for k in expected} == expected, conv
    assert brute([])[0] == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                            "repaired_sha256": hashlib.sha256(b"").hexdigest()}
