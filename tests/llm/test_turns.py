"""Conversation repair against a table of best ways, blocks against whole conversations, and odd rows."""

import hashlib
import random

import pytest

from causeway.llm import turns

ROWS = "conv_id string, turn int, role string, text string, place int, cost string"


def best_ways(rows, start=0):
    """Least (cost, edits) to each state right after the last row, and with inserts behind it, state by state."""

    def spread(ways):
        for _ in range(4):
            for q in list(ways):
                onward, cost, edits = turns.LEADS[q][turns.NEXT[q][0]], ways[q][0] + 2, ways[q][1] + "I"
                ways[onward] = min(ways.get(onward, (cost, edits)), (cost, edits))
        return ways

    ways = {start: (0, "")}
    for initial, gone, truncated, copies in rows:
        after, rest = {}, copies - 1
        for q, (cost, edits) in spread(ways).items():
            moves = [(3, "D", q)]
            if not gone:
                moves.append((2 + truncated, "R", turns.LEADS[q][turns.NEXT[q][0]]))
                if initial in turns.LEADS[q]:
                    moves.append((int(truncated), "K", turns.LEADS[q][initial]))
            for c, e, m in moves:
                way = (cost + c + 3 * rest, edits + e + "D" * rest)
                after[m] = min(after.get(m, way), way)
        ways = after
    return ways, spread(dict(ways))


def drawn(rnd, most=14):
    return [(rnd.choice(["u", "u", "a", "a", "s", "x", " ", ""]), rnd.random() < 0.1, rnd.random() < 0.2, rnd.choice([1, 1, 1, 3])) for _ in range(rnd.randint(0, most))]


def test_first_accepted_path_is_cheapest_and_ascii_least():
    rnd = random.Random(4)
    for _ in range(1500):
        rows = drawn(rnd)
        ends = best_ways(rows)[1]
        assert turns.repaired_whole(rows) == min(ends[q] for q in (0, 3) if q in ends)


def test_blocks_between_all_states():
    rnd = random.Random(5)
    for _ in range(600):
        rows = drawn(rnd) or [("u", False, False, 1)]
        found = turns.between_states(rows)
        for q in range(4):
            ends = best_ways(rows, q)[0]
            assert found[4 * q : 4 * q + 4] == [ends.get(m) for m in range(4)]


def brute(rows, conv):
    """The contract's row for one conversation of (turn, role, text) after damage."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, short, count = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            count[fault] += 1
        short.append((role[:1], fault in (0, 1), fault == 2, 1))
    ends = best_ways(short)[1]
    cost, audit = min(ends[q] for q in (0, 3) if q in ends)
    lines, q, at = [], 0, 0
    for e in audit:
        role, text = (turns.NEXT[q], "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e != "D":
            role = turns.NEXT[q] if e == "R" else role
            lines.append(f"{role}:{text}")
            q = turns.LEADS[q][role[0]]
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(short, short[1:]))
    return (conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations():
    rnd = random.Random(6)
    rows = [("long", i, "user" if i % 2 == 0 else "assistant", f"line {i}." if rnd.random() < 0.9 else rnd.choice(["", "line 1.", "open"])) for i in range(400) if rnd.random() < 0.95]
    for c in range(60):
        for t in range(rnd.randint(1, 9)):
            text = rnd.choice(["Yes.", "Yes.", "no", "", " \n", "What?", None, "x" * 3000 + "."])
            rows.append((f"c{c}" if c else None, rnd.choice([t, t, None, t // 2]), rnd.choice(["user", "assistant", "system", "tool", "", None]), text))
    rows += [("same", 1, "user", "Hello.")] * 500
    rows += [("nulls", None, None, None)] * 3
    return rows


def result(spark, rows, originals=None):
    made = spark.createDataFrame([(*r, 0, "clash") for r in rows], ROWS).repartition(4)
    ids = made if originals is None else spark.createDataFrame([(i,) for i in originals], "conv_id string")
    return {r["conv_id"]: tuple(r) for r in turns.audit(ids, made).collect()}


def test_whole_operator_against_brute_force(spark):
    rows = conversations()
    wanted = {}
    for conv in {r[0] for r in rows}:
        wanted[conv] = brute([r[1:] for r in rows if r[0] == conv], conv)
    assert result(spark, rows) == wanted


def test_conversation_without_rows(spark):
    nothing = ("gone", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert result(spark, [("here", 0, "user", "Hi.")], ["here", "gone"])["gone"] == nothing
    assert result(spark, [], ["gone"]) == {"gone": nothing}
    assert result(spark, []) == {}


def test_edits_show_what_rows_become(spark):
    rows = spark.createDataFrame([("c", 0, "assistant", "Hi."), ("c", 1, "assistant", "Well."), ("c", 2, "assistant", "")], "conv_id string, turn int, role string, text string")
    found = [(r["place"], r["edit"], r["role"], r["text"]) for r in turns.edits(rows).orderBy("place").collect()]
    assert found == [(1, "R", "user", "Hi."), (2, "K", "assistant", "Well."), (3, "D", "assistant", "")]


@pytest.mark.parametrize("case, text", [(1, ""), (2, "a b c"), (4, "a. b! c?")])
def test_damage(spark, case, text):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == case)
    row = turns.damage(spark.createDataFrame([(7, turn, "assistant", "a. b! c?")], "conv_id bigint, turn int, role string, text string")).first()
    assert (row["text"], row["role"]) == (text, "user" if case == 4 else "assistant")
