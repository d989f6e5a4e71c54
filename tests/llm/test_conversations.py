import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomscreen.llm import conversations
from loomscreen.llm.queries import ORACLES, QUERIES

from .oracle import oracle, ours

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
FORM = re.compile(r"(s?(ua)+)?")
KIND = "conv_id long, turn long, role string, text string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, audit, lines) of all edit sequences with up to two inserts before each row and at the end."""
    best = None
    inserts = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    name = {"u": "user", "a": "assistant"}
    marks = faults(rows)

    def walk(i, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for c in inserts:
            paid, edits, now = cost + 5 * len(c), audit + "I" * len(c), lines + [f"{name[k]}:" for k in c]
            if i == len(rows):
                if FORM.fullmatch("".join(x[0] for x in now)):
                    found = (paid, edits, now)
                    best = found if best is None else min(best, found)
                continue
            role, text = rows[i]
            walk(i + 1, paid + 2, edits + "D", now)
            if marks[i] in ("", "truncated"):
                extra = 5 if marks[i] else 0
                if role[:1] in ("s", "u", "a"):
                    walk(i + 1, paid + extra, edits + "K", [*now, f"{role}:{text}"])
                for r in ("user", "assistant"):
                    walk(i + 1, paid + extra + 1, edits + "R", [*now, f"{r}:{text}"])

    walk(0, 0, "", [])
    return best


def expected(rows, repair=brute):
    """The contract, row by row, for undamaged (conv, turn, role, text) rows."""
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0], r[1], r[3], r[4]))
        turns, pairs = [r[2] for r in mine if r[2] is not None], [(r[3], r[4]) for r in mine]
        marks = faults(pairs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        cost, audit, lines = repair(pairs)
        out.append((conv, gaps, *(marks.count(k) for k in conversations.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("key", *conversations.STATS, "audit", "repaired_sha256").collect()), key=repr)


def made(seed, n, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for _ in range(rng.randint(1, longest)):
            out.append((conv, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No", "  ", "", "Why?", "Go on! ", None, "a b"])))
    return out


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert ours(QUERIES["op12_conversation_repair"](spark, sf)) == oracle(ORACLES["op12_conversation_repair"], sf)


def test_brute_force(spark):
    rows = made(1, 120, 4)
    assert got(conversations.digests(spark.createDataFrame(rows, KIND))) == expected(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Again."), (1, 3, "assistant", "Yes."), (1, 4, "user", "  ")]
    r = conversations.repair(spark.createDataFrame(rows, KIND)).collect()
    assert len(r) == 1 and (r[0].cost, r[0].audit, r[0].blank, r[0].illegal) == (4, "KDKKD", 1, 1)
    assert [tuple(t) for t in r[0].turns] == [("system", "Be kind."), ("user", "Again."), ("assistant", "Yes.")]


@pytest.mark.parametrize("segment", [1, 2, 5])
def test_long_conversations_by_segments(spark, monkeypatch, segment):
    """Cut anywhere, a conversation is repaired as if it were whole."""
    rows = made(2, 25, 40)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    whole = got(conversations.digests(df))
    monkeypatch.setattr(conversations, "LONG_ROWS", 3)
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", segment)
    assert got(conversations.digests(df)) == whole
    chunks = conversations.repair(df).where("chunk is not null")
    assert chunks.count() > 25 and chunks.groupBy("key").sum("cost").join(conversations.digests(df), "key").where("`sum(cost)` <> cost").count() == 0


def test_one_hot_conversation(spark):
    """A third of all rows in one conversation, much of it one repeated row."""
    rows = [(7, i, ("user", "assistant")[i % 2], "same words" if i % 3 else f"row {i}.") for i in range(4000)] + [(7, 9, "user", "copy.")] * 3000 + [(8 + i // 4, i % 4, ("user", "assistant")[i % 2], f"{i}.") for i in range(9000)]

    def plain(pairs):
        # Dynamic programming over states, with whole audits.
        marks, best = faults(pairs), {0: (0, "", [])}
        for (role, text), mark in zip(pairs, marks, strict=True):
            closed = dict(best)
            for _ in range(2):
                for q, (c, a, o) in list(closed.items()):
                    name, to = conversations.MADE[q]
                    closed[to] = min(closed.get(to, (9**9, "", [])), (c + 5, a + "I", o + [f"{name}:"]))
            new = {}
            for q, (c, a, o) in closed.items():
                options = [(q, 2, "D", [])]
                if mark in ("", "truncated"):
                    name, to = conversations.MADE[q]
                    options.append((to, 1 + 5 * bool(mark), "R", [f"{name}:{text}"]))
                    if q in conversations.FOLLOWS.get(role[:1], ((), 0))[0]:
                        options.append((conversations.FOLLOWS[role[:1]][1], 5 * bool(mark), "K", [f"{role}:{text}"]))
                for to, paid, edit, line in options:
                    new[to] = min(new.get(to, (9**9, "", [])), (c + paid, a + edit, o + line))
            best = new
        ends = [best[q] for q in (0, 3) if q in best] + [(best[2][0] + 5, best[2][1] + "I", best[2][2] + ["assistant:"])] * (2 in best)
        return min(ends)

    small = [r for r in rows if r[0] in (8, 9)]
    assert expected(small, plain) == expected(small)
    found = got(conversations.digests(spark.createDataFrame(rows, KIND).repartition(8)))
    wanted = expected([r for r in rows if r[0] < 40], plain)
    assert [r for r in found if r[0] < 40] == sorted(wanted, key=repr)
    assert len(found) == 1 + 9000 // 4


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two? Three!") for c in (None, *range(40)) for t in (None, 0, 1, 2)]
    df = conversations.damage(spark.createDataFrame(rows, KIND))
    for r in df.collect():
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        assert r.copies == {0: 0, 3: 2}.get(kind, 1)
        assert (r.role == "user") == (kind == 4)
        assert r.text == {1: "", 2: "One Two Three"}.get(kind, "One. Two? Three!")


def test_edges(spark):
    """Null keys, nulls everywhere, very long texts, repeated rows, clashing columns, no rows, and none left."""
    rows = [(None, None, None, None), (None, 1, "user", "x" * 3_000_000 + "."), (2, 5, "user", "A."), (2, 5, "user", "A."), (2, 9, "assistant", "B.")]
    df = spark.createDataFrame([(*r, 1, "z", 2, 3) for r in rows], KIND + ", key long, audit string, n long, chunk int")
    assert got(conversations.digests(df)) == expected(rows)
    assert conversations.digests(df.limit(0)).collect() == []
    gone = conversations.digests(spark.createDataFrame([(3, 1, "user", "A.", 0), (3, 2, "user", "B.", 0)], KIND + ", copies int"), copies="copies").collect()
    assert [tuple(r) for r in gone] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
