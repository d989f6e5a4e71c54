"""Conversation structure repair: the cheapest edits that give a dialogue its alternating form.

A conversation's rows, in order of turn (nulls first, then role, text), become
``(s?(ua)+)?`` in role initials: an optional system row, then user and assistant
by turns, or nothing.  Keep costs 0, Rerole to user or assistant 1, Delete 2
(required for blank rows and duplicates), Insert of an empty user or assistant
row 5; a truncated row that isn't deleted adds 5.  Of equally cheap repairs the
one whose edits' initials are least in ASCII order is taken.

The repair is found by A* over the edit lattice: a node is a number of rows
passed and the form's state; the heuristic is the suffix sum of the deletions
that are mandatory and of the 2 that a truncated row costs at least (deleted, or
kept for 5); nodes leave the queue by (cost plus heuristic, audit).  The
heuristic never falls by more than an edit costs, so the first path that reaches
a node is the cheapest and least one.

Conversations of up to LONG_ROWS rows and LONG_BYTES bytes are repaired whole,
one at a time, in a task that streams sorted rows.  Longer ones are ranged over
tasks and cut into segments of at most SEGMENT_ROWS rows.  A* gives each
segment's cheapest path between every two states; one pass over these tables of
16 costs chooses the states at the cuts.  A path to a cut ends with an edit of a
row, so two paths of different states never are prefixes of each other, and the
order of their audits is all that later ties need.  Only a long conversation's
segments' costs, then its repaired text for a running hash, pass one task in
order; neither is held there.

Edge cases: null roles and texts count as one space; null turns come first and
take no part in gaps; a null key is a conversation like any other; rows with no
copies only name their conversation, so one that lost every row has zeros and an
empty repair; repeated rows are duplicates; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import arrow
from .storage import columns, stored

#: Beyond either, a conversation is repaired by segments.
LONG_ROWS = 1024
LONG_BYTES = 4 << 20
SEGMENT_ROWS = 256
SEGMENT_BYTES = 1 << 20
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: States from which a row of this initial may follow, and the state after it.
FOLLOWS = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: What may come next by Rerole and Insert, and the state after it.
MADE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAULTS = ("blank", "duplicate", "truncated")
STATS = ("gaps", *FAULTS, "illegal", "cost")
LEGAL = {"su", "ua", "au"}

#: A row's initial and fault: an index into FAULTS, or None.
Row = tuple[str, int | None]


def search(rows: list[Row], entry: int = START, final: bool = True) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) from ``entry`` over all rows, by the state reached.

    With ``final`` only the best path to an accepted end is returned, under START;
    otherwise paths end with the last row's edit, and each state's best is returned.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (0 if rows[i][1] is None else DELETE)
    queue, done, found = [(rest[0], "", 0, entry)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = f - rest[i]
        if i == n:
            if not final:
                found[state] = (cost, audit)
                continue
            if state in (START, ASSISTANT):
                return {START: (cost, audit)}
        made = MADE[state][1]
        if (i, made) not in done:
            heapq.heappush(queue, (f + INSERT, audit + "I", i, made))
        if i == n:
            continue
        initial, fault = rows[i]
        heapq.heappush(queue, (cost + DELETE + rest[i + 1], audit + "D", i + 1, state))
        if fault is None or fault == 2:
            extra = cost + rest[i + 1] + (0 if fault is None else TRUNCATED)
            before, after = FOLLOWS.get(initial, ((), START))
            if state in before:
                heapq.heappush(queue, (extra, audit + "K", i + 1, after))
            heapq.heappush(queue, (extra + REROLE, audit + "R", i + 1, made))
    return found


def apply(rows: list[tuple[str, str]], audit: str, state: int = START) -> tuple[list[dict[str, str]], int]:
    """The repaired (role, text) rows of an audit, and the state after them."""
    out, i = [], 0
    for edit in audit:
        if edit in "IR":
            role, state = MADE[state]
            out.append({"role": role, "text": "" if edit == "I" else rows[i][1]})
        elif edit == "K":
            out.append({"role": rows[i][0], "text": rows[i][1]})
            state = FOLLOWS[rows[i][0][:1]][1]
        i += edit != "I"
    return out, state


def _stats(turns: list[int | None], rows: list[Row]) -> dict[str, int]:
    known = [t for t in turns if t is not None]
    counts = [sum(fault == k for _, fault in rows) for k in range(len(FAULTS))]
    illegal = sum(a[0] + b[0] not in LEGAL for a, b in pairwise(rows))
    return dict(zip(STATS, (max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, illegal), strict=False))


def _checked(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it ends without a stop."""
    end = F.rtrim(text, F.lit(SPACE))
    return end == "", ~F.right(end, F.lit(1)).isin(".", "!", "?")


def _rows(df: DataFrame, key: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    named = {"key": key, "turn": turn, "role": role, "text": text}
    df = columns(df, **named, **({"copies": copies} if copies else {}))
    if not copies:
        df = df.withColumn("copies", F.lit(1))
    df = df.select("key", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    blank, cut = _checked(F.col("text"))
    return df.select("*", blank.alias("blank"), cut.alias("cut"))


def _long_keys(rows: DataFrame) -> DataFrame:
    """The keys of conversations beyond LONG_ROWS or LONG_BYTES, written once; Spark broadcasts them where their file is small."""
    size = F.sum(F.col("copies") * (F.octet_length("text") + 8))
    return stored(rows.groupBy("key").agg(F.sum("copies").alias("n"), size.alias("bytes")).where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("key"), "long-conversations")


def _schema(kind: str) -> str:
    return f"key {kind}, chunk long, " + ", ".join(f"{s} long" for s in STATS) + ", audit string, turns array<struct<role: string, text: string>>"


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _emitted(found: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    """(key, chunk, stats, audit, turns) tuples as a batch."""
    keys, chunks, stats, audits, turns = zip(*found, strict=True)
    arrays = [pa.array(keys, key_type), pa.array(chunks, pa.int64()), *(pa.array([s.get(k, 0) for s in stats], pa.int64()) for k in STATS), pa.array(audits, pa.string()), pa.array(turns, _TURNS)]
    return pa.RecordBatch.from_arrays(arrays, names=["key", "chunk", *STATS, "audit", "turns"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair conversations from sorted rows (key, turn, role, text, copies, blank, cut)."""
    kind: list[pa.DataType] = []

    def noted() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind[:] = [batch.schema.field(0).type]
            yield batch

    out, size = [], 0
    for key, rows in groupby(_streamed(noted()), key=lambda r: r[0]):
        seen, turns, pairs, checked = set(), [], [], []
        for _, turn, role, text, copies, blank, cut in rows:
            for _ in range(copies):
                fault = 0 if blank else 1 if (role, text) in seen else 2 if cut else None
                seen.add((role, text))
                turns.append(turn)
                pairs.append((role, text))
                checked.append((role[:1], fault))
                size += len(text)
        cost, audit = search(checked)[START]
        out.append((key, None, _stats(turns, checked) | {"cost": cost}, audit, apply(pairs, audit)[0]))
        if size > SEGMENT_BYTES or len(out) >= 2000:
            yield _emitted(out, kind[0])
            out, size = [], 0
    if out:
        yield _emitted(out, kind[0])


def _short(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Repairs of all conversations but the long ones, each in one row (``chunk`` is null)."""
    text = F.when(F.col("copies") > 0, F.col("text")).otherwise("").alias("text")
    few = rows.join(long.select(F.col("key").alias("other")), F.col("key").eqNullSafe(F.col("other")), "left_anti")
    ordered = few.select("key", "turn", "role", text, "copies", "blank", "cut").repartition("key").sortWithinPartitions("key", "turn", "role", "text")
    return ordered.transform(arrow(_whole, _schema(rows.schema["key"].dataType.simpleString())))


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows (key, turn, role, text, n, first, blank, cut) of one partition into segments of at most ``most`` rows.

    ``n`` copies stand side by side; ``first`` says that none like them stood earlier.
    A segment has its rows, its counts, and for each of 16 pairs of states the cost
    (-1: no path) and the rank of the path's audit among those of the same entry.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    segment: list[tuple] = []
    number, size, key_type = 0, 0, None

    def flush() -> pa.RecordBatch:
        nonlocal number, size, segment
        checked = [(role[:1], fault) for _, _, role, _, fault in segment]
        costs, ranks = [-1] * 16, [0] * 16
        for entry in STATES:
            found = search(checked, entry, final=False)
            for rank, state in enumerate(sorted(found, key=lambda s: found[s][1])):
                costs[4 * entry + state], ranks[4 * entry + state] = found[state][0], rank
        turns = [s[1] for s in segment]
        known = [t for t in turns if t is not None]
        s = _stats(turns, checked)
        row = {
            "key": segment[0][0], "part": part, "number": number, "low": min(known, default=None), "high": max(known, default=None), "n_turns": len(set(known)),
            "opens": checked[0][0], "closes": checked[-1][0], **{k: s[k] for k in (*FAULTS, "illegal")}, "costs": costs, "ranks": ranks,
            "initials": [c[0] for c in checked], "faults": [c[1] for c in checked], "turns": [{"role": r[2], "text": r[3]} for r in segment],
        }
        number, size, segment = number + 1, 0, []
        return pa.RecordBatch.from_pylist([row], _segment_type(key_type))

    for batch in batches:
        key_type = batch.schema.field(0).type
        for key, turn, role, text, n, first, blank, cut in _streamed([batch]):
            for copy in range(n):
                if segment and (segment[0][0] != key or len(segment) >= most or size > SEGMENT_BYTES):
                    yield flush()
                fault = 0 if blank else 1 if copy or not first else 2 if cut else None
                segment.append((key, turn, role, text, fault))
                size += len(text)
    if segment:
        yield flush()


def _segment_type(key_type: pa.DataType) -> pa.Schema:
    ints = lambda *names: [(n, pa.int64()) for n in names]
    return pa.schema([("key", key_type), *ints("part", "number", "low", "high", "n_turns"), ("opens", pa.string()), ("closes", pa.string()), *ints(*FAULTS, "illegal"), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())), ("faults", pa.list_(pa.int64())), ("turns", _TURNS)])


def _segment_schema(kind: str) -> str:
    return f"key {kind}, part long, number long, low long, high long, n_turns long, opens string, closes string, {', '.join(f'{s} long' for s in (*FAULTS, 'illegal'))}, costs array<long>, ranks array<long>, initials array<string>, faults array<long>, turns array<struct<role: string, text: string>>"


def _joined(segments: Iterator[dict]) -> Iterator[tuple]:
    """Choose the states at the cuts of one conversation: (part, number, chunk, entry, exit, inserted at the end, stats) of each segment."""
    cost, rank = [0, None, None, None], [0, 0, 0, 0]
    back, parts, numbers = bytearray(), array("q"), array("q")
    stats = dict.fromkeys(STATS, 0)
    low = high = closes = last_turn = None
    n_turns = 0
    for s in segments:
        new: list[tuple[int, int, int, int] | None] = [None] * 4
        for entry in STATES:
            if cost[entry] is None:
                continue
            for state in STATES:
                step = s["costs"][4 * entry + state]
                if step >= 0:
                    candidate = (cost[entry] + step, rank[entry], s["ranks"][4 * entry + state], entry)
                    if new[state] is None or candidate < new[state]:
                        new[state] = candidate
        # Audits are ordered by that of the entry, then by that of the segment.
        order = sorted((c[1], c[2], state) for state, c in enumerate(new) if c)
        cost, rank = [c[0] if c else None for c in new], [0] * 4
        for k, (_, _, state) in enumerate(order):
            rank[state] = k
        back.append(sum((c[3] if c else 0) << 2 * state for state, c in enumerate(new)))
        parts.append(s["part"])
        numbers.append(s["number"])
        for k in (*FAULTS, "illegal"):
            stats[k] += s[k]
        stats["illegal"] += closes is not None and closes + s["opens"] not in LEGAL
        closes = s["closes"]
        if s["low"] is not None:
            n_turns += s["n_turns"] - (s["low"] == last_turn)
            low, high = s["low"] if low is None else low, s["high"]
            last_turn = high
    ends = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    state = min((s for s in STATES if cost[s] is not None), key=lambda s: (cost[s] + INSERT * ends[s], rank[s]))
    stats["cost"] = cost[state] + INSERT * ends[state]
    stats["gaps"] = 0 if low is None else high - low + 1 - n_turns
    inserted = ends[state]
    for k in range(len(back) - 1, -1, -1):
        entry = back[k] >> 2 * state & 3
        yield parts[k], numbers[k], k, entry, state, inserted, stats if k == 0 else {}
        state, inserted = entry, 0


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: list[str] = []

    def rows() -> Iterator[dict]:
        for batch in batches:
            names[:] = batch.schema.names
            yield from batch.to_pylist()

    kinds = [("part", "number", "chunk", "entry", "exit", "inserted", *STATS)]
    for _, segments in groupby(rows(), key=lambda r: r["key"]):
        out = []
        for *place, stats in _joined(segments):
            out.append((*place, *(stats.get(k, 0) for k in STATS)))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=list(kinds[0]))
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=list(kinds[0]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repair segments between their chosen states."""
    for batch in batches:
        for r in batch.to_pylist():
            rows = list(zip(r["initials"], r["faults"], strict=True))
            audit = search(rows, r["entry"], final=False)[r["exit"]][1] + "I" * r["inserted"]
            turns, _ = apply([(t["role"], t["text"]) for t in r["turns"]], audit, r["entry"])
            yield _emitted([(r["key"], r["chunk"], r, audit, turns)], batch.schema.field("key").type)


def _long(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Repairs of the long conversations, a row a segment: ``chunk`` counts from 0, whose row has the counts and the cost."""
    spark, kind = rows.sparkSession, rows.schema["key"].dataType.simpleString()
    many = rows.where("copies > 0").join(long.select(F.col("key").alias("other")), F.col("key").eqNullSafe(F.col("other")), "left_semi")
    digest = F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256)
    # Equal rows of a turn become one; then (key, turn, digest) is unique on both sides, so no key is hot.
    ones = many.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")).withColumn("digest", digest)
    earliest = F.when(F.count("turn") == F.count(F.lit(1)), F.min("turn")).alias("turn0")
    firsts = many.groupBy(F.col("key").alias("key0"), digest.alias("digest0")).agg(earliest)
    same = F.col("key").eqNullSafe(F.col("key0")) & F.col("turn").eqNullSafe(F.col("turn0")) & (F.col("digest") == F.col("digest0"))
    marked = ones.join(firsts, same, "left").select("key", "turn", "role", "text", "n", F.col("digest0").isNotNull().alias("first"), "blank", "cut")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = marked.repartitionByRange(parts, "key", "turn", "role", "text").sortWithinPartitions("key", "turn", "role", "text")
    segments = stored(ranged.transform(arrow(partial(_segments, most=SEGMENT_ROWS), _segment_schema(kind))), "conversation-segments")
    costs = segments.drop("initials", "faults", "turns").repartition("key").sortWithinPartitions("key", "part", "number")
    chosen = costs.transform(arrow(_chosen, ", ".join(f"{c} long" for c in ("part", "number", "chunk", "entry", "exit", "inserted", *STATS))))
    return segments.select("key", "part", "number", "initials", "faults", "turns").join(chosen, ["part", "number"]).transform(arrow(_edited, _schema(kind)))


def repair(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """Repaired conversations: ``key``, ``chunk``, the counts, ``cost``, ``audit`` and the repaired ``turns``.

    ``copies`` names a column that says how often a row stands (0: not at all).
    Long conversations have a row for each of their chunks, in their order.
    """
    rows = _rows(df, key, turn, role, text, copies)
    long = _long_keys(rows)
    out = _short(rows, long)
    return out if long.isEmpty() else out.unionByName(_long(rows, long))


def _lines(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its sorted chunks (key, chunk, stats, audit, lines); lines is null for a chunk without rows."""
    kind = None

    def rows() -> Iterator[tuple]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield from _streamed([batch])

    for key, chunks in groupby(rows(), key=lambda r: r[0]):
        sha, audit, sums, begun = hashlib.sha256(), [], [0] * len(STATS), False
        for _, _, *stats, part, lines in chunks:
            sums = [a + b for a, b in zip(sums, stats, strict=True)]
            audit.append(part)
            if lines is not None:
                sha.update((b"\n" if begun else b"") + lines.encode())
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), *(pa.array([s], pa.int64()) for s in sums), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=["key", *STATS, "audit", "repaired_sha256"])


def digests(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """One row a conversation: ``key``, the counts, ``cost``, ``audit`` and the hash of the repaired ``role:text`` lines."""
    rows = _rows(df, key, turn, role, text, copies)
    long = _long_keys(rows)
    out = _short(rows, long).select("key", *STATS, "audit", F.sha2(_lines(F.col("turns")), 256).alias("repaired_sha256"))
    if long.isEmpty():
        return out
    lines = F.when(F.size("turns") > 0, _lines(F.col("turns"))).alias("lines")
    chunks = _long(rows, long).select("key", "chunk", *STATS, "audit", lines).repartition("key").sortWithinPartitions("key", "chunk")
    kind = rows.schema["key"].dataType.simpleString()
    return out.unionByName(chunks.transform(arrow(_hashed, f"key {kind}, " + ", ".join(f"{s} long" for s in STATS) + ", audit string, repaired_sha256 string")))


def damage(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as a hash of their key and turn damages them: dropped (no copies), emptied, without stops, repeated, or of the user."""
    space = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(key), F.lit(":"), space(turn))) % 20
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    return df.select(df[key], df[turn], F.when(kind == 4, "user").otherwise(space(role)).alias(role), changed.alias(text), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
