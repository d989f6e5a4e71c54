"""Near-duplicate join by chosen paths over word shingles.

A text's set is its distinct runs of SHINGLE words (all its words as one run if
it has fewer).  Texts whose sets have a Jaccard similarity of THRESHOLD or more
are linked.  Equal texts are one class, joined by one representative.

Chosen paths.  A set is sketched by SLOTS tokens, each the least under an order
of its own, so two sets share a slot's token with a chance of their similarity.
Each of RUNS repeats starts at one slot's token and samples further slots, 1 /
THRESHOLD of them a level on average, chosen by a hash of the path so far; sets
that share the sampled token stay together.  So paths of a linked pair survive
a level with a chance that keeps one alive on average, those of others die out.
Buckets of more than SPLIT sets are split again, down to MAX_DEPTH at most, and
no further if a split leaves over half of a bucket together: its sets are alike.
Buckets of SPLIT sets at most are brute-forced at once, larger ones that don't
fall apart in tiles of at most TILE x TILE.  A pair at the threshold shares a
bucket of depth 2 with a chance of survival(2) = 0.5 a run, of depth 3 and 4 with
0.375 and 0.3; runs are repeated until a pair is missed at depth 2 with a chance
under MISSED (3e-7 at depth 3, 1e-5 at depth 4, for 32 runs).

Each pair is compared once, in the least of the buckets that it shares, first
by the sketch (half the slots must agree, which a linked pair fails with a
chance under 1e-7), then exactly by the shingles' 64-bit hashes.  Tiles return
a count of links and a local component for each set, never pairs, so a large
group of copies costs rows in proportion to its size; components are joined
over all tiles by alternating stars.

Edge cases: null or empty texts, and those of white space alone, have no
shingles and link to nothing; repeated rows are members of one class; a null
key is allowed, but can't stand for a group that has any other; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .batches import arrow, texts
from .storage import stored
from .wordhash import Words, mix, runs, stretches

SHINGLE = 5
THRESHOLD = 0.8
SLOTS = 64
DEPTH, MAX_DEPTH = 2, 4
SPLIT = 512
TILE = 512
MISSED = 2e-10
_U32 = np.uint32


def survival(depth: int) -> float:
    """The chance that a pair at the threshold shares a path of a run down to ``depth``: 1 / THRESHOLD slots are sampled a level, so one shared child is expected."""
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - (1 - alive / SLOTS) ** SLOTS
    return THRESHOLD * alive


#: Repeats until the target recall.
RUNS = math.ceil(math.log(MISSED) / math.log(1 - survival(DEPTH)))
_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(1 << 31, 1 << 32, SLOTS, dtype=np.uint64) | np.uint64(1)).astype(_U32)
_ADD = _rng.integers(0, 1 << 32, SLOTS, dtype=np.uint64).astype(_U32)
_SAMPLED = np.uint64(int((1 << 64) / (THRESHOLD * SLOTS)))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The owner and hash of every run of SHINGLE words, repeats included."""
    h = words.hashes()
    places, found = runs(h, words.first, SHINGLE)
    owner = words.owner()[places]
    few = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(few):
        short = stretches(h, words.first[few], words.first[few + 1])
        owner, found = np.concatenate([owner, few]), np.concatenate([found, short])
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
    return owner, found


def sketches(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their sketches (texts, SLOTS)."""
    owner, tokens = shingles(Words(found))
    if not len(owner):
        return np.zeros(0, dtype=np.int64), np.zeros((0, SLOTS), dtype=_U32)
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    small = (tokens >> np.uint64(32)).astype(_U32)
    out = np.empty((len(begins), SLOTS), dtype=_U32)
    for i in range(SLOTS):
        out[:, i] = np.minimum.reduceat(small * _MULTIPLY[i] + _ADD[i], begins)
    return owner[begins], out


def children(paths: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each path, of the set with that sketch: which paths go on, and to which keys."""
    with np.errstate(over="ignore"):
        chance = mix(paths[:, None] + np.arange(1, SLOTS + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15))
        at, slot = np.nonzero(chance < _SAMPLED)
        return at, mix(chance[at, slot] + sketch[at, slot].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def leaves(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owner and key of every path of DEPTH."""
    n = len(sketch)
    start = (np.arange(RUNS) * 37) % SLOTS
    with np.errstate(over="ignore"):
        keys = mix((np.arange(RUNS, dtype=np.uint64) << np.uint64(33))[None] + sketch[:, start].astype(np.uint64)).reshape(-1)
    owner = np.repeat(np.arange(n), RUNS)
    for _ in range(DEPTH - 1):
        at, new = children(keys, sketch[owner])
        owner, keys = owner[at], new
    return owner, keys


def class_key(text: Column) -> list[Column]:
    """128 bits of hash of a text."""
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2")]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, found in texts(batches, 3):
        has, sketch = sketches(found)
        blobs: list[bytes | None] = [None] * len(found)
        for i, row in zip(has.tolist(), sketch, strict=True):
            blobs[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(blobs, pa.binary())], names=["doc_id", "c1", "c2", "sketch"])


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=_U32).reshape(-1, SLOTS)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c1, c2, sketch) to (key, parent, c1, c2)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            owner, keys = leaves(_matrix(part.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64()), part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner))], names=["key", "parent", "c1", "c2"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, total, c1, c2, sketch) to the next level's keys, with the size of the bucket that they split."""
    for batch in batches:
        at, keys = children(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(4)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(i).take(pa.array(at)) for i in (1, 2, 3))], names=["key", "parent", "c1", "c2"])


_PATH = "key long, parent long, c1 long, c2 long"


def _shared(paths: DataFrame, name: str) -> DataFrame:
    """The paths whose key two sets have at least, with their number."""
    counts = paths.groupBy("key").agg(F.count("*").alias("total"), F.max("parent").alias("split")).where("total > 1")
    together = (F.col("total") > SPLIT) & (F.col("split").isNull() | (F.col("total") * 2 <= F.col("split")))
    return stored(paths.drop("parent").join(counts.select("key", "total", together.alias("open")).hint("merge"), "key"), name)


def buckets(reps: DataFrame) -> DataFrame:
    """key, c1, c2, total: the final buckets of all sets that share one."""
    level = _shared(reps.select("c1", "c2", "sketch").transform(arrow(_paths, _PATH)), "paths")
    done = []
    for _ in range(DEPTH, MAX_DEPTH):
        large = level.where("open")
        if large.isEmpty():
            break
        done.append(level.where("not open"))
        rows = large.select("key", "total", "c1", "c2").join(reps.select("c1", "c2", "sketch"), ["c1", "c2"]).select("key", "total", "c1", "c2", "sketch")
        level = _shared(rows.transform(arrow(_deeper, _PATH)), "deeper")
    return _union([*done, level]).drop("open")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tiled(rows: DataFrame) -> DataFrame:
    """Each set of a bucket, once for each tile that it takes part in: i and j are the tile's blocks, mine the set's."""
    n = F.ceil(F.col("total") / F.lit(TILE)).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("mine", F.pmod(F.xxhash64("c1", "c2", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("tile", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("int")).drop("blocks", "other")


class Group:
    """The sets of one tile: which pairs are to be compared here."""

    def __init__(self, table: pa.Table):
        self.table, self.n = table, table.num_rows
        self.key = table.column("key")[0].as_py()
        self.mine = table.column("mine").to_numpy()

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share no lesser key and whose sketches agree in half the slots."""
        if self.n == 2:
            a, b = np.array([0]), np.array([1])
        else:
            a, b = np.triu_indices(self.n, 1)
        if len(np.unique(self.mine)) > 1:
            keep = self.mine[a] != self.mine[b]
            a, b = a[keep], b[keep]
        if not len(a):
            return a, b
        lists = self.table.column("keys").combine_chunks()
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        owner = np.repeat(np.arange(self.n), np.diff(ends))
        values = values[ends[0] : ends[-1]]
        less = values < self.key
        found, code, times = np.unique(values[less], return_inverse=True, return_counts=True)
        often = times > 1
        if often.any():
            place = np.cumsum(often) - 1
            keep = often[code]
            has = np.zeros((self.n, int(often.sum())), dtype=np.float32)
            has[owner[less][keep], place[code[keep]]] = 1
            if len(a) * has.shape[1] < 1 << 22:
                earlier = (has[a] * has[b]).any(axis=1)
            else:
                earlier = (has @ has.T)[a, b] > 0
            a, b = a[~earlier], b[~earlier]
        sketch = _matrix(self.table.column("sketch"))
        keep = np.concatenate([(sketch[a[i : i + 65536]] == sketch[b[i : i + 65536]]).sum(axis=1) >= SLOTS // 2 for i in range(0, len(a), 65536)] or [np.zeros(0, dtype=bool)])
        return a[keep], b[keep]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (key, tile) after another, from batches sorted by both."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        begins = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0)) + 1])
        ends = np.append(begins[1:], batch.num_rows)
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if waiting and last != (key[a], tile[a]):
                yield pa.Table.from_batches(waiting)
                waiting = []
            last = (key[a], tile[a])
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets that have a pair to compare in a tile."""
    out: list[pa.Table] = []
    for table in _groups(batches):
        if table.num_rows > 1:
            a, b = Group(table).pairs()
            if len(a):
                out.append(table.take(pa.array(np.unique(np.concatenate([a, b])))))
        if sum(t.num_rows for t in out) >= 2 * TILE or len(out) >= 256:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out = []
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of sets a and b (sorted arrays of distinct values)."""
    n, total = len(sets), sum(map(len, sets))
    if len(a) * (total / n) < 200_000 or n < 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    place = np.cumsum(often) - 1
    keep = often[code]
    owner, code, width = owner[keep], place[code[keep]], int(often.sum())
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    both = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, width, 4096):
        i, j = np.searchsorted(code, [lo, lo + 4096])
        has = np.zeros((n, min(4096, width - lo)), dtype=np.float32)
        has[owner[i:j], code[i:j] - lo] = 1
        both += has @ has.T
    return both[a, b].astype(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _sets(table: pa.Table) -> list[np.ndarray]:
    """The distinct shingles of each row's text, worked out for about PART_BYTES of text at a time."""
    out: list[np.ndarray] = []
    for _, found in texts(table.select(["text"]).combine_chunks().to_batches(), 0):
        owner, tokens = shingles(Words(found))
        cut = np.searchsorted(owner, np.arange(len(found) + 1))
        out += [np.unique(tokens[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


_LINKS = "c1 long, c2 long, links long, r1 long, r2 long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set with links in a tile: their number (copies counted) and the least set of its local component."""
    for table in _groups(batches):
        group = Group(table)
        a, b = group.pairs()
        if not len(a):
            continue
        sets = _sets(table)
        size = np.array([len(s) for s in sets])
        both = overlaps(sets, a, b)
        # both / union >= THRESHOLD, in whole numbers.
        keep = both * 1000 >= round(THRESHOLD * 1000) * (size[a] + size[b] - both)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        copies = table.column("copies").to_numpy()
        links = np.bincount(a, copies[b], group.n) + np.bincount(b, copies[a], group.n)
        c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
        order = np.lexsort((c2, c1))
        rank = np.empty(group.n, dtype=np.int64)
        rank[order] = np.arange(group.n)
        root = order[components(group.n, rank[a], rank[b])][rank]
        some = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(c1[some]), pa.array(c2[some]), pa.array(links[some].astype(np.int64)), pa.array(c1[root[some]]), pa.array(c2[root[some]])], names=["c1", "c2", "links", "r1", "r2"])


def _starred(edges: DataFrame) -> bool:
    """Whether every node has one edge only, to a node that has none itself."""
    roots = edges.select(F.col("b").alias("a")).distinct().withColumn("is_root", F.lit(True))
    nodes = edges.groupBy("a").agg(F.count("*").alias("n")).join(roots, "a", "left")
    return nodes.agg(F.count_if((F.col("n") > 1) | F.col("is_root").isNotNull())).first()[0] == 0


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and root (the least node of its component) for edges of structs a, b; alternating large and small stars."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most):
        if _starred(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        for small in (False, True):
            both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
            moved = both.join(least, "a").where("b <> m" if small else "b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            if small:
                moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
            edges = stored(moved.where("a <> b").distinct(), "edges")
    raise RuntimeError(f"components didn't settle in {most} rounds")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id and n_links of every row.

    n_links counts the other rows whose texts are linked with the row's (copies
    included); class_id is the least key of all rows that links connect.
    """
    signed, info = _solve(df, id_col, text_col)
    rows = signed.select("doc_id", "c1", "c2").join(info.hint("merge"), ["c1", "c2"], "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each group that links connect, and of every row without shingles.

    The row has the least key, then the least hash of the text; of repeated
    rows one stays.
    """
    signed, info = _solve(df, id_col, text_col)
    firsts = info.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "c1", "c2")).alias("x"))
    chosen = firsts.select(F.col("x.least").alias("_k"), F.col("x.c1").alias("_1"), F.col("x.c2").alias("_2"))
    bare = signed.where("sketch is null").select(F.xxhash64("doc_id").alias("_h"), F.col("c1").alias("_1"), F.col("c2").alias("_2")).distinct()
    keys = stored(chosen.select(F.xxhash64("_k").alias("_h"), "_1", "_2", F.lit(True).alias("_once")).unionByName(bare.withColumn("_once", F.lit(False))), "survivors")
    keyed = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.xxhash64(df[id_col]).alias("_h"), *(c.alias(f"_{i + 1}") for i, c in enumerate(class_key(df[text_col]))))
    # The rows are shuffled once: the numbering of repeated rows keeps the join's partitions.
    kept = keyed.join(keys.hint("merge"), ["_h", "_1", "_2"]).withColumn("_n", F.row_number().over(Window.partitionBy("_h", "_1", "_2").orderBy("_once")))
    return kept.where(~F.col("_once") | (F.col("_n") == 1)).select("row.*")


def _solve(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, c1, c2, sketch) and, for each class: c1, c2, least, root, class_id, n_links."""
    docs = df.select(df[id_col].alias("doc_id"), *class_key(df[text_col]), df[text_col].alias("text"))
    signed = stored(docs.transform(arrow(_sign, f"doc_id {df.schema[id_col].dataType.simpleString()}, c1 long, c2 long, sketch binary")), "signed")
    reps = stored(signed.where("sketch is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("sketch").alias("sketch")), "classes")
    found = buckets(reps)
    keys = found.groupBy("c1", "c2").agg(F.collect_list("key").alias("keys"))
    known = stored(reps.select("c1", "c2", "sketch", "copies").join(keys, ["c1", "c2"]), "known")
    full = tiled(found).join(known.hint("merge"), ["c1", "c2"]).select("key", "tile", "mine", "c1", "c2", "keys", "sketch", "copies")
    schema = "key long, tile int, mine int, c1 long, c2 long, keys array<long>, sketch binary, copies long"
    wanted = stored(full.repartition("key", "tile").sortWithinPartitions("key", "tile").transform(arrow(_wanted, schema)), "wanted")
    needed = stored(wanted.select("c1", "c2").distinct(), "needed")
    # Copies collapse before the shuffle; all joins of rows are by shuffles at every size.
    bodies = docs.where("text is not null").groupBy("c1", "c2").agg(F.first("text").alias("text"))
    bodies = stored(bodies.join(needed.hint("merge"), ["c1", "c2"], "left_semi"), "bodies")
    links = stored(wanted.join(bodies.hint("merge"), ["c1", "c2"]).select("key", "tile", "mine", "c1", "c2", "keys", "sketch", "copies", "text").repartition("key", "tile").sortWithinPartitions("key", "tile").transform(arrow(_verify, _LINKS)), "links")
    counted = links.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    node, root = (F.struct(F.col(x).alias("c1"), F.col(y).alias("c2")) for x, y in (("c1", "c2"), ("r1", "r2")))
    roots = connected(links.select(node.alias("a"), root.alias("b"))).select("node.c1", "node.c2", "root")
    classes = reps.select("c1", "c2", "least", "copies").join(roots, ["c1", "c2"], "left").withColumn("root", F.coalesce("root", F.struct("c1", "c2")))
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    info = stored(classes.join(least, "root").join(counted, ["c1", "c2"], "left").select("c1", "c2", "least", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "info")
    return signed, info
