"""Hierarchical clustering of a long distance matrix.

Average and single linkage let all pairs of clusters that are each other's
nearest merge at once: no later merge comes between them.  A round does so with
three aggregations over the pairs left; once SMALL clusters are left, their
matrix, of a bounded size, is finished in one task.  Only counts come to the
driver.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import settled
from . import running

#: Clusters whose matrix one task finishes, and leaves whose order it optimises.
SMALL = 1024


def linkage(d: np.ndarray, method: str = "average", sizes: np.ndarray | None = None) -> np.ndarray:
    """Merges (left, right, distance, size) by rising distance; average or single linkage, by chains of nearest neighbours.

    ``sizes`` are those of the clusters that the rows stand for, 1 without it.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    weight = np.ones(n) if sizes is None else sizes.astype(float)
    size, live = weight.copy(), np.ones(n, dtype=bool)
    chain: list[int] = []
    merges = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            at = chain[-1]
            row = np.where(live, d[at], np.inf)
            row[at] = np.inf
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        merges.append((a, b, d[a, b]))
        new = np.minimum(d[a], d[b]) if method == "single" else (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        live[b], size[a] = False, size[a] + size[b]
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
    order = sorted(range(n - 1), key=lambda i: (merges[i][2], i))
    root, out, count = {i: i for i in range(n)}, np.zeros((n - 1, 4)), dict(enumerate(weight))
    for k, i in enumerate(order):
        a, b, h = merges[i]
        x, y = sorted((root[a], root[b]))
        count[n + k] = count[x] + count[y]
        out[k] = x, y, h, count[n + k]
        # b lives on in a; every later merge names a.
        root[a] = root[b] = n + k
    return out


def leaves(z: np.ndarray) -> list[int]:
    """The leaves from left to right."""
    n = len(z) + 1
    if n == 1:
        return [0]
    out, stack = [], [2 * n - 2]
    while stack:
        i = stack.pop()
        if i < n:
            out.append(i)
        else:
            stack += [int(z[i - n, 1]), int(z[i - n, 0])]
    return out


def _least_sums(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row u of ``left`` and column w of ``right`` the m of the least left[u, m] + right[m, w], and that sum."""
    place, least = np.empty((len(left), right.shape[1]), dtype=np.int32), np.empty((len(left), right.shape[1]))
    for u, row in enumerate(left):
        sums = row[:, None] + right
        place[u] = sums.argmin(axis=0)
        least[u] = sums[place[u], np.arange(right.shape[1])]
    return place, least


def optimal_leaves(z: np.ndarray, d: np.ndarray) -> list[int]:
    """The order of leaves, among the tree's flips, with the least sum of distances between neighbours (exact dynamic program)."""
    n = len(z) + 1
    if n == 1:
        return [0]
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    cost: dict[int, np.ndarray] = {i: np.zeros((1, 1)) for i in range(n)}
    choice: dict[int, tuple] = {}
    for k in range(n - 1):
        a, b = int(z[k, 0]), int(z[k, 1])
        ma, mb = members[a], members[b]
        gap = d[np.ix_(ma, mb)]
        # best[u, w]: left end u of a, then across to w, the near end in b.
        via, best = _least_sums(cost[a], gap)
        far, ab = _least_sums(best, cost[b])
        size = len(ma) + len(mb)
        c = np.full((size, size), np.inf)
        c[: len(ma), len(ma) :] = ab
        c[len(ma) :, : len(ma)] = ab.T
        members[n + k], cost[n + k], choice[n + k] = ma + mb, c, (a, b, via, far)

    def walk(node: int, u: int, v: int) -> list[int]:
        """Leaves of ``node`` from its u-th to its v-th member."""
        out: list[int] = []
        stack: list = [(node, u, v, False)]
        while stack:
            node, u, v, turned = stack.pop()
            if node < n:
                out.append(node)
                continue
            a, b, via, far = choice[node]
            na = len(members[a])
            if u >= na:
                u, v, turned = v, u, not turned
            w = int(far[u, v - na])
            m = int(via[u, w])
            left, right = (a, u, m, turned), (b, w, v - na, turned)
            if turned:
                # Read from right to left: the right part first, each reversed.
                stack += [(a, m, u, False), (b, v - na, w, False)]
            else:
                stack += [right, left]
        return out

    root = 2 * n - 2
    c = cost[root]
    u, v = np.unravel_index(c.argmin(), c.shape)
    return walk(root, int(u), int(v))


def _pairs(distances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered labels (c from 0, in the labels' order), and all pairs (a < b, d) of them: the mean of both directions, 1 where neither is known."""
    labels = settled(running.numbered(distances.select(F.col("i").alias("label")).distinct(), "label", "c").select((F.col("c") - 1).alias("c"), "label"), "labels")
    one = distances.where("i <> j").select(F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.when(~F.isnan("v"), F.col("v")).alias("v"))
    mean = one.groupBy("x", "y").agg(F.avg(F.coalesce("v", F.lit(1.0))).alias("d"))
    left, right = labels.select(F.col("c").alias("a"), F.col("label").alias("x")), labels.select(F.col("c").alias("b"), F.col("label").alias("y"))
    found = settled(mean.join(left, "x").join(right, "y").select("a", "b", F.lit(1.0).alias("sa"), F.lit(1.0).alias("sb"), "d"), "pairs")
    n = labels.count()
    if found.count() < n * (n - 1) // 2:
        # As many rows as the matrix has cells.
        every = labels.select(F.col("c").alias("a")).join(labels.select(F.col("c").alias("b")), F.col("a") < F.col("b"))
        one = F.lit(1.0)
        found = settled(every.join(found, ["a", "b"], "left").select("a", "b", one.alias("sa"), one.alias("sb"), F.coalesce("d", one).alias("d")), "pairs")
    return labels, found


def _round(pairs: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
    """The merges of all pairs of clusters that are each other's nearest, and the pairs of the clusters after it."""
    edge = F.struct("d", "a", "b").alias("e")
    nearest = pairs.select(F.col("a").alias("x"), edge).unionByName(pairs.select(F.col("b").alias("x"), edge)).groupBy("x").agg(F.min("e").alias("e"))
    mutual = nearest.groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.a", "e.b")
    merges = settled(pairs.join(mutual, ["a", "b"]).select(F.col("a").alias("kept"), F.col("b").alias("gone"), F.col("d").alias("distance"), (F.col("sa") + F.col("sb")).alias("size")), "merges")
    names = merges.select("kept", "size", F.explode(F.array("kept", "gone")).alias("old"))
    side = lambda c: names.select(F.col("old").alias(c), F.col("kept").alias(f"{c}_new"), F.col("size").alias(f"s{c}_new"))
    moved = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    ends = [F.struct(F.coalesce(f"{c}_new", c).alias("c"), F.coalesce(f"s{c}_new", f"s{c}").alias("s")) for c in "ab"]
    moved = moved.select(F.least(*ends).alias("p"), F.greatest(*ends).alias("q"), (F.col("sa") * F.col("sb")).alias("w"), "d").where("p.c <> q.c")
    new = F.min("d") if method == "single" else F.sum(F.col("w") * F.col("d")) / F.sum("w")
    after = moved.groupBy("p", "q").agg(new.alias("d")).select(F.col("p.c").alias("a"), F.col("q.c").alias("b"), F.col("p.s").alias("sa"), F.col("q.s").alias("sb"), "d")
    return merges, settled(after, "pairs")


def _finished(pairs: DataFrame, method: str, first: int) -> DataFrame:
    """The merges of at most SMALL clusters, in one task: kept, gone, distance, size and their order."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([part["a"], part["b"]]))
        n, a, b = len(ids), np.searchsorted(ids, part["a"]), np.searchsorted(ids, part["b"])
        d, sizes = np.ones((n, n)), np.ones(n)
        d[a, b] = d[b, a] = part["d"]
        np.fill_diagonal(d, 0)
        sizes[a], sizes[b] = part["sa"], part["sb"]
        z = linkage(d, method, sizes)
        kept = list(range(n))
        rows = []
        for k, (x, y, h, s) in enumerate(z):
            p, q = sorted((kept[int(x)], kept[int(y)]))
            kept.append(p)
            rows.append((ids[p], ids[q], h, s, first + k))
        return pd.DataFrame(rows, columns=["kept", "gone", "distance", "size", "turn"])

    return pairs.groupBy().applyInPandas(run, "kept long, gone long, distance double, size double, turn long")


def _tree(merges: DataFrame, n: int) -> DataFrame:
    """step, left, right, distance, size: nodes are leaves 0 .. n - 1, then n + step."""
    # A cluster's later merges are never at a lesser distance; rounding hides what sums differ by.
    steps = running.numbered(merges.withColumn("_order", F.struct(F.round("distance", 12), "turn", "kept")), "_order", "step").withColumn("step", F.col("step") - 1).drop("_order")
    steps = settled(steps, "steps")
    before = F.lag("step").over(Window.partitionBy("kept").orderBy("step"))
    last = steps.groupBy(F.col("kept").alias("gone")).agg(F.max("step").alias("last"))
    x, y = F.coalesce(F.lit(n) + F.col("before"), F.col("kept")), F.coalesce(F.lit(n) + F.col("last"), F.col("gone"))
    out = steps.withColumn("before", before).join(last, "gone", "left")
    return settled(out.select(F.col("step").cast("int"), F.least(x, y).cast("int").alias("left"), F.greatest(x, y).cast("int").alias("right"), "distance", F.col("size").cast("int")), "tree")


def _places(tree: DataFrame, n: int) -> DataFrame:
    """Each leaf's place (c, position) from left to right.

    A node begins where its parent begins, a right one after the left one's
    leaves.  Every round doubles the stretch of ancestors that is added up.
    """
    of_left = tree.select((F.col("step") + n).alias("left"), F.col("size").alias("n_left"))
    joined = tree.join(of_left, "left", "left")
    parent = F.col("step") + n
    up = joined.select(F.explode(F.array(F.struct(F.col("left").alias("node"), F.lit(0).cast("long").alias("add")), F.struct(F.col("right").alias("node"), F.coalesce("n_left", F.lit(1)).cast("long").alias("add")))).alias("e"), parent.alias("up"))
    nodes = settled(up.select("e.node", "e.add", "up"), "nodes")
    root = 2 * n - 2
    while not nodes.where(F.col("up") < root).isEmpty():
        higher = nodes.select(F.col("node").alias("up"), F.col("add").alias("more"), F.col("up").alias("next"))
        nodes = settled(nodes.join(higher, "up", "left").select("node", (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"), F.coalesce("next", "up").alias("up")), "nodes")
    return nodes.where(F.col("node") < n).select(F.col("node").cast("long").alias("c"), F.col("add").cast("int").alias("position"))


def _whole(distances: DataFrame, method: str, optimal: bool) -> DataFrame:
    """Merges (step ... size) and leaves (position, label) of at most SMALL labels, all in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        labels = np.array(sorted(set(part["i"])), dtype=object)
        place = {x: k for k, x in enumerate(labels)}
        part = part[part["j"].isin(place.keys()) & (part["i"] != part["j"])]
        n, i, j = len(labels), part["i"].map(place).to_numpy(int), part["j"].map(place).to_numpy(int)
        total, known = np.zeros((n, n)), np.zeros((n, n))
        for a, b in ((i, j), (j, i)):
            np.add.at(total, (a, b), part["v"].fillna(1.0).to_numpy(float))
            np.add.at(known, (a, b), 1)
        d = np.where(known > 0, total / np.maximum(known, 1), 1.0)
        np.fill_diagonal(d, 0)
        z = linkage(d, method) if n > 1 else np.zeros((0, 4))
        order = optimal_leaves(z, d) if optimal else leaves(z)
        merges = pd.DataFrame({"step": np.arange(len(z)), "left": z[:, 0], "right": z[:, 1], "distance": z[:, 2], "size": z[:, 3], "position": None, "label": None})
        places = pd.DataFrame({"step": None, "left": None, "right": None, "distance": None, "size": None, "position": np.arange(n), "label": labels[order]})
        out = pd.concat([merges.astype(object), places.astype(object)])
        numbers = {c: "Int32" for c in ("step", "left", "right", "size", "position")}
        return out.astype(numbers | {"distance": "Float64"})

    kind = distances.schema["i"].dataType.simpleString()
    return distances.select("i", "j", "v").where("i is not null").groupBy().applyInPandas(run, f"step int, left int, right int, distance double, size int, position int, label {kind}")


def order_of(spark: SparkSession, distances: DataFrame, method: str = "average", optimal: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merges (step, left, right, distance, size) and leaves (position, label) of a square long matrix of distances.

    Leaves are in the optimal order where ``optimal`` and there are at most SMALL,
    else as the merges name them.
    """
    n = distances.select("i").where("i is not null").distinct().count()
    kind = distances.schema["i"].dataType.simpleString()
    if n <= SMALL:
        both = settled(_whole(distances, method, optimal), "tree")
        return both.where("step is not null").drop("position", "label"), both.where("position is not null").select("position", "label")
    labels, pairs = _pairs(distances)
    if optimal:
        warnings.warn(f"the leaves' order is optimised for up to {SMALL} labels, not {n}", stacklevel=2)
    live, turn, merges = n, 0, None
    while live > SMALL:
        found, pairs = _round(pairs, method)
        live -= found.count()
        found = found.withColumn("turn", F.lit(turn).cast("long"))
        merges, turn = found if merges is None else merges.unionByName(found), turn + 1
    if live > 1:
        merges = merges.unionByName(settled(_finished(pairs, method, turn), "merges"))
    tree = _tree(merges, n)
    return tree, _places(tree, n).join(labels, "c").select("position", F.col("label").cast(kind).alias("label"))
