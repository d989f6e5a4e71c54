"""Exact top-k inner-product search by block-max pruning.

Vectors are put in an order that keeps near ones together (the nearest of some
centres, about the root of the rows' number, then the key) and cut into blocks
of consecutive documents.  A block keeps its forward index (the integer vectors
themselves) and, for each dimension, the least and largest component.  For a
query, the sum over dimensions of the larger of query * least and query *
largest bounds every score in a block; so does the query's score with the
block's middle plus the query's length times the block's radius.  The lesser
bound counts.  Blocks are visited in the order of their bounds, some at a time,
and scored through their forward indexes, until the next bound is below the
k-th score found or the query's floor; equal bounds are still visited, as a tie
goes to the smaller key.  The floor is the query's k-th score over the bounded
sample that the centres are fitted on (never over an eighth of the rows), worked
out in tasks over the queries: all searches start from it.  The result is exact
whatever the order of the documents.

Queries come in blocks of at most QUERY_ROWS, read one after another, and each
block (a bounded number of bytes) is broadcast to all document blocks.  Every
task returns k candidates a query, and the best k of these are kept.  Scores
are exact integers: 64-bit floats where all sums stay under 2**53, else Python
integers, which saturate at the range of a long in the result.

Edge cases: vectors that are null, empty, hold a null or a non-finite
component or have a null key take no part; vectors of different lengths score
over the shorter one's dimensions (missing ones count 0); rows with the query's
own key aren't its candidates; repeated rows are candidates of their own; a
repeated query key is one query, of its greatest vector; components beyond a
long saturate; fewer candidates than k are all returned; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import arrow, uniform
from .storage import shared_dir, stored

BLOCK = 64
QUERY_ROWS = 8192
#: Centres at most; and vectors for each, at most and one row in LEAST_SHARE, that they are fitted on and that give the queries' floors.
CENTRES = 1024
PER_CENTRE = 32
LEAST_SHARE = 8
#: Rows of a task's piece of the index that are searched at once, at least (an Arrow batch more at most).
PIECE_ROWS = 16_384
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v``: floor(256 * x) of every component, of the usable rows."""
    x = F.col("x")
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("x")).where("id is not null and x is not null and size(x) > 0")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(~bad).select("id", F.transform(x, lambda c: F.floor(c * 256.0).cast("double")).alias("v"))


def _dense(lists: pa.ListArray) -> np.ndarray:
    """The rows of an Arrow list array, padded with zeros to the longest."""
    ends = lists.offsets.to_numpy()
    size = np.diff(ends)
    if len(size) and size.min() == size.max():
        return lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].reshape(len(size), -1)
    return _matrix(lists.to_pylist(), int(size.max(initial=1)))


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    width = max(x.shape[1] for x in parts)
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts])


def _matrix(lists: list, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def centres(sample: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """k-means over a sample."""
    if len(sample) <= n:
        return sample
    found = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, found)
        for i in np.unique(near):
            found[i] = sample[near == i].mean(axis=0)
    return found


def nearest(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return ((found**2).sum(axis=1)[None] - 2 * (x @ found.T)).argmin(axis=1)


class Block:
    """Consecutive documents of the index: ids, their vectors, and bounds by blocks of BLOCK rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        begins = np.arange(0, len(ids), BLOCK)
        self.least = np.minimum.reduceat(vectors, begins, axis=0)
        self.most = np.maximum.reduceat(vectors, begins, axis=0)
        self.begins, self.ends = begins, np.minimum(begins + BLOCK, len(ids))
        self.middle = self.radius = None
        if vectors.dtype != object and len(ids):
            self.middle = np.add.reduceat(vectors, begins, axis=0) / (self.ends - begins)[:, None]
            away = np.sqrt(((vectors - np.repeat(self.middle, self.ends - begins, axis=0)) ** 2).sum(axis=1))
            self.radius = np.maximum.reduceat(away, begins)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, blocks): no score of the block is above it."""
        by_terms = np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T
        if self.middle is None:
            return by_terms
        length = np.sqrt((queries**2).sum(axis=1))
        by_radius = queries @ self.middle.T + length[:, None] * self.radius[None]
        # Scores are whole numbers; the margin is far over what rounding does to these sums.
        margin = 1 + 1e-9 * length[:, None] * (self.radius + np.sqrt((self.middle**2).sum(axis=1)))[None]
        return np.minimum(by_terms, by_radius + margin)

    def search(self, query: np.ndarray, own: int, order: np.ndarray, bound: np.ndarray, k: int, best: list[tuple], floor: float = -np.inf) -> list[tuple]:
        """The k best (-score, id) among ``best`` and this piece's documents; those under the floor may be missing."""
        at, step = 0, 2
        while at < len(order):
            if bound[order[at]] < floor or len(best) >= k and bound[order[at]] < -best[-1][0]:
                break
            chosen = order[at : at + step]
            rows = np.concatenate([np.arange(self.begins[b], self.ends[b]) for b in chosen])
            rows = rows[self.ids[rows] != own]
            scores = self.vectors[rows] @ query
            least = max(floor, -best[-1][0]) if len(best) >= k else floor
            if least > -np.inf:
                keep = scores >= least
                rows, scores = rows[keep], scores[keep]
            if len(rows) > k:
                top = np.lexsort((self.ids[rows], -scores))[:k]
                rows, scores = rows[top], scores[top]
            best = sorted([*best, *zip((-scores).tolist(), self.ids[rows].tolist(), strict=True)])[:k]
            at, step = at + step, min(step * 2, 32)
        return best


def _exact(v: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats if every sum is exact in them, else as Python integers."""
    if not v.size or not queries.size or np.abs(v).max() * np.abs(queries).max() * v.shape[1] < _EXACT:
        return v, queries
    whole = np.frompyfunc(int, 1, 1)
    return whole(v), whole(queries)


def _search_all(ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, best: list[list[tuple]]) -> None:
    width = max(vectors.shape[1], queries.shape[1])
    v, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, queries))
    v, q = _exact(v, q)
    block = Block(ids, v)
    for at in range(0, len(q), 256):
        bound = block.bounds(q[at : at + 256])
        order = np.argsort(-bound, axis=1, kind="stable")
        for i in range(len(bound)):
            best[at + i] = block.search(q[at + i], int(keys[at + i]), order[i], bound[i], k, best[at + i], floors[at + i])


def floors(keys: np.ndarray, queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among some of the rows, its own key's left out; no bound (-inf) if there are fewer."""
    width = max(queries.shape[1], sample.shape[1])
    q, s = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, sample))
    q, s = _exact(q, s)
    out = np.full(len(keys), -np.inf)
    if q.dtype == object or len(ids) <= k:
        return out
    for at in range(0, len(keys), 512):
        scores = q[at : at + 512] @ s.T
        scores[keys[at : at + 512, None] == ids[None]] = -np.inf
        out[at : at + 512] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return out


def index(rows: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Store the vectors in the order of their nearest centre and key; and the sample's ids and vectors."""
    n = rows.count()
    n_centres = max(1, min(CENTRES, int(np.sqrt(n))))
    chosen = rows.orderBy(uniform(F.col("id")), "id").limit(min(n_centres * PER_CENTRE, -(-n // LEAST_SHARE))).collect()
    width = max((len(r.v) for r in chosen), default=1)
    sample = _matrix([r.v for r in chosen], width)
    found = centres(np.clip(sample, -1e9, 1e9), n_centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _dense(batch.column(1))[:, :width]
            v = np.clip(np.pad(v, ((0, 0), (0, width - v.shape[1]))), -1e9, 1e9)
            near = nearest(v, found) if len(found) else np.zeros(len(v), dtype=int)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column(0), batch.column(1)], names=["centre", "id", "v"])

    placed = rows.transform(arrow(run, "centre int, id long, v array<double>"))
    vectors = stored(placed.repartitionByRange("centre", "id").sortWithinPartitions("centre", "id"), "vectors")
    return vectors, np.array([r.id for r in chosen], dtype=np.int64), sample


def _with_floors(queries: DataFrame, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """id, v and floor of the queries; the sample (of a bounded number of rows) is broadcast."""
    sent = queries.sparkSession.sparkContext.broadcast((ids, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sample = sent.value
        for batch in batches:
            least = floors(batch.column(0).to_numpy(), _dense(batch.column(1)), ids, sample, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], names=["id", "v", "floor"])

    out = stored(queries.select("id", "v").transform(arrow(run, "id long, v array<double>, floor double")), "queries")
    sent.destroy()
    return out


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, vectors and floors of the queries, QUERY_ROWS at a time; one partition's rows at most are on the driver."""
    rows: list = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([r.id for r in rows], dtype=np.int64), _matrix([r.v for r in rows], max(len(r.v) for r in rows)), np.array([r.floor for r in rows])

    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_ROWS:
            yield block()
            rows = []
    if rows:
        yield block()


def _long(x: float | int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows."""
    spark: SparkSession = vectors.sparkSession
    rows = stored(quantised(vectors, key, vector), "quantised")
    indexed, sample_ids, sample = index(rows)
    wanted = _with_floors(quantised(vectors.where(is_query), key, vector).groupBy("id").agg(F.max("v").alias("v")), sample_ids, sample, k)
    out, written = shared_dir(spark, "candidates"), []
    schema = "query_id long, vec_id long, score long"
    for n, block in enumerate(_query_blocks(wanted)):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, queries, least = sent.value
            best: list[list[tuple]] = [[] for _ in keys]
            ids, parts = [], []

            def flush() -> None:
                if ids:
                    _search_all(np.concatenate(ids), _stack(parts), keys, queries, least, k, best)
                    ids.clear()
                    parts.clear()

            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                parts.append(_dense(batch.column(1)))
                if sum(map(len, ids)) >= PIECE_ROWS:
                    flush()
            flush()
            found = [(int(q), i, _long(-s)) for q, top in zip(keys, best, strict=True) for s, i in top]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        written.append(f"{out}/{n}")
        indexed.select("id", "v").transform(arrow(run, schema)).write.parquet(written[-1])
        sent.destroy()
    found = spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
