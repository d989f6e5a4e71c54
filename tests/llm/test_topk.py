import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscreen.llm import topk
from loomscreen.llm.queries import ORACLES, QUERIES

from .oracle import oracle, ours


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_oracle(spark, sf):
    d = f"/root/testdata/{sf}"
    assert ours(QUERIES["op1_top_k"](spark, d)) == oracle(ORACLES["op1_top_k"], d)


def brute(rows, is_query, k):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if is_query(i):
            queries[i] = max(queries.get(i, v), v)
    out = []
    for q, a in queries.items():
        found = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(300)]
    rows += [(400 + i, [0.5] * 6) for i in range(200)] + [(100, None), (150, []), (200, [1.0, None]), (250, [float("nan")] * 6), (None, [1.0] * 6), (50, [9.0] * 6), (7, [1.0, 2.0]), (8, [1e9] * 6), (8, [1e9] * 6)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, lambda i: i % 50 == 0, 5)
    few = df.where("vec_id in (0, 1)")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((20, 16)) * 300
    v = np.floor(np.repeat(centre, 64, axis=0) + rng.standard_normal((1280, 16)))
    block, query, scored = topk.Block(np.arange(1280), v), v[3], []
    bound = block.bounds(query[None])[0]
    assert (bound >= (v @ query).reshape(20, 64).max(axis=1)).all()

    class Counting(np.ndarray):
        def __getitem__(self, i):
            scored.append(np.size(i))
            return np.asarray(super().__getitem__(i))

    block.vectors = v.view(Counting)
    block.search(query, 3, np.argsort(-bound), bound, 5, [])
    assert sum(scored) < 400
    # A floor that another task's rows give prunes from the start.
    scored.clear()
    assert block.search(query, 3, np.argsort(-bound), bound, 5, [], floor=float((v @ query).max()) + 1) == []
    assert sum(scored) <= 128


def test_floors_come_from_a_part_of_the_rows(spark, monkeypatch):
    """The sample holds at most an eighth of the rows, and queries in several blocks give what one block gives."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    quantised = topk.quantised(df, "vec_id", "embedding")
    _, ids, sample = topk.index(quantised)
    assert len(ids) == len(sample) == 50
    got = topk._with_floors(quantised, ids, sample, 5).collect()
    for r in got[::40]:
        scores = sorted(float(np.dot(r.v, s)) for i, s in zip(ids, sample, strict=True) if i != r.id)
        assert r.floor == scores[-5]
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    found = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute(rows, lambda i: i % 50 == 0, 5)


def test_floors_bound_the_kth_score():
    rng = np.random.default_rng(1)
    v, ids = np.floor(rng.standard_normal((400, 8)) * 200), np.arange(400)
    ids[7] = 3
    keys, sample = ids[:30], rng.permutation(400)[:60]
    got = topk.floors(keys, v[:30], ids[sample], v[sample], 5)
    for key, q, least in zip(keys, v[:30], got, strict=True):
        assert least == sorted((v[sample] @ q)[ids[sample] != key])[-5]
    assert (topk.floors(keys, v[:30], ids[:5], v[:5], 5) == -np.inf).all()
