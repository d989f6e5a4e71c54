import numpy as np
import pytest
from pyspark.sql import functions as F

from loomscreen.llm import jaccard
from loomscreen.llm.queries import ORACLES, QUERIES

from .oracle import oracle
from .oracle import ours as rows_of


def brute(rows):
    """doc_id, class_id, n_links by comparing all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    at: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    near = [set() for _ in rows]
    for i, s in enumerate(sets):
        shared: dict = {}
        for x in s:
            for j in at[x]:
                shared[j] = shared.get(j, 0) + 1
        near[i] = {j for j, n in shared.items() if j != i and n * 10 >= 8 * (len(s) + len(sets[j]) - n)}
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, js in enumerate(near):
        for j in js:
            group[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return sorted(((k, least[find(i)], len(near[i])) for i, (k, _) in enumerate(rows)), key=repr)


def ours(df):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in df.collect()), key=repr)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert ours(QUERIES["op2_jaccard_join"](spark, "/root/testdata/sf0.01")) == brute(docs)


@pytest.mark.parametrize("split", [4096, 6])
def test_edges_and_families(spark, monkeypatch, split):
    monkeypatch.setattr(jaccard, "SPLIT", split)
    monkeypatch.setattr(jaccard, "TILE", 12)
    rng = np.random.default_rng(2)
    word = lambda n: ["w%d" % i for i in rng.integers(0, 5000, n)]
    texts = [None, "", "  \n", "one", "one ", "a b c d", "a b c d e", "a b c d e f", "b c d e f g"]
    for _ in range(6):
        base = word(120)
        for _ in range(int(rng.integers(2, 25))):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(len(w)))] = "x%d" % rng.integers(100)
            texts.append(" ".join(w))
    texts += [" ".join(word(80)) for _ in range(60)] + [" ".join(word(30_000))] + ["same text here for all"] * 30 + [""] * 4
    rows = list(enumerate(texts)) + [(None, texts[9]), (3, texts[40])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_links int").repartition(5)
    want = brute([r for r in rows])
    got = ours(jaccard.join(df))
    if split == 4096:
        assert got == want
    else:
        assert np.mean([a == b for a, b in zip(got, want, strict=True)]) > 0.98
    assert jaccard.join(df.limit(0)).collect() == []


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    assert rows_of(QUERIES["op2_jaccard_join"](spark, d)) == oracle(ORACLES["op2_jaccard_join"], d)


def test_runs_for_the_target_recall():
    assert jaccard.RUNS == 32 and (1 - jaccard.survival(2)) ** jaccard.RUNS <= jaccard.MISSED
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 32, (1, jaccard.SLOTS), dtype=np.uint64).astype(np.uint32)
        b = np.where(rng.random((1, jaccard.SLOTS)) < jaccard.THRESHOLD, a, a + np.uint32(1)).astype(np.uint32)
        (_, x), (_, y) = jaccard.leaves(a), jaccard.leaves(b)
        met += len(np.intersect1d(x, y)) > 0
    assert met == 300


def test_large_buckets_are_split(spark, monkeypatch):
    """Families that share a passage: the large buckets of depth 2 fall apart into families; alike sets stay together."""
    rng = np.random.default_rng(3)
    word = lambda n: ["w%d" % i for i in rng.integers(0, 9000, n)]
    passage, texts = word(200), []
    for _ in range(40):
        base = passage + word(60)
        for k in range(5):
            texts.append(" ".join([*base[:-1], f"x{k}"]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "SPLIT", 30)
    signed = df.select("doc_id", *jaccard.class_key(F.col("text")), "text").transform(jaccard.arrow(jaccard._sign, "doc_id long, c1 long, c2 long, sketch binary"))
    reps = jaccard.stored(signed, "test-signed").select("c1", "c2", "sketch")
    sizes = [r.total for r in jaccard.buckets(reps).select("key", "total").distinct().collect()]
    whole = jaccard._shared(reps.transform(jaccard.arrow(jaccard._paths, jaccard._PATH)), "test-paths").agg(F.max("total")).first()[0]
    assert whole > 100 and np.mean(np.array(sizes) <= 30) > 0.8
    assert ours(jaccard.join(df)) == brute(rows)


def test_connected(spark):
    """Paths, cycles, stars and pairs in one graph; a graph of stars needs no round."""
    rng = np.random.default_rng(7)
    names = rng.permutation(400).tolist()
    edges = [(names[i], names[i + 1]) for i in range(150)] + [(names[200 + i], names[200 + (i + 1) % 40]) for i in range(40)] + [(names[300], names[300 + i]) for i in range(1, 50)] + [(names[390], names[391]), (names[391], names[390])]
    group = {x: x for e in edges for x in e}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.root for r in jaccard.connected(df).collect()}
    assert got == {x: find(x) for x in group if find(x) != x}
    stars = df.select(F.lit(0).alias("b"), (F.col("a") + 1).alias("a"))
    assert jaccard._starred(stars.distinct()) and not jaccard._starred(df.where("a > b").distinct())
    assert jaccard.connected(df.limit(0)).collect() == []
