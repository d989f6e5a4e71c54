import re
from collections import Counter

import numpy as np

from loomscreen.llm import decontam
from loomscreen.llm.queries import ORACLES, QUERIES

from .oracle import oracle, ours


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    got = ours(QUERIES["op4_decontaminate"](spark, d))
    assert got == oracle(ORACLES["op4_decontaminate"], d) and len(got[1]) > 5


def split(t):
    return [w for w in re.split(r"[^\w]+|_+", (t or "").lower()) if w]


def brute(docs, items):
    """Every window of every item's size."""
    out = {}
    for k, t in docs:
        w = split(t)
        for i, it in items:
            v = split(it)
            if not v:
                continue
            n = min(5, len(v))
            a = Counter(tuple(v[j : j + n]) for j in range(len(v) - n + 1))
            for s in range(max(1, len(w) - len(v) + 1)):
                x = w[s : s + len(v)]
                b = Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))
                common, union = sum((a & b).values()), sum((a | b).values())
                if b and common / union >= 0.8 - 1e-12:
                    out[k, i] = max(out.get((k, i), 0), common / union)
    return out


def test_edges(spark):
    rng = np.random.default_rng(4)
    word = lambda n: ["w%d" % i for i in rng.integers(0, 300, n)]
    items = [(i, " ".join(word(int(n)))) for i, n in enumerate(rng.integers(16, 60, 12))] + [(50, "Short one"), (51, None), (52, " ,! "), (53, "la " * 20), (0, " ".join(word(30)))]
    docs = [(0, None), (1, ""), (2, " ".join(word(40))), (3, "a short, ONE b"), (4, "la " * 300), (5, "LA-" * 19), (None, items[1][1])]
    for i in range(60):
        body = split(items[i % 12][1])
        for _ in range(i % 4):
            at = int(rng.integers(len(body)))
            body = body[:at] + ["zz"] * int(rng.integers(0, 2)) + body[at + int(rng.integers(0, 2)) :]
        docs.append((100 + i, " ".join(word(int(rng.integers(0, 30)))) + " " + ", ".join(body).upper() + " " + " ".join(word(int(rng.integers(0, 30))))))
    docs.append((100, docs[-1][1]))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    got = {}
    for r in decontam.leaks(df, bench).collect():
        got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), r.similarity)
    want = brute(docs, items)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert decontam.leaks(df.limit(0), bench).collect() == [] and decontam.leaks(df, bench.limit(0)).collect() == []


def test_reordered_item(spark):
    """Every window counts, not only those at a shared shingle's offset: the item's halves in the other order."""
    rng = np.random.default_rng(8)
    word = lambda n: ["x%d" % i for i in rng.integers(0, 10**6, n)]
    a, b = word(30), word(30)
    items = [(1, " ".join(a + b)), (2, " ".join(word(60)))]
    docs = [(k, " ".join(word(before) + b + a + word(after))) for k, (before, after) in enumerate([(40, 45), (0, 40), (40, 0), (31, 3), (3, 31)])]
    docs += [(9, " ".join(word(40) + b + word(9) + a + word(40)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontam.leaks(df, bench).collect()}
    want = brute(docs, items)
    assert {k: s for k, (s, _) in got.items()} == {k: round(v, 9) for k, v in want.items()} and len(want) == 5
    assert got[0, 1] == (round(52 / 60, 9), 40)


def edited(rng, body, word):
    """The body with words at one end, or one inside, replaced."""
    n, kind = len(body), int(rng.integers(3))
    most = max(1, (n - 4) // 9)
    k = int(rng.integers(1, most + 1))
    if kind == 0:
        return word(k) + body[k:]
    if kind == 1:
        return body[: n - k] + word(k)
    at = int(rng.integers(n))
    return body[:at] + word(1) + body[at + 1 :]


def test_recall_of_edited_copies(spark):
    """Copies of similarity 0.8 to 1: nearly all lie within the radius of the index."""
    rng = np.random.default_rng(12)
    word = lambda n: ["y%d" % i for i in rng.integers(0, 10**6, n)]
    bodies = [word(int(n)) for n in rng.integers(20, 120, 60)]
    docs = [(k, " ".join(word(30) + edited(rng, bodies[k % 60], word) + word(30))) for k in range(300)]
    items = [(i, " ".join(b)) for i, b in enumerate(bodies)]
    want = {}
    for k, t in docs:
        want |= brute([(k, t)], [items[k % 60]])
    assert len(want) > 200 and min(want.values()) < 0.82
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= set(want) and len(found) >= 0.95 * len(want), (len(found), len(want))


def test_index_guarantee(spark):
    """Fingerprints that differ in RADIUS bits share a key, whichever bits; unrelated ones seldom do."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        a = rng.integers(0, 2, 64)
        b = a.copy()
        b[rng.choice(64, decontam.RADIUS, replace=False)] ^= 1
        near, far = ([int(sum(int(x) << j for j, x in enumerate(v))) for v in p] for p in ((a, b), (a, rng.integers(0, 2, 64))))
        rows += [(2 * i, *near), (2 * i + 1, *far)]
    rows = [(k, *(x - (1 << 64) if x >> 63 else x for x in p)) for k, *p in rows]
    df = spark.createDataFrame(rows, "i long, a long, b long")
    hits = df.select("i", decontam._keys("a").alias("k")).join(df.select("i", decontam._keys("b").alias("k")), ["i", "k"]).select("i").distinct()
    found = {r.i for r in hits.collect()}
    assert {i for i in found if i % 2 == 0} == set(range(0, 800, 2))
    assert sum(i % 2 for i in found) < 0.3 * 400
