from collections import Counter

import numpy as np

from loomscreen.llm import substring
from loomscreen.llm.queries import ORACLES, QUERIES

from .oracle import oracle, ours


def brute(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_oracle(spark):
    d = "/root/testdata/sf0.01"
    assert ours(QUERIES["op5_substring_dedup"](spark, d)) == oracle(ORACLES["op5_substring_dedup"], d)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", 5)
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("w%d" % i for i in rng.integers(0, 10_000, n))
    common, other = word(60), word(36)
    texts = [None, "", " \n ", word(34), *[word(50) + " " + common + "\t" + word(int(rng.integers(0, 40))) for _ in range(40)], "el " * 3000, other + "\x0b" + other, word(20_000), word(35) + " x", common[:-1], common + "\x85", *[word(80)] * 3]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(4, texts[4], "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(6)
    want = sorted((k, *x, "n") for (k, _, _), x in zip(rows, brute([t for _, t, _ in rows]), strict=True))
    read = lambda out: sorted((r.key, r.n_words, r.n_removed, r.kept, r.carried.kept) for r in out.collect())
    for flushes in (1, 3):
        assert read(substring.dedup(df, carry=["kept"], flushes=flushes)) == want
    for k, n, r, t, _ in read(substring.dedup(df, carry=["kept"], verbatim=True)):
        assert r or any(x[0] == k and x[1] == t for x in rows), (k, n)
    assert substring.dedup(df.limit(0)).collect() == []


def test_batches(spark):
    """Seven batches one by one, the index opened anew for each, equal one batch; runs are merged up to level 2."""
    rng = np.random.default_rng(2)
    word = lambda n: " ".join("w%d" % i for i in rng.integers(0, 10_000, n))
    passages = [word(40) for _ in range(6)]
    texts = [f"{word(30)} {passages[int(rng.integers(6))]} {word(int(rng.integers(0, 50)))}" if i % 3 else word(90) for i in range(70)]
    rows = list(enumerate(texts))
    folder = substring.shared_dir(spark, "test-index")
    index, levels, history = substring.Index.new(spark, folder), set(), {}
    for b in range(7):
        mine = rows[10 * b : 10 * b + 10]
        assert index.add(substring.prepared(spark.createDataFrame(mine, "doc_id long, text string").repartition(2))) == b
        levels |= {level for level, _ in index.state["runs"]}
        index = substring.Index.open(spark, folder)
        # What the new batch shares with history is found by merge joins with the stored runs.
        seen = {r.fp for r in index.scanned([b]).where("fp is not null").select("fp").collect()}
        assert {r.fp for r in index.known(b).collect()} == {fp for fp in seen if fp in history}
        history |= dict.fromkeys(seen)
        so_far = brute([t for _, t in rows[: 10 * b + 10]])
        got = {r.key: (r.n_words, r.n_removed, r.kept) for r in substring.kept(index, batch=b).collect()}
        assert got == {k: so_far[k] for k, _ in mine}
    assert levels == {0, 1, 2} and sorted(level for level, _ in index.state["runs"]) == [0, 1, 2]
    plan = index._merged(index.run(index.state["runs"][0][1]), index.run(index.state["runs"][1][1]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    whole = sorted((r.key, r.n_words, r.n_removed, r.kept) for r in substring.kept(index).collect())
    assert whole == [(k, *x) for (k, _), x in zip(rows, brute(texts), strict=True)]
