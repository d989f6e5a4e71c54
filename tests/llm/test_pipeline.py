import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as cp

from .test_decontam import brute as leaks
from .test_decontam import split
from .test_jaccard import brute as groups
from .test_substring import brute as passages

D = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    at = docs
    done = []
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in at.collect()}
        at = cp.stored(stage(spark, at, D), "test")
        assert at.columns == names and at.schema.simpleString() == docs.schema.simpleString()
        after = {r.doc_id: r for r in at.collect()}
        assert at.count() == len(after)
        rows = [(k, r.text) for k, r in sorted(before.items())]
        if name == "language ID":
            assert set(after) == {k for k, t in rows if any(c.isalpha() for c in t)}
        elif name == "n-gram Jaccard join":
            assert set(after) == {c for _, c, _ in groups(rows)}
        elif name == "substring dedup":
            for (k, t), (_, gone, kept) in zip(rows, passages([t for _, t in rows]), strict=True):
                assert after[k].text == (kept if gone else t)
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            runs = lambda t: {tuple(w[i : i + 5]) for w in [split(t)] for i in range(len(w) - 4)}
            known = {k: runs(t) for k, t in items}
            gone = {k for k, t in rows for i, it in items if known[i] & runs(t) and leaks([(k, t)], [(i, it)])}
            assert set(before) - set(after) == gone
        done.append((name, len(before), len(after)))
    last = cp.tokens(spark, at, D).collect()
    assert len(last) == len(after)
    for r in last:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest()
    assert cp.run(spark, D).count() == len(last)
    print(done)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "same text of a few words here", "en"), (3, "same text of a few words here", "en"), (4, "same text of a few words here", None), (None, "another text in these words", "en"), (None, None, None)]
    df = spark.createDataFrame([(k, t, g, "s", 3, "clash") for k, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for empty in (False, True):
        at = df.limit(0) if empty else df
        for _, stage in cp.STAGES:
            at = cp.stored(stage(spark, at, D), "edges")
        assert at.count() == (0 if empty else 2)
    # Names that the operators use themselves, nulls beside them, and a long text.
    names = ["row", "key", "carried", "kept", "c1", "c2", "_h", "_1", "_0", "n_removed", "lang_pred", "sketch"]
    long = " ".join(f"w{i * i % 9973}x{i}" for i in range(60_000))
    clash = spark.createDataFrame([(1, long, *[None] * len(names)), (2, "one two three four five six", *["z"] * len(names))], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).withColumns({"lang": F.lit("en"), "n_chars": F.lit(3).cast("long")})
    at = clash
    for _, stage in cp.STAGES[:-1]:
        at = cp.stored(stage(spark, at, D), "clash")
        assert at.columns == clash.columns
    assert sorted((r.doc_id, r.text, r.row, r.c1) for r in at.collect()) == [(1, long, None, None), (2, "one two three four five six", "z", "z")]
    assert cp.tokens(spark, at, D).count() == 2
    assert cp.near_duplicates(spark, df, D).where(F.col("text").isNull() | (F.col("text") == "")).count() == 3


def test_texts_of_six_languages_stay(spark):
    """Whatever the number of languages, a low score alone rejects nothing; only texts without a letter go."""
    pools = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    line = lambda p, k: (" ".join("".join(p[(k * i + i * i + j) % 4] for j in range(2 + (i + k) % 4)) for i in range(200)))[:256]
    rows = [(100 * n + k, line(p, k) + line(p, k + 1), p) for n, p in enumerate(pools) for k in range(12)]
    rows += [(9000, "".join(line(p, 3) for p in pools), None), (9001, "12 !?", None), (9002, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in cp.language(spark, df, D).collect()} == {k for k, *_ in rows} - {9001, 9002}
