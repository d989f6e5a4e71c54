"""Steps whose figures must not grow faster than their input, and results that small tables don't reach."""

import numpy as np
from pyspark.sql import functions as F

from loomscreen.operators import counts, downsample, edits, matching, network, pairing, ranks, running, screen
from loomscreen.plans import analogs
from loomscreen.sources import blocks
from loomscreen.spec import ScreenSpec


def test_ties_of_millions(spark):
    """Cubes beyond 64 bits."""
    x = spark.range(4_000_000).select((F.col("id") % 4_000_000 < 3_000_000).alias("k"))
    assert ranks.tie_term(x, "k").first().ties == float(3_000_000**3 - 3_000_000 + 1_000_000**3 - 1_000_000)


def test_closeness_without_pairs(spark, monkeypatch):
    """As adding up the pairs; copies of places, unknown places, frequent cells in several parts; tasks get each distinct place once a part."""
    rng = np.random.default_rng(11)
    places = [*rng.normal(0, 2, (300, 2)).tolist(), [1.0, 0.0], [-1.0, 0.0], [-0.0, 0.0], [float("nan"), 0.0], [float("inf"), 1.0], [None, 1.0]]
    p = spark.createDataFrame([(k % 306, *places[k % 306]) for k in range(3060)], "k int, x double, y double")
    c = spark.createDataFrame([(k, *places[-k]) for k in range(1, 40)], "q int, x double, y double")
    monkeypatch.setattr(network, "CENTRE_ROWS", 7)
    monkeypatch.setattr(network, "POINT_ROWS", 16)
    sent = spark.sparkContext.accumulator(0)
    compared = pairing.compared

    def counting(left, right, by, a, b, f, schema):
        def g(x, y):
            sent.add(len(y) if len(x) else 0)
            return f(x, y)

        return compared(left, right, by, a, b, g, schema)

    monkeypatch.setattr(pairing, "compared", counting)
    finite = lambda df: df.where("abs(x) < 1e9")
    pairs = network.within(finite(c), finite(p), 1.5).groupBy("q").agg(F.count("*").alias("n"), F.sum(1.5 - F.col("distance")).alias("w"))
    want = {r.q: (r.n, round(r.w, 9)) for r in pairs.collect()}
    got = network.closeness(c, p, 1.5).collect()
    assert {r.q: (r.n, round(r.weight, 9)) for r in got} == want and len(want) > 30
    assert 0 < sent.value < 303 * 40
    assert network.closeness(c, p.limit(0), 1.5).count() == 0


def test_nearest_in_words():
    """Distances in bits are those of the edit table: all lengths up to a word, any letters, long sequences, empty texts, shared beginnings."""
    from tests.test_operators import edit_distance

    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("ACGT\0\U0001f600"), n))
    for most in (5, 32, 33, 64):
        library = sorted({"", text(most), *(text(int(rng.integers(0, most + 1))) for _ in range(25))})
        asked = ["", text(150), *(x[: len(x) // 2] + text(int(rng.integers(0, 9))) for x in library)]
        asked += [asked[1][:100] + text(9), "ACGN"]
        got = matching._nearest(asked, library[::-1], 20)
        score = lambda a, b: 100.0 * (1 - edit_distance(a, b) / max(len(a), len(b))) if a or b else -1.0
        want = [(a, *min((-score(a, b), b) for b in library)) for a in sorted(asked)]
        assert [tuple(r) for r in got.itertuples(index=False)] == [(a, b, -s) for a, s, b in want if -s >= 20]


def test_dense_rounds_are_left_out(spark, monkeypatch):
    """A round of pieces that would join a good part of all pairs isn't run."""
    rng = np.random.default_rng(8)
    texts = ["".join(x) for x in rng.choice(list("ACGT"), (600, 20))]
    seqs, library = spark.createDataFrame([(a,) for a in texts[:300]], "seq string"), spark.createDataFrame([(b,) for b in texts[300:]], "identity string")
    rounds, candidates = [], matching.candidates
    assert matching._candidates_number(seqs, library, 4) == candidates(seqs, library, 4).count()
    monkeypatch.setattr(matching, "candidates", lambda a, b, edits: rounds.append(edits) or candidates(a, b, edits))
    got = {r.seq: (r.identity, r.score) for r in matching.best_match(seqs, library, 50).collect()}
    near = matching._nearest(texts[:300], texts[300:], 50)
    assert got == {a: (b, s) for a, b, s in near.itertuples(index=False)} and max(rounds) == 2


def test_lineage_rows_are_dealt_by_number(spark, monkeypatch):
    """The two-guide table's tasks grow with its rows, and a lineage's rows are in one of them, so lineage sums need no further exchange."""
    d = "/root/testdata/sf0.001"
    n = analogs.read(spark, d, "lineitem").count()
    monkeypatch.setattr(counts, "TASK_ROWS", 100)
    rows = analogs.dual(spark, d)
    parts = rows.withColumn("part", F.spark_partition_id()).groupBy("barcode").agg(F.count_distinct("part").alias("n"))
    assert rows.rdd.getNumPartitions() == -(-n // 100) and parts.where("n > 1").isEmpty()
    sums = counts.pseudobulk(rows, analogs.DUAL.lineage, ["ident"])
    assert sums.rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_lineages_without_a_share_are_left_out(spark):
    """Rows of unknown lineages, of guides whose total is 0 and of over-represented lineages are gone, all others stay."""
    rows = [("a", 1, 1.0, 1.0)] * 2 + [("a", k, 1.0, 1.0) for k in range(2, 60)] + [("b", 1, 0.0, 3.0), (None, 1, 1.0, 1.0), ("c", None, 1.0, 1.0), ("d", 1, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, b int, a double, r double")
    got = screen.filter_lineages(df, ScreenSpec(guides=("g",), barcodes=("b",), identity="a", reporter="r")).collect()
    assert sorted((r.g, r.b) for r in got) == sorted([("a", 1)] * 2 + [("a", k) for k in range(2, 60)])


def test_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    """Splits are read several to a task, with the lines and places of single ones."""
    monkeypatch.setattr(blocks, "LEAST_TASKS", 4)
    monkeypatch.setattr(blocks, "BLOCK_TEXT", 500)
    lines = [f"{k} {k * 7919 % 10007}" for k in range(20_000)]
    text = "".join(f"{x}\n" for x in lines).encode()
    path = str(tmp_path / "a.gz")
    with open(path, "wb") as f:
        f.write(b"".join(blocks.block(text[i : i + 500]) for i in range(0, len(text), 500)) + blocks.END)
    reader = blocks._Reader(path, blocks.LINES, 1000, False)
    tasks = reader.partitions()
    splits = [s for t in tasks for s in t.each()]
    assert 4 <= len(tasks) <= 6 and [s.start for s in splits] == list(range(0, splits[-1].stop, 1000))
    got = [(at, m, v) for t in tasks for b in reader.read(t) for at, m, v in zip(*(b.column(c).to_pylist() for c in ("at", "m", "value")), strict=True)]
    assert [v for _, _, v in got] == lines and len({at for at, _, _ in got}) > 50 and len({(at, m) for at, m, _ in got}) == len(lines)


def test_order_keys_are_written_for_samples_only(spark, monkeypatch):
    """Of 20,000 lineages and 3 seeds, a sample of 30 leaves few keys; none that a sample of any group needs is missing."""
    written = {}
    settled = downsample.settled
    monkeypatch.setattr(downsample, "settled", lambda df, name: written.setdefault(name, settled(df, name)))
    monkeypatch.setattr(downsample, "BIN_DIGITS", 2)
    x = spark.range(20_000).select((F.col("id") % 9).alias("g"), F.col("id").alias("b"), F.when(F.col("id") < 20, 2).otherwise(1).alias("half"))
    got = downsample.levels(x, ["g", "b"], [10, 30], [0, 1, 2])
    counts_ = {(r.half, r.seed): (r.a, r.b) for r in got.groupBy("half", "seed").agg(F.count_if(F.col("level") == 10).alias("a"), F.count("*").alias("b")).collect()}
    assert counts_ == {(h, s): (10, 30 if h == 1 else 10) for h in (1, 2) for s in range(3)}
    assert 3 * 30 <= written["order-keys"].where("half = 1").count() < 3 * 200
    keys = lambda df: sorted(r[0] for r in df.where("half = 1 and seed = 0").select("key").collect())
    every = x.withColumn("seed", F.lit(0)).withColumn("key", downsample.order_key(F.col("seed"), ["g", "b"]))
    assert keys(written["order-keys"])[:30] == keys(every)[:30]


def test_rank_test_against_own_controls(spark, monkeypatch):
    """By ``only`` the results are those rows of all comparisons, and no others are made."""
    rows = [(f"g{k % 5}", "uv"[k % 2], float(k * 37 % 23)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, rep string, x double")
    own = df.where("g in ('g0', 'g1')").select(F.col("rep").alias("g"), "x")
    key = F.concat("rep", F.lit("/"), "g")
    every = {(r.c, r.g): r for r in ranks.mann_whitney(df.select(key.alias("g"), "x"), "g", "x", own).collect()}
    dealt, ranged = [], running.ranged
    monkeypatch.setattr(running, "ranged", lambda d, *order: dealt.append(d.where("asks").count()) or ranged(d, *order))
    got = ranks.mann_whitney(df, "g", "x", own, only="rep").collect()
    assert len(got) == 10 and all(every[r.c, f"{r.c}/{r.g}"][2:] == r[2:] for r in got)
    assert dealt == [df.distinct().count()]


def test_near_in_trees(monkeypatch):
    """What trees of halves find is what the whole comparison finds: any letters and lengths, empty and overlong texts, small steps."""
    from tests.test_operators import edit_distance

    rng = np.random.default_rng(5)
    monkeypatch.setattr(edits, "PLACES", 40)
    monkeypatch.setattr(edits, "PAIRS", 15)
    monkeypatch.setattr(edits, "MASKS", 100)
    for letters in ("A", "AC", "ACGT\0\U0001f600"):
        text = lambda n: "".join(rng.choice(list(letters), n))  # noqa: B023, E731
        library = sorted({text(int(rng.integers(0, 13))) for _ in range(30)})
        asked = sorted({"", text(70), *(x[:4] + text(2) + x[5:] for x in library), *("Z" + x for x in library)})
        away = {(a, b): edit_distance(a, b) for a in asked for b in library if a or b}
        score = lambda a, b: 100.0 * (1 - away[a, b] / max(len(a), len(b)))  # noqa: B023, E731
        for most in range(1, 8):
            got = edits.within(asked[::-1], library[::-1], most, 30)
            want = [(a, *min((-score(a, b), b) for b in library if b and away[a, b] <= most)) for a in asked if any(b and away[a, b] <= most for b in library)]
            assert [tuple(r) for r in got.itertuples(index=False)] == [(a, b, -s) for a, s, b in want if -s >= 30]


def test_far_sequences_are_settled_in_trees(spark, monkeypatch):
    """Of sequences some edits from all identities few are left for the comparison with each identity, and no match changes."""
    rng = np.random.default_rng(8)
    texts = ["".join(x) for x in rng.choice(list("ACGT"), (1200, 20))]
    seqs, library = spark.createDataFrame([(a,) for a in texts[:200]], "seq string"), spark.createDataFrame([(b,) for b in texts[200:]], "identity string")
    left, compared = [], matching._compared
    monkeypatch.setattr(matching, "ARRAY_PAIRS", 1)
    monkeypatch.setattr(matching, "TREE_LIBRARY", 400)
    monkeypatch.setattr(matching, "WALKS", (16, 64))
    monkeypatch.setattr(matching, "_compared", lambda a, *rest: left.append(a.count()) or compared(a, *rest))
    got = {r.seq: (r.identity, r.score) for r in matching.best_match(seqs, library, 50).collect()}
    near = matching._nearest(texts[:200], texts[200:], 50)
    assert got == {a: (b, s) for a, b, s in near.itertuples(index=False)} and len(got) > 190 and sum(left) < 100


def test_rank_test_within_replicates(spark, monkeypatch):
    """As comparing with each replicate's controls, with unknown values, and with values joined instead of sent; ranges hold each distinct value once."""
    rows = [(f"g{k % 5}", "uv"[k % 2], float(k * 37 % 23) if k % 11 else None) for k in range(400)] + [("g7", "w", 1.0), ("g8", "u", None)]
    df = spark.createDataFrame(rows, "g string, rep string, x double").withColumn("control", F.col("g").isin("g0", "g1"))
    own = df.where("control").select(F.col("rep").alias("g"), "x")
    want = {(r.c, r.g): r[2:] for r in ranks.mann_whitney(df, "g", "x", own, only="rep").collect()}
    dealt, ranged = [], running.ranged
    monkeypatch.setattr(running, "ranged", lambda d, *order: dealt.append(d.count()) or ranged(d, *order))
    for places in (ranks.PLACES, 0):
        monkeypatch.setattr(ranks, "PLACES", places)
        got = {(r.rep, r.g): r for r in ranks.mann_whitney_within(df, "rep", ["g"], "x", "control").collect()}
        assert {k: (r.u, r.cles, r.rbc, r.z, r.p) for k, r in got.items() if r.p is not None} == want and len(want) == 10
        assert got["w", "g7"].rows == 1 and got["u", "g8"].rows == 1 and got["u", "g8"]["mean"] is None
    assert dealt == 2 * [df.where("x is not null").select("rep", "x").distinct().count()]


def test_order_keys_that_a_bound_leaves_too_few(spark, monkeypatch):
    """Where too few keys lie under the bound, bins give the same samples."""
    x = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("b"), (F.col("id") % 2 + 1).alias("half"))
    samples = lambda: sorted(tuple(r) for r in downsample.levels(x, ["g", "b"], [10, 30], [0, 1]).collect())
    want, by_bins = samples(), []
    least_keys = downsample.least_keys
    monkeypatch.setattr(downsample, "least_keys", lambda *a: by_bins.append(1) or least_keys(*a))
    assert samples() == want and len(want) == 120 and not by_bins
    monkeypatch.setattr(downsample, "SPARE", -55)
    assert samples() == want and by_bins


def test_tests_are_worked_out_once(spark):
    """Ranges are sampled and nulls are added back without working the tests out again."""
    seen = spark.sparkContext.accumulator(0)
    p = F.udf(lambda k: seen.add(1) or k / 100, "double")
    got = ranks.bh_adjust(spark.range(90).select(p("id").alias("p")), "p", "q")
    assert got.count() == 90 and seen.value == 90
