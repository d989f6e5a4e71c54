"""Operators that SQL can't express, and edge cases, against small direct computations."""

import hashlib
import inspect
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomscreen.functions import sequences as sq
from loomscreen.operators import cluster, counts, lowrank, matching, matrix, models, network, ranks, recall, running, screen
from loomscreen.plans import catalog, workflows
from loomscreen.sources import fastq, genomics, tables
from loomscreen.spec import ScreenSpec

SPEC = ScreenSpec(guides=("g",), barcodes=("b",), identity="a", reporter="r")


def test_edit_variants():
    v = sq.edit_variants("TAAAC")
    assert v[0] == "TAAAC" and len(v) == len(set(v)) and "AAAC" not in v and "TAAC" in v
    assert "TCAAC" in v and "TAAAGC" in v


def test_tolerant_guide_ladder(spark):
    tail = "ACGTACGTACGTACGTACGA"
    reads = {"TAAAC" + tail: tail, "GGTACAC" + tail: tail, "GTAAC" + tail + "A": tail, "TATAAC" + tail: tail, "GG" * 12 + "GGCGT": ("GG" * 12 + "GGCGT")[10:30 - 1], "TAAACACG": "", "": ""}
    df = spark.createDataFrame([(k,) for k in reads], "x string")
    comp = str.maketrans("ATGC", "TACG")
    for r in df.select("x", sq.tolerant_guide(F.col("x")).alias("y")).collect():
        x = r.x
        want = None
        for v in sq.edit_variants("TAAAC"):
            at = x.find(v)
            if at >= 0 and len(x) - at - len(v) >= 20:
                want = x[at + len(v) : at + len(v) + 20]
                break
        if want is None:
            c = x.rfind("CGT")
            want = x[c - 19 : c + 1] if c >= 20 else ""
        assert r.y == want.translate(comp)[::-1], x


def test_lineage_filter_drops_guides_without_a_transcript(spark):
    rows = [("g1", i, 1.0, 1.0) for i in range(40)] + [("g1", 99, 500.0, 1.0)] + [("g2", i, 0.0, 5.0) for i in range(9)] + [(None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, b int, a double, r double")
    kept = {(r.g, r.b) for r in screen.filter_lineages(df, SPEC).collect()}
    assert kept == {("g1", i) for i in range(40)}
    assert screen.filter_lineages(df.limit(0), SPEC).count() == 0


def test_representation_fills_numbers_only(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, n int")
    rep = spark.createDataFrame([("a", "A", 0.5)], "g string, name string, q double")
    got = {r.g: (r.name, r.q) for r in screen.with_representation(df, rep, ["g"]).collect()}
    assert got == {"a": ("A", 0.5), "b": (None, 0.0)}


def test_guide_ids(spark):
    df = spark.createDataFrame([("X_1", 5), ("Y_1", 1), ("X_2", 2), ("X_1", 9), (None, 1)], "g string, seq int")
    assert {r.guide: r.guide_id for r in screen.guide_ids(df, ["g"], "seq").collect()} == {"X_2": "X_1", "X_1": "X_2", "Y_1": "Y"}


def test_umi_collapse_counts_zeros(spark):
    df = spark.createDataFrame([("l", "u1", "i"), ("l", "u1", "i"), ("l", "u2", "r"), ("m", "u3", "r"), ("m", None, "i")], "l string, u string, t string")
    got = {r.l: (r.I, r.R) for r in counts.umi_collapse(df, ["l"], "u", "t", {"I": "i", "R": "r"}).collect()}
    assert got == {"l": (1, 1), "m": (0, 1)}


def naive_mwu(x, y):
    both = np.concatenate([x, y])
    r = pd.Series(both).rank().to_numpy()
    n1, n2 = len(x), len(y)
    u = r[:n1].sum() - n1 * (n1 + 1) / 2
    ties = sum(c**3 - c for c in pd.Series(both).value_counts())
    n = n1 + n2
    s = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) if n > 1 else 0
    z = max(abs(min(u, n1 * n2 - u) - n1 * n2 / 2) - 0.5, 0) / s if s else 0.0
    return u, z, math.erfc(z / math.sqrt(2))


def test_rank_test(spark):
    rng = np.random.default_rng(0)
    groups = {k: rng.integers(0, 9, n).astype(float) for k, n in (("a", 13), ("b", 30), ("c", 5))} | {"same": np.ones(4), "ones": np.ones(3)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)], "k string, x double")
    for r in ranks.mann_whitney(df, "k", "x", df.where("k in ('b', 'ones')")).collect():
        u, z, p = naive_mwu(groups[r.g], groups[r.c])
        assert (r.u, r.z, r.p) == pytest.approx((u, z, p))
    assert ranks.mann_whitney(df, "k", "x", df.where("k = 'same'")).where("g = 'ones'").first().p == 1


def test_false_discovery(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9, None]
    got = [r.q for r in ranks.bh_adjust(spark.createDataFrame([(x,) for x in p], "p double"), "p", "q").orderBy(F.col("p").asc_nulls_last()).collect()]
    best, n = 1.0, 5
    want = []
    for k in range(n, 0, -1):
        best = min(best, p[k - 1] * n / k)
        want.append(best)
    assert got[:5] == pytest.approx(want[::-1]) and got[5] is None


def test_student_tail():
    # Two-sided tails from public tables.
    assert 10 ** ranks.log10_t_tail(2.228, 10) == pytest.approx(0.05, rel=1e-3)
    assert 10 ** ranks.log10_t_tail(0.5, 3) == pytest.approx(0.6514, rel=1e-3)


def test_symmetrise(spark):
    m = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 3.0), ("a", "c", 5.0), ("a", "a", 7.0)], "i string, j string, v double")
    as_dict = lambda df: {(r.i, r.j): r.v for r in df.collect()}
    assert as_dict(matrix.symmetrise(m)) == {("a", "b"): 2.0, ("b", "a"): 2.0, ("a", "a"): 7.0}
    kept = as_dict(matrix.symmetrise(m, keep_single=True))
    assert kept[("c", "a")] == kept[("a", "c")] == 5.0
    again = as_dict(matrix.symmetrise(matrix.symmetrise(m, keep_single=True)))
    assert again == kept


def test_kendall_and_cosine_without_overlap(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([1, 2, 3, 4])] + [("b", k, float(v)) for k, v in enumerate([1, 3, 2, 4])] + [("c", 9, 1.0), ("z", 0, 0.0)]
    m = spark.createDataFrame(rows, "i string, j int, v double")
    assert matrix.kendall(m).where("a = 'a' and b = 'b'").first().v == pytest.approx(4 / 6)
    got = {(r.a, r.b): r.v for r in matrix.cosine(m).collect()}
    assert got[("a", "z")] is None and ("a", "c") not in got


def test_poisson_is_stationary():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame(list(itertools.product((0, 1), repeat=3)), columns=list("xyz"))
    cells["n"] = rng.integers(5, 50, 8)
    cells["y"] = cells["n"] * rng.uniform(0.5, 9, 8)
    beta = models.poisson_cells(cells, list("xyz"), 1.0)
    x = np.column_stack([np.ones(8), cells[list("xyz")]])
    mu = cells["n"] * np.exp(x @ beta)
    grad = x.T @ (mu - cells["y"]) / cells["n"].sum() + np.r_[0, np.ones(3)] * beta
    assert np.abs(grad).max() < 1e-9


def test_ols_with_collinear_dummies(spark):
    rng = np.random.default_rng(2)
    x, d = rng.standard_normal(200), rng.integers(0, 2, 200)
    y = 3 + 2 * x - d + rng.standard_normal(200) * 0.1
    df = spark.createDataFrame([(float(a), int(b), int(1 - b), float(c)) for a, b, c in zip(x, d, y, strict=True)], "x double, d int, e int, y double")
    cols = [F.col(c).cast("double") for c in ("x", "d", "e")]
    fit = models.ols(df, cols, F.col("y"))
    design = np.column_stack([np.ones(200), x, d])
    want = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = [r.p for r in df.select(models.linear(fit, cols).alias("p")).collect()]
    np.testing.assert_allclose(sorted(got), sorted(want), atol=1e-6)


def test_huber_is_stationary():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 3))
    y = x @ [1, -2, 0.5] + rng.standard_normal(80)
    y[:5] += 30
    b = models.huber_concomitant(x, y)
    value = lambda p: min(80 * s + np.where(np.abs(r := y - x @ p) <= 1.35 * s, r * r / s, 2 * 1.35 * np.abs(r) - 1.35**2 * s).sum() for s in np.geomspace(0.3, 5, 3000)) + 1e-4 * p @ p
    for i in range(3):
        for e in (-0.02, 0.02):
            p = b.copy()
            p[i] += e
            assert value(p) >= value(b) - 1e-4


def test_monotone_quadratic_by_grid():
    rng = np.random.default_rng(4)
    for sign in (1, -1):
        x = rng.uniform(-2, 1, 40)
        y = sign * (0.8 * x * x + 0.5 * x) + rng.standard_normal(40) * 0.2
        a, b = models.monotone_quadratic(x, y)
        assert min(2 * a * x.min() + b, 2 * a * x.max() + b) >= -1e-8
        value = lambda a, b: models._huber(y - a * x * x - b * x, 1.35) + 1e-4 * (a * a + b * b)  # noqa: E731, B023
        grid = ((p, q) for p in np.linspace(-2, 2, 161) for q in np.linspace(-2, 2, 161) if min(2 * p * x.min() + q, 2 * p * x.max() + q) >= 0)
        assert value(a, b) <= min(value(*g) for g in grid) + 1e-6


def test_per_gene_skips_short_rows(spark):
    effects = spark.createDataFrame([(f"g{i}", i / 4) for i in range(8)], "guide string, x double")
    pairs = [(f"g{i}", f"g{j}", float(i + j)) for i in range(8) for j in range(8) if i != 0 or j < 3]
    got = models.per_gene(spark.createDataFrame(pairs, "i string, j string, v double"), effects).select("i").distinct().collect()
    assert {r.i for r in got} == {f"g{i}" for i in range(1, 8)}
    with pytest.raises(ValueError):
        models.interactions(effects, effects, "other")


def test_low_rank_split():
    rng = np.random.default_rng(5)
    low = np.outer(rng.standard_normal(20), rng.standard_normal(20)) * 3
    d = low.copy()
    d[rng.integers(0, 20, 15), rng.integers(0, 20, 15)] += 8
    d[3, 4] = np.nan
    out = lowrank.split(d, most=3000)
    assert np.linalg.norm(out["L"] - low) < 0.25 * np.linalg.norm(low)
    s = np.linalg.svd(out["L"], compute_uv=False)
    assert s[3] < 0.2 * s[0]
    seen = np.isfinite(d)
    assert np.abs((out["L"] + out["S"] - d)[seen]).max() < 2


def test_low_rank_split_is_optimal():
    """The subgradient conditions hold at the result, with and without missing cells."""
    rng = np.random.default_rng(8)
    for share in (0.0, 0.1):
        d = np.outer(rng.standard_normal(15), rng.standard_normal(12)) + 0.2 * rng.standard_normal((15, 12))
        d[rng.integers(0, 15, 8), rng.integers(0, 12, 8)] += 6
        d[rng.random(d.shape) < share] = np.nan
        lam, mu = 0.3, 2.0
        out = lowrank.split(d, lam, mu, tol=1e-10)
        assert out["converged"]
        seen = np.isfinite(d)
        miss = np.where(seen, out["L"] + out["S"] - np.where(seen, d, 0), 0)
        y = mu * miss / np.linalg.norm(miss)
        # -y is a subgradient of the nuclear norm at L and of lam times the absolute sum at S.
        assert np.linalg.norm(y, 2) < 1 + 1e-4 and -(y * out["L"]).sum() == pytest.approx(np.linalg.svd(out["L"], compute_uv=False).sum(), rel=1e-4)
        assert np.abs(y).max() < lam + 1e-4 and -(y * out["S"]).sum() == pytest.approx(lam * np.abs(out["S"]).sum(), rel=1e-4)
        assert not out["S"][~seen].any()


def test_shrinking():
    x = np.array([[3.0, 0.0], [0.0, 4.0]])
    assert np.allclose(lowrank.shrink_norm(x, 1.0), x * 0.8) and not lowrank.shrink_norm(x, 6.0).any()
    assert np.allclose(lowrank.shrink_singular(x, 3.5)[0], [[0, 0], [0, 0.5]])


def test_numbers_of_many_rows(spark):
    """Each number once and in order, whatever columns come along, over sampled ranges."""
    rows = spark.range(0, 150_000, 1, 7).select(((F.col("id") * 7919) % 150_000).alias("k"), F.repeat(F.lit("x"), F.col("id").cast("int") % 50).alias("a"), F.rand(1).alias("b"))
    for df in (rows, rows.select("k"), rows.select("k", "a")):
        got = running.numbered(df, "k", "n")
        assert got.columns == [*df.columns, "n"]
        assert got.agg(F.count("*"), F.count_distinct("n"), F.max(F.abs(F.col("n") - F.col("k") - 1))).first() == (150_000, 150_000, 0)
    assert running.numbered(rows.limit(0), "k").count() == 0
    tied = running.numbered(rows.select((F.col("k") % 3).alias("k")), "k", "n")
    assert tied.agg(F.count_distinct("n"), F.max("n")).first() == (150_000, 150_000)


def test_ranks_over_many_ranges(spark):
    """Running sums over ranges equal whole windows."""
    rng = np.random.default_rng(9)
    p = rng.random(3000).round(3)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(p)], "g int, p double")
    for by, groups in (([], [p]), (["g"], [p[::2], p[1::2]])):
        want = []
        for x in groups:
            order = np.argsort(x, kind="stable")
            q = np.minimum.accumulate((x[order] * len(x) / np.arange(1, len(x) + 1))[::-1])[::-1]
            want += list(zip(x[order].tolist(), np.minimum(q, 1).tolist(), strict=True))
        got = sorted((r.p, r.q) for r in ranks.bh_adjust(df, "p", "q", *by).collect())
        assert np.allclose(np.array(got), np.array(sorted(want)))
    x = spark.createDataFrame([(f"g{i % 5}", float(v)) for i, v in enumerate(rng.integers(0, 40, 1500))], "k string, x double")
    of = {k: np.array([r.x for r in x.where(F.col("k") == k).collect()]) for k in (f"g{i}" for i in range(5))}
    for r in ranks.mann_whitney(x, "k", "x", x.where("k in ('g0', 'g3')")).collect():
        a, b = of[r.g], of[r.c]
        assert r.u == ((a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum())
        _, t = np.unique(np.concatenate([a, b]), return_counts=True)
        n = len(a) + len(b)
        sigma = np.sqrt(len(a) * len(b) / 12 * (n + 1 - (t.astype(float) ** 3 - t).sum() / (n * (n - 1))))
        assert r.z == pytest.approx(max(abs(min(r.u, len(a) * len(b) - r.u) - len(a) * len(b) / 2) - 0.5, 0) / sigma)


def test_records_of_split_files(spark, tmp_path):
    """Records of a plain file that is read in many splits."""
    lines = [f"@r{k}\nACGT{k}\n+\nIIII{k}\n" for k in range(20_000)]
    (tmp_path / "big.fastq").write_text("".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = fastq.records(spark, f"{tmp_path}/big.fastq").orderBy("rec_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.rec_no, r.name, r.seq, r.qual) for r in got] == [(k, f"r{k}", f"ACGT{k}", f"IIII{k}") for k in range(20_000)]


def naive_linkage(d):
    groups = {i: [i] for i in range(len(d))}
    heights = []
    while len(groups) > 1:
        a, b = min(itertools.combinations(groups, 2), key=lambda p: np.mean([d[i, j] for i in groups[p[0]] for j in groups[p[1]]]))
        heights.append(np.mean([d[i, j] for i in groups[a] for j in groups[b]]))
        new = max(groups) + 1
        groups[new] = groups.pop(a) + groups.pop(b)
    return heights


def test_linkage_and_leaf_order():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 8):
        p = rng.standard_normal((n, 3))
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
        z = cluster.linkage(d)
        np.testing.assert_allclose(z[:, 2], naive_linkage(d))
        assert sorted(cluster.leaves(z)) == list(range(n))
        order = cluster.optimal_leaves(z, d)
        length = lambda o: sum(d[a, b] for a, b in itertools.pairwise(o))  # noqa: E731, B023

        def flips(i):
            if i < n:  # noqa: B023
                return [[i]]
            a, b = flips(int(z[i - n, 0])), flips(int(z[i - n, 1]))  # noqa: B023
            return [x + y for x in a for y in b] + [y + x for x in a for y in b]

        assert sorted(order) == list(range(n)) and length(order) == pytest.approx(min(map(length, flips(2 * n - 2))))


def test_recall(spark):
    n, w = 60, 4
    order = spark.createDataFrame([(i, f"u{i}", f"g{i // 2}") for i in range(n)], "pos long, guide string, gene string")
    sets = spark.createDataFrame([("near", f"g{i}") for i in range(5)] + [("far", f"g{i}") for i in (1, 9, 18, 27)] + [("lost", "gX")], "cluster string, gene string")
    members, summary = recall.permutation_recall(order, sets, w, 300, seed=1, block=60)
    genes = {"near": set(range(10)), "far": {2, 3, 18, 19, 36, 37, 54, 55}}
    for r in members.collect():
        around = [p for p in range(max(0, r.pos - w), min(n, r.pos + w + 1)) if p != r.pos]
        assert r.score == pytest.approx(np.mean([p in genes[r.cluster] for p in around]))
    s = {r.cluster: r for r in summary.collect()}
    assert set(s) == {"near", "far"} and s["near"].p_value < 0.02 and s["near"].z > 3
    tested, final = recall.joint(order, sets.withColumn("set_name", F.lit("S")), w, 300)
    assert {r.cluster for r in final.collect()} == {"near"} and tested.where("fdr is null").count() == 0


def test_assign_prefers_near_and_large(spark):
    rows = [("A", f"a{i}", 10 + i, 0.5) for i in range(5)] + [("B", f"b{i}", 200 + i, 0.9) for i in range(6)] + [("A", "x", 12, None), ("B", "x", 12, 0.9), ("C", "y", 500, 0.1)]
    df = spark.createDataFrame(rows, "cluster string, gene string, pos long, score double")
    got = {r.gene: r.cluster for r in recall.assign(df).collect()}
    assert got["x"] == "A" and got["y"] == "C"


def test_density_mode_and_edges(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([rng.normal(0, 0.2, (200, 2)), rng.normal(4, 1.5, (60, 2))])
    rows = [("a", k, float(x), float(y)) for k, (x, y) in enumerate(p)] + [("b", 1000, 1.0, 2.0), ("b", 1001, 3.0, 4.0), ("c", 1002, float("nan"), 1.0), ("d", 1003, 1.0, None)] + [("e", 2000 + k, float(k), 2.0 * k) for k in range(5)]
    df = spark.createDataFrame(rows, "cluster string, gene long, x double, y double").repartition(5)
    got = {r.cluster: (r.x, r.y, r.n) for r in network.centres(df.select("cluster", "gene"), df.select("gene", "x", "y")).collect()}
    assert np.abs(np.array(got["a"][:2])).max() < 0.5 and got["a"][2] == len(p)
    # Few points and singular ones: medians; a cluster without a known point has no row.
    assert got["b"] == (2.0, 3.0, 2) and got["e"] == (2.0, 4.0, 5) and set(got) == {"a", "b", "e"}
    # All kernels at all places of the grid.
    lo, hi = p.min(axis=0), p.max(axis=0)
    gx, gy = (np.linspace(a - 0.1 * (b - a), b + 0.1 * (b - a), 50) for a, b in zip(lo, hi, strict=True))
    inverse = np.linalg.inv(np.cov(p.T) * len(p) ** (-1 / 3))
    best = max(((sum(np.exp(-0.5 * v @ inverse @ v) for v in p - np.array([x, y])), x, y) for x in gx for y in gy if abs(x) < 0.6 and abs(y) < 0.6), key=lambda t: t[0])
    np.testing.assert_allclose(got["a"][:2], best[1:], rtol=1e-9)
    m = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("a", "d", -5.0), ("b", "c", 1.0)], "i string, j string, v double")
    assert {(r.i, r.j) for r in network.capped(network.edges(m, 1.0, 1.0), 1).collect()} == {("a", "d"), ("a", "b")}


def test_sources(spark, tmp_path):
    import gzip

    (tmp_path / "s1").mkdir()
    with gzip.open(tmp_path / "s1" / "r1.fastq.gz", "wt") as f:
        f.write("".join(f"@i:1:f:{k}:t:x:y:UMI{k} z\nACGT{'ACGT'[k % 4]}\n+\nIIIII\n" for k in range(50)))
    rec = fastq.records(spark, f"{tmp_path}/s1/*.fastq.gz")
    got = [r.seq for r in rec.orderBy("rec_no").collect()]
    assert got == [f"ACGT{'ACGT'[k % 4]}" for k in range(50)]
    assert fastq.header_fields(rec).where("rec_no = 7").first().umi == "UMI7"
    assert fastq.mates(rec, rec).count() == 50
    assert [r.sample for r in tables.samples(spark, f"{tmp_path}/*/*.gz").collect()] == ["s1"]
    (tmp_path / "bad.fastq").write_text("i\nA\n+\nI\n")
    with pytest.raises(Exception, match="header"):
        fastq.records(spark, f"{tmp_path}/bad.fastq").collect()
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan"))], "k string, v double")
    tables.write_table(df, f"{tmp_path}/t_one.csv")
    back = tables.read_table(spark, f"{tmp_path}/t_one.csv", "k string, v double")
    assert {r.k: r.v for r in back.collect()} == {"a": 1.5, "b": None}
    lines = spark.createDataFrame([("#x",), ("c\t1\tid\tN\t.\t6\tP\tSVTYPE=DEL;SUPPORT=3;RNAMES=a,b",)], "value string")
    v = genomics.variants(lines)
    assert {r.qname for r in genomics.variant_reads(v).collect()} == {"a", "b"} and v.first().support == 3


def test_whitelist_correction(spark):
    known = spark.createDataFrame([("AAAA",), ("AAAT",), ("CCCC",)], "barcode string")
    df = spark.createDataFrame([(1, "AAAA"), (2, "CCCG"), (3, "AAAC"), (4, "CCNC"), (5, "GGGG")], "k int, b string")
    assert {r.k: r.b for r in matching.whitelisted(df, known, "b", correct=True).collect()} == {1: "AAAA", 2: "CCCC"}


def test_workflows(spark):
    from loomscreen.plans import analogs, workflows

    d = "/root/testdata/sf0.001"
    df = analogs.dual(spark, d)
    out = workflows.standard_dual(df, analogs.DUAL, prefix=analogs.CONTROL, method="joint", keep_single=True)
    assert out.summary.count() > 200 and out.interactions.where("z is not null").count() > 0
    merges, order = workflows.clustered(out.pairs)
    assert merges.count() == order.count() - 1
    with pytest.raises(ValueError, match="lacks"):
        workflows.validate(df.drop("ident"), analogs.DUAL)
    with pytest.raises(ValueError, match="no rows"):
        workflows.validate(df.limit(0), analogs.DUAL)


def test_stream_of_reads(spark, tmp_path):
    from loomscreen.streaming import umi

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("l,UMI\nx,1\nx,1\nx,2\ny,\n")
    (tmp_path / "in" / "b.csv").write_text("l,UMI\nx,2\ny,5\n")
    counted = umi.molecule_counts(umi.read_stream(spark, str(tmp_path / "in"), "l string, UMI string"), ["l"])
    q = counted.writeStream.outputMode("complete").format("memory").queryName("molecules").start()
    q.processAllAvailable()
    q.stop()
    assert {r.l: r.molecules for r in spark.table("molecules").collect()} == {"x": 2, "y": 1}


def test_best_match_of_a_large_library(spark, monkeypatch):
    """A library in several blocks gives the matches of one block, without a shared 8-mer as well."""
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("ACGT"), 20)) for _ in range(30)]
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    reads = [s[:6] + other[s[6]] + s[7:13] + other[s[13]] + s[14:] for s in names] + ["".join(rng.choice(list("ACGT"), 20)) for _ in range(10)]
    seqs = spark.createDataFrame([(r,) for r in reads], "seq string")
    library = spark.createDataFrame([(s,) for s in [*names, names[0]]], "identity string")
    found = lambda least: {r.seq: (r.identity, r.score) for r in matching.best_match(seqs, library, least).collect()}
    whole = {least: found(least) for least in (0, 60)}
    assert all(whole[60][r][0] == s for r, s in zip(reads, names, strict=False)) and len(whole[0]) == len(set(reads))
    monkeypatch.setattr(matching, "BROADCAST_LIBRARY", 7)
    assert {least: found(least) for least in (0, 60)} == whole


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, edits):
    """``s`` after so many random edits."""
    for _ in range(edits):
        i, b = int(rng.integers(0, len(s) + 1)), "ACGT"[rng.integers(0, 4)]
        s = [s[:i] + b + s[i:], s[:i] + s[i + 1 :], s[:i] + b + s[i + 1 :]][rng.integers(0, 3)]
    return s


@pytest.mark.parametrize("least", [0, 60, 80, 100])
def test_best_match_by_brute_force(spark, least):
    """Identities of several lengths, sequences of 0 to 9 edits, short and empty ones: as comparing all pairs."""
    rng = np.random.default_rng(least)
    library = ["".join(rng.choice(list("ACGT"), int(rng.choice([8, 19, 20, 21, 30])))) for _ in range(60)]
    asked = [edited(rng, library[int(rng.integers(0, 60))], int(rng.integers(0, 10))) for _ in range(120)] + ["", "A", "ACGTA"]
    score = lambda a, b: 100.0 * (1 - edit_distance(a, b) / max(len(a), len(b)))
    want = {}
    for a in set(asked):
        s, b = min((-score(a, b), b) for b in set(library))
        if -s >= least:
            want[a] = (b, -s)
    got = matching.best_match(spark.createDataFrame([(a,) for a in [*asked, None]], "seq string").repartition(4), spark.createDataFrame([(b,) for b in [*library, library[0], None]], "identity string"), least)
    assert {r.seq: (r.identity, r.score) for r in got.collect()} == want
    assert got.count() == len(want)


def test_best_match_prunes(spark):
    """20,000 sequences and 20,000 identities: under one candidate pair in 500, and the sequences' own identities."""
    rng = np.random.default_rng(5)
    library = ["".join(x) for x in rng.choice(list("ACGT"), (20_000, 20))]
    asked = {edited(rng, library[k], int(rng.integers(0, 3))): library[k] for k in range(20_000)}
    seqs = spark.createDataFrame([(a,) for a in asked], "seq string").repartition(8)
    names = spark.createDataFrame([(b,) for b in library], "identity string").repartition(8)
    pairs = sum(matching.candidates(seqs, names, d).count() for d in (1, 2))
    assert pairs < len(asked) * len(library) / 500
    got = {r.seq: r.identity for r in matching.best_match(seqs, names, 90).collect()}
    assert set(got) == set(asked) and sum(got[a] == b for a, b in asked.items()) > 0.999 * len(asked)


def test_best_match_of_nothing(spark):
    none = spark.createDataFrame([], "seq string, identity string")
    some = spark.createDataFrame([("ACGT", "ACGA")], "seq string, identity string")
    assert matching.best_match(some, none).collect() == matching.best_match(none, some).collect() == []


@pytest.mark.parametrize("radius", [1, 2])
def test_decoding_by_brute_force(spark, radius):
    """All words of five letters: the least edits with the ends of barcode or word left open, ambiguous words left out."""
    barcodes = ["AACCG", "TTGCA", "GGGTT", "CATCA"]
    want = {}
    for letters in itertools.product("ACGT", repeat=5):
        w = "".join(letters)
        near = sorted((min(min(edit_distance(b, w[:i]), edit_distance(b[:i], w)) for i in range(6)), b) for b in barcodes)
        if near[0][0] <= radius and (near[0][0] < near[1][0]):
            want[w] = near[0][1]
    known = spark.createDataFrame([(b,) for b in [*barcodes, barcodes[0], None]], "barcode string")
    assert {r.word: r.barcode for r in matching.decode_sphere(known, radius).collect()} == want
    reads = spark.createDataFrame([(1, "AACNG"), (2, "AACCG"), (3, None), (4, "NNNNN")], "k int, b string")
    assert {r.k: r.barcode_mapped for r in matching.decoded(reads, known, "b", radius).collect()} == {k: want[w] for k, w in ((1, "AACCG"), (2, "AACCG"), (4, "CCCCC")) if w in want}


@pytest.mark.parametrize("most", [1, 3])
def test_capped_edges_by_a_sequential_pass(spark, most):
    rng = np.random.default_rng(most)
    found = {(f"n{a:02d}", f"n{b:02d}"): float(v) for a, b, v in zip(rng.integers(0, 15, 120), rng.integers(15, 30, 120), np.round(rng.normal(size=120), 1), strict=True) if v}
    degree, want = {}, set()
    for (i, j), v in sorted(found.items(), key=lambda e: (-abs(e[1]), e[0])):
        ends = [(i, v > 0), (j, v > 0)]
        if all(degree.get(e, 0) < most for e in ends):
            want.add((i, j))
            degree |= {e: degree.get(e, 0) + 1 for e in ends}
    got = network.capped(spark.createDataFrame([(i, j, v) for (i, j), v in found.items()], "i string, j string, v double"), most)
    assert {(r.i, r.j) for r in got.collect()} == want


def test_band_joins_by_stretches(spark):
    """Neighbours within a window by all pairs; stretches are join keys."""
    rng = np.random.default_rng(6)
    p = [(int(x), "abc"[int(rng.integers(0, 3))]) for x in sorted(rng.choice(400, 150, replace=False))]
    df = spark.createDataFrame(p, "pos int, label string")
    for window in (0, 1, 7):
        got = recall.neighbours(df, "pos % 2 = 0", window)
        assert {tuple(r) for r in got.collect()} == {(a, b, x) for a, x in p for b, y in p if a % 2 == 0 and a != b and x == y and abs(a - b) <= window}
        some = df.where("pos % 5 = 0")
        assert {tuple(r) for r in recall.near(df, some, window).collect()} == {(a, x) for a, x in p if any(b % 5 == 0 and x == y and abs(a - b) <= window for b, y in p)}
    plan = recall.neighbours(df, "pos % 2 = 0", 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "_b#" in plan.split("Join Inner")[1].split("\n")[0]


def test_robust_fit_by_sums(spark, monkeypatch):
    """Rounds of aggregates end at the fit of the whole table, and the surface takes them beyond its size."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = x @ np.array([0.5, -1.0, 2.0]) + rng.standard_t(2, size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})).repartition(4).cache()
    np.testing.assert_allclose(models.huber_by_sums(df, ["a", "b", "c"], "y"), models.huber_concomitant(x, y), rtol=1e-7)
    assert models.huber_by_sums(df.limit(0), ["a", "b", "c"], "y").tolist() == [0, 0, 0]
    with pytest.warns(UserWarning, match="after 2 rounds"):
        models.huber_by_sums(df, ["a", "b", "c"], "y", most=2)
    df.unpersist()
    effects = spark.createDataFrame([(f"g{k}", float(v)) for k, v in enumerate(rng.normal(size=12))], "guide string, x double")
    pairs = spark.createDataFrame([(f"g{i}", f"g{j}", float(rng.normal())) for i in range(12) for j in range(12)], "i string, j string, v double")
    local = models.joint_surface(pairs, effects)[1]
    monkeypatch.setattr(models, "MOST_LOCAL", 0)
    np.testing.assert_allclose(models.joint_surface(pairs, effects)[1], local, rtol=1e-6)


def naive_tree(d, method):
    """Merge the two closest clusters, one pair at a time, by all pairs of their members."""
    live, out = {i: [i] for i in range(len(d))}, []
    gap = lambda a, b: (np.min if method == "single" else np.mean)(d[np.ix_(live[a], live[b])])
    while len(live) > 1:
        h, a, b = min((gap(a, b), a, b) for a, b in itertools.combinations(sorted(live), 2))
        members = live.pop(a) + live.pop(b)
        live[len(d) + len(out)] = members
        out.append((a, b, h, len(members)))
    return out


def long_matrix(spark, d):
    n = len(d)
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    return spark.createDataFrame(pd.DataFrame({"i": [f"l{k:05d}" for k in i.ravel()], "j": [f"l{k:05d}" for k in j.ravel()], "v": d.ravel()}))


@pytest.mark.parametrize(("method", "small"), [("average", 2), ("single", 9), ("average", 1024)])
def test_clustering_by_rounds(spark, monkeypatch, method, small):
    """Rounds of mutual neighbours give the merges of one pair at a time, and the same leaves."""
    rng = np.random.default_rng(small)
    x = rng.normal(size=(40, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    monkeypatch.setattr(cluster, "SMALL", small)
    tree, places = cluster.order_of(spark, long_matrix(spark, d), method, optimal=False)
    rows = sorted(tree.collect())
    want = naive_tree(d, method)
    assert [(r.step, r.left, r.right, r.size) for r in rows] == [(k, a, b, s) for k, (a, b, _, s) in enumerate(want)]
    np.testing.assert_allclose([r.distance for r in rows], [h for _, _, h, _ in want], rtol=1e-9)
    order = [int(r.label[1:]) for r in sorted(places.collect())]
    assert order == cluster.leaves(np.array([(r.left, r.right, r.distance, r.size) for r in rows]))


def test_clustering_of_many_labels(spark, monkeypatch):
    """500 labels by rounds down to 200 clusters: the merges of the chain method on the whole matrix."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    monkeypatch.setattr(cluster, "SMALL", 200)
    with pytest.warns(UserWarning, match="up to 200"):
        tree, places = cluster.order_of(spark, long_matrix(spark, d))
    rows, z = sorted(tree.collect()), cluster.linkage(d)
    assert [(r.left, r.right, r.size) for r in rows] == [(int(a), int(b), int(s)) for a, b, _, s in z]
    np.testing.assert_allclose([r.distance for r in rows], z[:, 2], rtol=1e-9)
    assert [int(r.label[1:]) for r in sorted(places.collect())] == cluster.leaves(z)


def test_clustering_edges(spark):
    """No label, one, missing pairs (at distance 1), ties and a matrix that isn't symmetric."""
    empty = spark.createDataFrame([], "i string, j string, v double")
    assert [t.collect() for t in cluster.order_of(spark, empty)] == [[], []]
    one = spark.createDataFrame([("a", "a", 0.0)], "i string, j string, v double")
    assert [[tuple(r) for r in t.collect()] for t in cluster.order_of(spark, one)] == [[], [(0, "a")]]
    few = spark.createDataFrame([("a", "b", 0.2), ("b", "a", 0.4), ("a", "a", 0.0), ("b", "b", 0.0), ("c", "c", 0.0), ("c", "a", float("nan"))], "i string, j string, v double")
    tree, places = cluster.order_of(spark, few)
    assert [(r.left, r.right, round(r.distance, 9), r.size) for r in sorted(tree.collect())] == [(0, 1, 0.3, 2), (2, 3, 1.0, 3)]
    assert {r.label for r in places.collect()} == {"a", "b", "c"} and places.count() == 3


def test_enrichment_by_brute_force(spark, monkeypatch):
    """Scores, p, nes, fdr and fwer of a small case, set by set; and the same beyond the size that is sent to tasks."""
    from loomscreen.operators import enrichment as en

    rng = np.random.default_rng(4)
    n, perms = 40, 60
    names = [f"g{k:02d}" for k in range(n)]
    weight = dict(zip(names, np.round(rng.normal(size=n), 1) + 0.05, strict=True))
    order = sorted(names, key=lambda g: (-weight[g], g))
    w = np.abs([weight[g] for g in order])
    sets = {"top": set(order[:6]), "low": set(order[-5:]), **{f"s{k}": set(rng.choice(names, int(rng.integers(1, 9)), replace=False)) for k in range(9)}, "all": set(names)}

    def curve(ranks):
        """The whole running sum, rank by rank."""
        total, up, best = sum(w[r] for r in ranks), 0.0, [0.0, 0.0]
        for r in range(n):
            up += w[r] / total if r in ranks else -1 / (n - len(ranks))
            best = [max(best[0], up), min(best[1], up)]
        high, low = round(best[0], 9), round(best[1], 9)
        return high if high >= -low else low

    sizes = sorted({len(s) for s in sets.values()} - {n})
    null = {(k, p): curve(set(en.first_ranks(n, k, p).tolist())) for k in sizes for p in range(perms)}
    # A permutation's sets are nested, and its order is that of its keys.
    assert all(set(en.first_ranks(n, 3, p)) < set(en.first_ranks(n, 8, p)) for p in range(perms))
    mean = lambda k, s: np.mean([abs(v) for (j, _), v in null.items() if j == k and (v >= 0) == s])
    es = {name: curve({order.index(g) for g in s}) for name, s in sets.items() if len(s) < n}
    nes = {name: round(abs(v) / mean(len(sets[name]), v >= 0), 9) for name, v in es.items()}
    want = {}
    for name, v in es.items():
        k, up = len(sets[name]), v >= 0
        alike = [abs(x) for (j, _), x in null.items() if j == k and (x >= 0) == up]
        every = [(round(abs(null[len(sets[o]), p]) / mean(len(sets[o]), up), 9), p) for o in es for p in range(perms) if (null[len(sets[o]), p] >= 0) == up]
        own = [nes[o] for o in es if (es[o] >= 0) == up]
        fdr = (sum(x >= nes[name] for x, _ in every) / len(every)) / (sum(x >= nes[name] for x in own) / len(own))
        want[name] = (k, v, nes[name] * (1 if up else -1), np.mean([a >= abs(v) for a in alike]), min(fdr, 1.0), len({p for x, p in every if x >= nes[name]}) / perms)
    genes = spark.createDataFrame([(g, float(x)) for g, x in weight.items()] + [("none", None), (None, 1.0)], "gene string, weight double")
    rows = spark.createDataFrame([(k, g) for k, s in sets.items() for g in s] + [("top", "unknown"), ("empty", "unknown"), ("top", order[0])], "gene_set string, gene string")
    for _ in range(2):
        got = {r.gene_set: tuple(r)[1:] for r in en.enrichment(genes, rows, perms).collect()}
        assert set(got) == set(want)
        for name, r in want.items():
            np.testing.assert_allclose(got[name], r, atol=1e-8, err_msg=name)
        monkeypatch.setattr(en, "MOST_SENT", 10)


def test_downsampled_sizes(spark):
    """Samples are exact, nested and of distinct lineages; a half without enough lineages has no sample of a size."""
    from loomscreen.operators import downsample

    rows = spark.createDataFrame([(f"g{k % 7}", k, 1 + k % 2) for k in range(300)], "guide string, barcode long, half int").where("half = 1 or barcode < 100")
    got = downsample.levels(rows, ["guide", "barcode"], [10, 60, 120], [3, 4]).collect()
    for half, seed in itertools.product((1, 2), (3, 4)):
        mine = [r for r in got if (r.half, r.seed) == (half, seed)]
        counts = [sum(r.level <= n for r in mine) for n in (10, 60, 120)]
        assert counts == ([10, 60, 120] if half == 1 else [10, 10, 10]) and {r.top for r in mine} == {120 if half == 1 else 10}
        keys = sorted(hashlib.md5(f"{seed}|{r.guide}|{r.barcode}".encode()).hexdigest() for r in rows.where(f"half = {half}").collect())
        assert sorted(hashlib.md5(f"{seed}|{r.guide}|{r.barcode}".encode()).hexdigest() for r in mine if r.level == 10) == keys[:10]


def test_hash_of_too_many_keys():
    from loomscreen.operators import sampling

    with pytest.raises(ValueError, match="at most 5"):
        sampling.hashed(list("abcdef"), 0)


def test_registered_permutations(spark, monkeypatch):
    """The recall queries take the reference's permutations and level: 1,000 for one set, 10,000 and 0.05 for several."""
    seen = []
    run, kind = recall.permutation_recall, inspect.signature(recall.joint)

    def spy(*args, **more):
        bound = inspect.signature(run).bind(*args, **more)
        bound.apply_defaults()
        seen.append(bound.arguments["n_perm"])
        return run(*args, **more)

    monkeypatch.setattr(recall, "permutation_recall", spy)
    rows = catalog.QUERIES["ml13_recall"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [1000] and all(abs(r.p_value * 1001 - round(r.p_value * 1001)) < 1e-6 for r in rows)
    levels, joint = [], recall.joint

    def outer(*args, **more):
        bound = kind.bind(*args, **more)
        bound.apply_defaults()
        levels.append(bound.arguments["alpha"])
        return joint(*args, **more)

    monkeypatch.setattr(recall, "joint", outer)
    catalog.QUERIES["ml17_joint_recall"](spark, "/root/testdata/sf0.001").collect()
    assert seen == [1000, 10_000] and levels == [0.05]


def test_low_rank_reports_convergence(spark, monkeypatch):
    """The registered splits keep the operator's limit, and an unfinished split shows."""
    rows = [(1, f"a{i}", f"b{j}", float(i * j + (i == j) * 5)) for i in range(6) for j in range(6)]
    m = spark.createDataFrame(rows, "k long, i string, j string, v double")
    assert {r.converged for r in lowrank.split_matrices(m, "k", most=3).collect()} == {False}
    with pytest.warns(UserWarning, match="converged"):
        workflows.denoised(m.drop("k"), most=3).collect()
    limits, split = [], lowrank.split_matrices

    def spy(cells, by, **settings):
        limits.append(settings.get("most", 5000))
        return split(cells, by, **settings)

    monkeypatch.setattr(lowrank, "split_matrices", spy)
    for name in ("mx11_low_rank", "pl08_dual_screen", "mx15_guide_activities"):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert limits == [5000] * 3
