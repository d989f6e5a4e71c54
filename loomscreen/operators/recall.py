"""Recall of known gene sets along a clustered order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import running
from .ranks import bh_adjust


def positions(df: DataFrame, order: str, label: str, *more: str) -> DataFrame:
    """Places 0, 1, ... of rows in an order of leaves."""
    return running.numbered(df, order, "_n").select((F.col("_n") - 1).cast("int").alias("pos"), label, order, *more)


def bucket(pos: str, window: int) -> Column:
    """The stretch of window + 1 places that a place is in: places within ``window`` are in the same or in adjacent ones."""
    return F.floor(F.col(pos) / F.lit(window + 1)).cast("long")


def buckets(pos: str, window: int) -> Column:
    """A place's stretch and both beside it, one a row."""
    b = bucket(pos, window)
    return F.explode(F.array(b - 1, b, b + 1))


def neighbours(p: DataFrame, chosen: str, window: int, label: str = "label") -> DataFrame:
    """at, near, cluster: other places of the same cluster within ``window`` of a chosen row, joined by cluster and stretch."""
    s = p.where(chosen).select(F.col("pos").alias("at"), F.col(label).alias("cluster"), buckets("pos", window).alias("_b"))
    other = p.select(F.col("pos").alias("near"), F.col(label).alias("cluster"), bucket("pos", window).alias("_b"))
    return s.join(other, ["cluster", "_b"]).where((F.abs(F.col("near") - F.col("at")) <= window) & (F.col("near") != F.col("at"))).select("at", "near", "cluster").distinct()


def near(rows: DataFrame, anchors: DataFrame, window: int, label: str = "label", pos: str = "pos") -> DataFrame:
    """Rows with an anchor of their cluster within ``window``, joined by cluster and stretch."""
    b = anchors.select(F.col(pos).alias("_p"), F.col(label).alias("_l"), buckets(pos, window).alias("_c"))
    a = rows.withColumn("_b", bucket(pos, window))
    return a.join(b, (F.col(label) == F.col("_l")) & (F.col("_b") == F.col("_c")) & (F.abs(F.col("_p") - F.col(pos)) <= window), "left_semi").drop("_b")


def observed(order: DataFrame, sets: DataFrame, window: int = 20) -> DataFrame:
    """cluster, gene, pos, score: the share of a member's neighbours (within ``window``, itself left out) that are members.

    order: pos, guide, gene; sets: cluster, gene.  Clusters of one place are skipped.
    """
    n = order.count()
    member = order.join(sets.distinct(), "gene").select("cluster", "gene", "guide", "pos")
    w = Window.partitionBy("cluster").orderBy("pos").rangeBetween(-window, window)
    size = F.count("*").over(Window.partitionBy("cluster"))
    around = F.least(F.col("pos") + window, F.lit(n - 1)) - F.greatest(F.col("pos") - window, F.lit(0))
    out = member.withColumn("inside", F.count("*").over(w) - 1).withColumn("size", size).where("size >= 2")
    return out.select("cluster", "gene", "guide", "pos", F.try_divide("inside", around).alias("score"))


def permutation_recall(order: DataFrame, sets: DataFrame, window: int = 20, n_perm: int = 1000, seed: int = 0, block: int = 50) -> tuple[DataFrame, DataFrame]:
    """Per member and per cluster: score, p = (permutations at or above + 1) / (n_perm + 1), and the cluster's z and ratio.

    Blocks of permutations are tasks of their own; each shuffles the order
    (a clustering's leaves, sent by closure), counts members by prefix sums and
    returns counts and moments only.
    """
    spark = order.sparkSession
    seen = observed(order, sets, window)
    known = seen.select("cluster", "guide", "pos", "score").orderBy("cluster", "pos").toPandas()
    n = order.count()
    codes, clusters = pd.factorize(known["cluster"])
    pos, score = known["pos"].to_numpy(np.int64), known["score"].to_numpy(float)
    of = [np.flatnonzero(codes == c) for c in range(len(clusters))]
    mean = np.array([score[i].mean() for i in of])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch["id"]:
                rng = np.random.default_rng([seed, int(b)])
                above = np.zeros(len(pos), dtype=np.int64)
                stats = np.zeros((len(of), 3))
                for _ in range(min(block, n_perm - int(b) * block)):
                    place = rng.permutation(n)
                    for c, i in enumerate(of):
                        at = place[pos[i]]
                        mark = np.zeros(n + 1, dtype=np.int64)
                        mark[at + 1] = 1
                        sums = np.cumsum(mark)
                        lo, hi = np.maximum(at - window, 0), np.minimum(at + window, n - 1)
                        s = (sums[hi + 1] - sums[lo] - 1) / np.maximum(hi - lo, 1)
                        above[i] += s >= score[i] - 1e-12
                        stats[c] += (s.mean() >= mean[c] - 1e-12, s.mean(), s.mean() ** 2)
                yield pd.DataFrame({"kind": ["guide"] * len(pos) + ["cluster"] * len(of), "i": [*range(len(pos)), *range(len(of))], "above": [*above.astype(float), *stats[:, 0]], "s1": [0.0] * len(pos) + [*stats[:, 1]], "s2": [0.0] * len(pos) + [*stats[:, 2]]})

    parts = spark.range(0, -(-n_perm // block), 1, numPartitions=min(-(-n_perm // block), 64)).mapInPandas(run, "kind string, i long, above double, s1 double, s2 double")
    total = parts.groupBy("kind", "i").agg(F.sum("above").alias("above"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).toPandas()
    guides = total[total["kind"] == "guide"].set_index("i").reindex(range(len(pos)), fill_value=0)
    known["p_value"] = (guides["above"].to_numpy(float) + 1) / (n_perm + 1)
    per = total[total["kind"] == "cluster"].set_index("i").reindex(range(len(of)), fill_value=0)
    null = per["s1"].to_numpy(float) / n_perm
    sd = np.sqrt(np.maximum(per["s2"].to_numpy(float) / n_perm - null**2, 0))
    z = np.where(sd > 0, (mean - null) / np.where(sd > 0, sd, 1), 0.0)
    ratio = np.where(null > 0, mean / np.where(null > 0, null, 1), np.inf)
    summary = pd.DataFrame({"cluster": clusters, "score": mean, "z": z, "ratio": ratio, "p_value": (per["above"].to_numpy(float) + 1) / (n_perm + 1), "size": [len(i) for i in of]})
    kind = order.schema["guide"].dataType.simpleString()
    members = spark.createDataFrame(known.astype({"pos": "int64"}), f"cluster {sets.schema['cluster'].dataType.simpleString()}, guide {kind}, pos long, score double, p_value double")
    return members, spark.createDataFrame(summary.astype({"size": "int64"}), f"cluster {sets.schema['cluster'].dataType.simpleString()}, score double, z double, ratio double, p_value double, size long").orderBy("p_value")


def expand(significant: DataFrame, members: DataFrame, window: int) -> DataFrame:
    """Significant rows (cluster, gene, pos, score) and their clusters' other members within ``window``, with a null score."""
    s = significant.select("cluster", F.col("pos").alias("_p"), buckets("pos", window).alias("_b"))
    close = members.withColumn("_b", bucket("pos", window)).join(s, ["cluster", "_b"]).where(F.abs(F.col("pos") - F.col("_p")) <= window).select("cluster", "gene", "pos").distinct()
    new = close.join(significant.select("cluster", "gene", "pos"), ["cluster", "gene", "pos"], "left_anti").withColumn("score", F.lit(None).cast("double"))
    return significant.select("cluster", "gene", "pos", "score").unionByName(new)


def assign(rows: DataFrame, reach: float = 80) -> DataFrame:
    """One cluster for each (gene, pos).

    Among clusters whose median place is within ``reach``: the largest, then the
    best scored (null as 0), then the first seen of the pair, then by name; if
    none is that near, the nearest, then by name.
    """
    by = Window.partitionBy("cluster")
    pair = Window.partitionBy("gene", "pos")
    x = rows.withColumn("n", F.count("*").over(by))
    mid = rows.groupBy("cluster").agg(F.median("pos").alias("mid"))
    x = x.join(mid, "cluster").withColumn("far", F.abs(F.col("pos") - F.col("mid"))).withColumn("seen", F.min("cluster").over(pair) == F.col("cluster"))
    is_near = F.col("far") <= reach
    order = pair.orderBy(is_near.desc(), F.when(is_near, -F.col("n")), F.when(is_near, -F.coalesce("score", F.lit(0.0))), F.when(is_near, (~F.col("seen")).cast("int")), F.when(~is_near, F.col("far")), "cluster")
    return x.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("cluster", "gene", "pos", "score")


def joint(order: DataFrame, sets: DataFrame, window: int = 20, n_perm: int = 10_000, alpha: float = 0.05, reach: float = 80, least: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """All sets (set_name, cluster, gene) at once: members with joint false-discovery rates, and the final clusters."""
    key = sets.select(F.concat_ws("\x1f", "set_name", "cluster").alias("cluster"), "gene")
    members, _ = permutation_recall(order, key, window, n_perm, seed)
    genes = order.select("guide", "gene")
    tested = bh_adjust(members.join(genes, "guide"), "p_value", "fdr")
    kept = tested.where(F.col("fdr") < alpha)
    grown = expand(kept, tested.select("cluster", "gene", "pos"), window)
    placed = assign(grown, reach)
    scored = placed.where("score is not null")
    orphans = near(placed.where("score is null"), scored, window, label="cluster")
    final = scored.unionByName(orphans).select("gene", "pos", "cluster").distinct()
    size = Window.partitionBy("cluster")
    final = final.withColumn("_n", F.count("*").over(size)).where(F.col("_n") >= least).drop("_n")
    split = lambda df: df.withColumn("set_name", F.split_part("cluster", F.lit("\x1f"), F.lit(1))).withColumn("cluster", F.split_part("cluster", F.lit("\x1f"), F.lit(2)))
    return split(tested), split(final)
