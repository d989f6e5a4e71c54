"""Enrichment of sets along a ranking: scores, permutations, and error rates.

A set's score is the extreme of a running sum that rises at its genes by their
share of weight and falls evenly elsewhere; between two of its genes the sum
only falls, so the extremes stand just before or at them, and prefix sums over
the set's ranks are enough.  The null of a size is the scores of random sets of
that size.  A permutation orders all ranks by a hash; its first k are its set of
size k, so one order serves all sizes.  Blocks of permutations are tasks of
their own; their scores are a table of sizes times permutations, from which all
significance numbers are counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import settled
from . import running

#: Ranked genes up to which every task gets their weights (8 bytes each); beyond, random sets are joined with the ranking.
MOST_SENT = 1 << 20
#: Digits of scores, so that the order in which weights are added up decides no tie.
DIGITS = 9
#: Fixed values of the permutations' hash: a prime modulus and multipliers.
MODULUS, OF_RANK, OF_PERMUTATION, AGAIN = 2_147_483_647, 48_271, 69_621, 16_807


def hashed(rank: np.ndarray, permutation: int) -> np.ndarray:
    """The key by which a permutation orders ranks: two rounds of squaring."""
    x = (rank.astype(np.int64) * OF_RANK + (permutation + 1) * OF_PERMUTATION) % MODULUS
    x = (x * x + AGAIN) % MODULUS
    x = (x * AGAIN + permutation) % MODULUS
    return x * x % MODULUS


def first_ranks(n: int, most: int, permutation: int) -> np.ndarray:
    """The ``most`` ranks of 0 .. n - 1 that a permutation puts first, in its order (ties by rank)."""
    keys = hashed(np.arange(n), permutation) * 1.0
    few = np.argpartition(keys, most - 1)[:most] if most < n else np.arange(n)
    few = np.flatnonzero(keys <= keys[few].max()) if most < n else few
    return few[np.lexsort((few, keys[few]))][:most]


def extreme(ranks: np.ndarray, weights: np.ndarray, n: int) -> float | None:
    """The score of the set of these sorted ranks; None if it is all genes or has no weight."""
    k, total = len(ranks), weights.sum()
    if k >= n or total <= 0:
        return None
    up = np.cumsum(weights) / total
    down = (ranks - np.arange(k)) / (n - k)
    high, low = round(float((up - down).max()), DIGITS), round(float((up - weights / total - down).min()), DIGITS)
    return high if high >= -low else low


def ranked(genes: DataFrame) -> DataFrame:
    """gene, rank (from 0, falling weight, then gene) and the size of the weight."""
    known = genes.where("gene is not null and weight is not null").select("gene", F.col("weight").cast("double").alias("weight"))
    numbered = running.numbered(known.withColumn("_order", F.struct(-F.col("weight"), F.col("gene"))), "_order", "rank")
    return settled(numbered.select("gene", (F.col("rank") - 1).alias("rank"), F.abs("weight").alias("w")), "ranked")


def _scores(hits: DataFrame, by: list[str], n: int) -> DataFrame:
    """Scores of sets given as rows (by, rank, w): by, size, es."""
    w = Window.partitionBy(*by)
    upto = w.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hits.select(*by, "rank", "w", F.sum("w").over(w).alias("_total"), F.count("*").over(w).alias("size"), F.sum("w").over(upto).alias("_up"), F.row_number().over(w.orderBy("rank")).alias("_i"))
    down = (F.col("rank") - F.col("_i") + 1) / (F.lit(n) - F.col("size"))
    high, low = F.round(F.max(F.col("_up") / F.col("_total") - down), DIGITS), F.round(F.min((F.col("_up") - F.col("w")) / F.col("_total") - down), DIGITS)
    out = rows.where((F.col("size") < n) & (F.col("_total") > 0)).groupBy(*by, "size").agg(high.alias("high"), low.alias("low"))
    return out.select(*by, "size", F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")).alias("es"))


def null_scores(ranking: DataFrame, sizes: DataFrame, n: int, permutations: int) -> DataFrame:
    """size, permutation and es of a random set of each size in each permutation.  ``sizes`` (size) are distinct."""
    spark = ranking.sparkSession
    wanted = sorted(r[0] for r in sizes.where(F.col("size") < n).collect())
    if not wanted:
        return sizes.select("size", F.lit(0).cast("long").alias("permutation"), F.lit(0.0).alias("es")).limit(0)
    blocks = min(permutations, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = spark.range(0, permutations, 1, blocks)
    if n <= MOST_SENT:
        weights = spark.sparkContext.broadcast(np.array([r[0] for r in ranking.orderBy("rank").select("w").collect()]))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                out = []
                for p in part["id"]:
                    order = first_ranks(n, wanted[-1], int(p))
                    for k in wanted:
                        ranks = np.sort(order[:k])
                        es = extreme(ranks, weights.value[ranks], n)
                        if es is not None:
                            out.append((k, p, es))
                yield pd.DataFrame(out, columns=["size", "permutation", "es"])

        return ids.mapInPandas(run, "size long, permutation long, es double")

    def drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part["id"]:
                order = first_ranks(n, wanted[-1], int(p))
                for k in wanted:
                    yield pd.DataFrame({"size0": k, "permutation": p, "rank": order[:k]})

    rows = ids.mapInPandas(drawn, "size0 long, permutation long, rank long").join(ranking.select("rank", "w"), "rank")
    return _scores(rows, ["permutation", "size0"], n).select("size", "permutation", "es")


def at_least(rows: DataFrame, by: list[str], value: str, weight: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` over rows of the same ``by`` whose value is as large or larger."""
    dealt = running.ranged(rows.withColumn("_falling", -F.col(value)), *by, "_falling")
    dealt = running.carried(dealt, by, {"_before": (F.sum(weight), F.sum)})
    here = Window.partitionBy(*by, running.RANGE).orderBy("_falling").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(name, F.sum(weight).over(here) + F.coalesce("_before", F.lit(0))).drop("_falling", "_before", running.RANGE, running.PLACE)


def enrichment(genes: DataFrame, sets: DataFrame, permutations: int = 100_000) -> DataFrame:
    """One row a set (gene_set, gene): size, es, nes, p_value, fdr and fwer.

    ``genes`` has gene and weight.  nes is the score over the mean of the null's
    scores of its size and sign.  p_value is the share of these that are as
    extreme, fdr the share of all sets' normalised null scores of that sign over
    that of the sets' own, 1 at most, and fwer the share of permutations whose
    most extreme normalised score of that sign is as extreme.  Genes that aren't
    ranked take no part; sets of no gene or of all have no row; numbers are null
    where the null has no score of the sign.
    """
    ranking = ranked(genes)
    n = ranking.count()
    hits = sets.select("gene_set", "gene").where("gene_set is not null").distinct().join(ranking, "gene")
    scored = settled(_scores(hits, ["gene_set"], n).withColumn("sign", F.when(F.col("es") >= 0, 1).otherwise(-1)), "scores")
    sizes = settled(scored.groupBy("size").agg(F.count("*").alias("sets")), "sizes")
    null = settled(null_scores(ranking, sizes.select("size"), n, permutations).withColumn("sign", F.when(F.col("es") >= 0, 1).otherwise(-1)), "null")
    # A row a size and sign.
    means = settled(null.groupBy("size", "sign").agg(F.avg(F.abs("es")).alias("mean"), F.count("*").alias("n_null")), "means")
    nes = F.round(F.try_divide(F.abs("es"), F.col("mean")), DIGITS)
    mine = scored.join(means, ["size", "sign"], "left").select("gene_set", "size", "sign", "es", nes.alias("x"), "n_null")
    theirs = null.join(means, ["size", "sign"]).join(sizes, "size").select("size", "sign", "permutation", F.abs("es").alias("a"), nes.alias("x"), "sets")

    def counted(null_rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
        """For each set, the weight (column w) of the null rows as extreme as it."""
        asked = mine.where("x is not null").select("gene_set", *by, value.alias("v"), F.lit(0).cast("long").alias("w"))
        both = asked.unionByName(null_rows.withColumn("gene_set", F.lit(None).cast(mine.schema["gene_set"].dataType)))
        return at_least(both, by, "v", "w", name).where("gene_set is not null").select("gene_set", name)

    p = counted(theirs.select("size", "sign", F.col("a").alias("v"), F.lit(1).cast("long").alias("w")), ["size", "sign"], F.abs("es"), "n_as")
    of_null = counted(theirs.select("sign", F.col("x").alias("v"), F.col("sets").alias("w")), ["sign"], F.col("x"), "n_null_as")
    peaks = theirs.groupBy("sign", "permutation").agg(F.max("x").alias("v")).select("sign", "v", F.lit(1).cast("long").alias("w"))
    of_peaks = counted(peaks, ["sign"], F.col("x"), "n_peaks_as")
    own = at_least(mine.where("x is not null").withColumn("w", F.lit(1).cast("long")), ["sign"], "x", "w", "n_own_as").select("gene_set", "n_own_as")
    totals = theirs.groupBy("sign").agg(F.sum("sets").alias("all_null")).join(mine.where("x is not null").groupBy("sign").agg(F.count("*").alias("all_own")), "sign", "left")
    out = mine.join(p, "gene_set", "left").join(of_null, "gene_set", "left").join(own, "gene_set", "left").join(of_peaks, "gene_set", "left").join(totals, "sign", "left")
    fdr = (F.col("n_null_as") / F.col("all_null")) / (F.col("n_own_as") / F.col("all_own"))
    return out.select(
        "gene_set", "size", "es", (F.col("sign") * F.col("x")).alias("nes"), F.try_divide("n_as", "n_null").alias("p_value"),
        F.when(fdr.isNotNull(), F.least(fdr, F.lit(1.0))).alias("fdr"), (F.col("n_peaks_as") / F.lit(permutations)).alias("fwer"),
    )
