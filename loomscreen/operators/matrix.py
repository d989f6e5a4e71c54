"""Operators over labelled matrices kept long: one row (i, j, v) a cell, missing cells absent."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .screen import with_scalars


def mean_of(*cols: Column) -> Column:
    """Mean of the columns that aren't null; null if all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols[1:]), F.when(cols[0].isNotNull(), 1).otherwise(0))
    return F.when(n > 0, total / n)


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def labels(m: DataFrame) -> DataFrame:
    """All labels of rows and columns, once."""
    return m.select(F.col("i").alias("label")).union(m.select("j")).distinct()


def grid(m: DataFrame) -> DataFrame:
    """The square over all labels, null where a cell is missing. The size is the square of the labels' number."""
    a = labels(m)
    cells = a.select(F.col("label").alias("i")).crossJoin(a.select(F.col("label").alias("j")))
    return cells.join(m, ["i", "j"], "left")


def both_ways(m: DataFrame) -> DataFrame:
    """i, j, v and w: the cell and its mirror; a row where either is there."""
    other = transposed(m).withColumnRenamed("v", "w")
    return m.join(other, ["i", "j"], "full_outer")


def symmetrise(m: DataFrame, keep_single: bool = False, mask_diagonal: bool = False) -> DataFrame:
    """Mean of a cell and its mirror; a cell without one is missing, or kept as it is."""
    x = both_ways(m.where("v is not null"))
    v = F.when(F.col("v").isNotNull() & F.col("w").isNotNull(), (F.col("v") + F.col("w")) / 2)
    if keep_single:
        v = F.coalesce(v, "v", "w")
    if mask_diagonal:
        v = F.when(F.col("i") != F.col("j"), v)
    return x.select("i", "j", v.alias("v")).where("v is not null")


def lookup(pairs: DataFrame, m: DataFrame) -> DataFrame:
    """v of each pair (i, j), from its mirror if the pair itself has no row; ``turned`` tells so."""
    direct = m.select("i", "j", F.col("v").alias("a"), F.lit(True).alias("has"))
    mirror = transposed(m).withColumnRenamed("v", "b")
    x = pairs.join(direct, ["i", "j"], "left").join(mirror, ["i", "j"], "left")
    return x.select(*pairs.columns, F.when(F.col("has"), F.col("a")).otherwise(F.col("b")).alias("v"), F.col("has").isNull().alias("turned"))


def is_control(c: str, prefix: str) -> Column:
    return F.col(c).startswith(prefix)


def singles(m: DataFrame, prefix: str) -> DataFrame:
    """(control, guide, v): pairs of one control, either way round, averaged."""
    cg = m.where(is_control("i", prefix) & ~is_control("j", prefix)).select(F.col("i").alias("control"), F.col("j").alias("guide"), F.col("v").alias("a"))
    gc = m.where(~is_control("i", prefix) & is_control("j", prefix)).select(F.col("j").alias("control"), F.col("i").alias("guide"), F.col("v").alias("b"))
    return cg.join(gc, ["control", "guide"], "full_outer").select("control", "guide", mean_of(F.col("a"), F.col("b")).alias("v"))


def guide_pairs(m: DataFrame, prefix: str) -> DataFrame:
    """Cells of two guides that aren't controls."""
    return m.where(~is_control("i", prefix) & ~is_control("j", prefix))


def single_effects(pairs: DataFrame) -> DataFrame:
    """Mean of each guide over the controls."""
    return pairs.groupBy("guide").agg(F.avg("v").alias("x"))


def joint_value(x1: Column, x2: Column, a: float, b: float, c: float) -> Column:
    """a (x1^2 + x2^2) + b (x1 + x2) + c x1 x2."""
    return F.lit(a) * (x1 * x1 + x2 * x2) + F.lit(b) * (x1 + x2) + F.lit(c) * x1 * x2


def expected_joint(effects: DataFrame, a: float, b: float, c: float) -> DataFrame:
    """The joint surface's value for every pair of guides: the full grid is the result."""
    left, right = effects.select(F.col("guide").alias("i"), F.col("x").alias("x1")), effects.select(F.col("guide").alias("j"), F.col("x").alias("x2"))
    return left.crossJoin(right).select("i", "j", joint_value(F.col("x1"), F.col("x2"), a, b, c).alias("v"))


def z_of_all(m: DataFrame) -> DataFrame:
    """v over the standard deviation (of the population, not centred) of all cells."""
    return with_scalars(m, F.stddev_pop("v").alias("_s")).withColumn("z", F.try_divide("v", "_s")).drop("_s")


def _pairs(m: DataFrame) -> DataFrame:
    a = m.where("v is not null").select(F.col("i").alias("a"), "j", F.col("v").alias("x"))
    b = m.where("v is not null").select(F.col("i").alias("b"), "j", F.col("v").alias("y"))
    return a.join(b, "j").where("a < b")


def cosine(m: DataFrame) -> DataFrame:
    """a < b and the cosine of rows a and b over their shared columns; null without any, or with a zero norm."""
    dot, aa, bb = F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x")), F.sum(F.col("y") * F.col("y"))
    return _pairs(m).groupBy("a", "b").agg(F.try_divide(dot, F.sqrt(aa * bb)).alias("v"))


def correlation(m: DataFrame) -> DataFrame:
    """a < b and Pearson's r of rows a and b over their shared columns."""
    return _pairs(m).groupBy("a", "b").agg(F.corr("x", "y").alias("v"))


def spearman(m: DataFrame) -> DataFrame:
    """a < b and Spearman's r, ranks taken over each pair's shared columns."""
    ranked = _pairs(m).selectExpr(
        "a", "b",
        *(f"rank() over (partition by a, b order by {c}) + (count(*) over (partition by a, b, {c}) - 1) / 2.0D as r{c}" for c in ("x", "y")),
    )
    return ranked.groupBy("a", "b").agg(F.corr("rx", "ry").alias("v"))


def kendall(m: DataFrame) -> DataFrame:
    """a < b and Kendall's tau-b over their shared columns.

    A group is one pair of rows, as long as the matrix is wide; its pairs of
    columns are counted by sorting, not made.
    """

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["a", "b"]].iloc[:1].assign(v=tau_b(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)))

    p = _pairs(m)
    kind = p.schema["a"].dataType.simpleString()
    return p.groupBy("a", "b").applyInPandas(tau, f"a {kind}, b {kind}, v double")


def _tied(*values: np.ndarray) -> int:
    """Pairs of places that are equal in all of the arrays."""
    _, n = np.unique(np.stack(values), axis=1, return_counts=True)
    return int((n * (n - 1) // 2).sum())


def tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b; None where either side is constant."""
    every, tied_x, tied_y, tied = len(x) * (len(x) - 1) // 2, _tied(x), _tied(y), _tied(x, y)
    if every in (tied_x, tied_y):
        return None
    below: list[float] = []
    discordant = 0
    for value in y[np.lexsort((y, x))].tolist():
        at = bisect_right(below, value)
        discordant += len(below) - at
        below.insert(at, value)
    return (every - tied_x - tied_y + tied - 2 * discordant) / float(np.sqrt(float(every - tied_x) * float(every - tied_y)))


def as_square(pairs: DataFrame, diagonal: float = 1.0) -> DataFrame:
    """The full symmetric matrix of a < b pairs."""
    both = pairs.selectExpr("a as i", "b as j", "v").union(pairs.selectExpr("b as i", "a as j", "v"))
    return both.union(labels(both).selectExpr("label as i", "label as j", f"{diagonal}D as v"))


def distance(m: DataFrame) -> DataFrame:
    """1 - v within 0 .. 2; missing as 1."""
    return m.withColumn("v", F.least(F.greatest(1 - F.coalesce("v", F.lit(0.0)), F.lit(0.0)), F.lit(2.0)))


def complex_matrix(m: DataFrame, members: DataFrame) -> DataFrame:
    """Mean cell for each two clusters (members: cluster, gene; m's labels are genes).

    A pair of one gene with itself is left out within one cluster only.
    Clusters without any gene in the matrix are dropped; others fill the grid.
    """
    a, b = members.select(F.col("cluster").alias("c1"), F.col("gene").alias("i")), members.select(F.col("cluster").alias("c2"), F.col("gene").alias("j"))
    found = m.where("v is not null").join(a, "i").join(b, "j").where("c1 <> c2 or i <> j").groupBy("c1", "c2").agg(F.avg("v").alias("v"))
    known = members.join(labels(m).withColumnRenamed("label", "gene"), "gene", "left_semi").select("cluster").distinct()
    square = known.select(F.col("cluster").alias("c1")).crossJoin(known.select(F.col("cluster").alias("c2")))
    return square.join(found, ["c1", "c2"], "left")


def soft(x: Column, t: float) -> Column:
    """Soft threshold."""
    return F.signum(x) * F.greatest(F.abs(x) - F.lit(t), F.lit(0.0))


def masked_as(m: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of m that ``other`` has too."""
    return m.join(other.where("v is not null").select("i", "j"), ["i", "j"], "left_semi")


def reordered(m: DataFrame, order: DataFrame) -> DataFrame:
    """Cells with their rows' and columns' places (order: label, position)."""
    a, b = order.select(F.col("label").alias("i"), F.col("position").alias("pi")), order.select(F.col("label").alias("j"), F.col("position").alias("pj"))
    return m.join(a, "i").join(b, "j")
