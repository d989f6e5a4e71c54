"""Plot-ready tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import ratio
from ..sources.scratch import settled
from . import cluster, running
from .matrix import grid, mean_of


def top_percent(df: DataFrame, value: str, tie: str, percent: float) -> DataFrame:
    """The floor(n * percent / 100) rows of the largest values."""
    n = int(df.count() * percent // 100)
    return df.orderBy(F.desc(value), F.desc(tie)).limit(n)


def term_table(df: DataFrame, hue: str, cutoff: float, top: int, by: str | None = None, p_like: bool = True) -> DataFrame:
    """Terms at or under the cutoff, p-values clipped to 1e-5 .. 1 and as log10(1/p), hit ratios, and the top n (in each group)."""
    rows = df.withColumn("_h", F.col(hue).try_cast("double")).where("_h is not null")
    if p_like:
        clipped = F.greatest(F.least(F.col("_h"), F.lit(1.0)), F.lit(1e-5))
        rows = rows.where(F.col("_h") <= cutoff).withColumn("p_inv", F.log10(1 / clipped)).withColumn("_h", F.col("p_inv"))
    first = [F.desc("_h"), F.col("Term")]
    if by:
        out = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*first))).where(F.col("_k") <= top).drop("_k", "_h")
    else:
        out = rows.orderBy(*first).limit(top).drop("_h")
    return out.withColumn("Hits_ratio", ratio(F.col("Overlap"))) if "Overlap" in df.columns else out


def term_edges(terms: DataFrame) -> DataFrame:
    """Terms (term, genes array) that share genes: counts, Jaccard and overlap coefficients, and the shared genes."""
    rows = terms.select("term", F.array_distinct("genes").alias("genes"))
    one = rows.select("term", F.size("genes").alias("n"), F.explode("genes").alias("gene"))
    a, b = one.selectExpr("term as a", "n as na", "gene"), one.selectExpr("term as b", "n as nb", "gene")
    both = a.join(b, "gene").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_list("gene")), ",").alias("genes"))
    s = F.col("shared")
    return both.select("a", "b", "shared", (s / (F.col("na") + F.col("nb") - s)).alias("jaccard"), (s / F.least("na", "nb")).alias("overlap"), "genes")


def annotated(df: DataFrame, picks: dict[str, tuple[Column, str]], most: int = 50) -> DataFrame:
    """The rows to label: for each named pick (condition, column) the ``most`` rows of the condition with the largest values (ties by all columns), with the pick's name."""
    out = None
    for name, (condition, value) in picks.items():
        ties = [c for c in df.columns if c != value]
        top = df.where(condition & F.col(value).isNotNull()).orderBy(F.desc(value), *ties).limit(most).withColumn("pick", F.lit(name))
        out = top if out is None else out.unionByName(top)
    return out


def axis_order(df: DataFrame, item: str, other: str, value: str, method: str = "single") -> DataFrame:
    """position and label of an axis's items, by clustering their values over the other axis (missing ones 0) at Euclidean distance.

    Cells that occur twice count once (their first value by size).  Products are
    summed over shared columns only; the table of distances is of all pairs of
    items, as the clustering takes it.  At each merge the part that joined at the
    lesser distance comes first.
    """
    cells = df.where(F.col(item).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(item).alias("i"), F.col(other).alias("o")).agg(F.min(F.col(value).cast("double")).alias("v"))
    cells = settled(cells.withColumn("v", F.coalesce("v", F.lit(0.0))), "axis")
    lengths = cells.groupBy("i").agg(F.sum(F.col("v") * F.col("v")).alias("n"))
    shared = cells.join(cells.select(F.col("i").alias("j"), "o", F.col("v").alias("w")), "o").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    square = grid(shared).join(lengths, "i").join(lengths.select(F.col("i").alias("j"), F.col("n").alias("m")), "j")
    apart = F.sqrt(F.greatest(F.col("n") + F.col("m") - 2 * F.coalesce("v", F.lit(0.0)), F.lit(0.0)))
    distances = settled(square.select("i", "j", F.round(apart, 12).alias("v")), "distances")
    return cluster.order_of(df.sparkSession, distances, method, optimal=False)[1]


def mean_sem(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def running_enrichment(ranked: DataFrame, genes: DataFrame) -> DataFrame:
    """Weighted running sum along a falling order (gene, weight): the enrichment curve of a set (gene)."""
    marked = ranked.join(genes.select("gene", F.lit(True).alias("hit")), "gene", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    from .screen import with_scalars

    x = with_scalars(marked, F.sum(F.when(F.col("hit"), F.abs("weight"))).alias("_w"), F.count_if(~F.col("hit")).alias("_m"))
    step = F.when(F.col("hit"), F.try_divide(F.abs("weight"), "_w")).otherwise(-F.try_divide(F.lit(1.0), "_m"))
    rows = running.ranged(x.withColumn("_step", step).withColumn("_falling", -F.col("weight")), "_falling", "gene")
    here = Window.partitionBy(running.RANGE).orderBy(running.PLACE).rowsBetween(Window.unboundedPreceding, 0)
    rows = running.carried(rows, [], {"_before": (F.sum("_step"), F.sum)})
    return rows.withColumn("es", F.sum("_step").over(here) + F.coalesce("_before", F.lit(0.0))).select("gene", "weight", "hit", "es")


__all__ = ["annotated", "axis_order", "histogram", "mean_of", "mean_sem", "running_enrichment", "term_edges", "term_table", "top_percent"]
