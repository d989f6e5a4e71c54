"""Downsampled screens: nested samples of exact sizes for many seeds, from one scan.

A lineage has one order key for each seed (a digest of the seed and the
lineage).  The sample of size n is the n least keys, so samples of one seed are
nested, and what is measured on all sizes needs each row once: it is added up
at the least size that holds its lineage, then over the sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import settled
from .counts import present

#: Hexadecimal digits of an order key, and of the bins in which keys are counted.
KEY_DIGITS, BIN_DIGITS = 20, 4
#: Digits of a bound on keys, and keys under it besides twice the wanted ones.
BOUND_DIGITS, SPARE = 8, 64


def order_key(seed: Column, keys: list[str]) -> Column:
    """A reproducible key for each seed and lineage; texts of the keys are joined by '|'."""
    return F.substring(F.md5(F.concat_ws("|", seed.cast("string"), *(F.col(k).cast("string") for k in keys)).cast("binary")), 1, KEY_DIGITS)


def halves(lineages: DataFrame, keys: list[str], name: str = "half") -> DataFrame:
    """``lineages`` in two halves, 1 and 2, by the first bit of a digest."""
    return lineages.withColumn(name, F.when(order_key(F.lit("half"), keys) < "8", 1).otherwise(2))


def least_keys(keyed: DataFrame, by: list[str], most: int, key: str = "key") -> DataFrame:
    """The rows of ``keyed`` among which are the ``most`` least keys of each group.

    Keys are counted in bins by their first digits; what lies beyond the bin of
    the last wanted key is left out, so only about as many rows as are wanted
    are kept of a group of any size.  ``keyed`` is worked out twice, not written.
    """
    bin_ = F.substring(key, 1, BIN_DIGITS)
    bins = settled(keyed.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n")), "bins")
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # The last bin with fewer wanted keys before it than there are.
    last = bins.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < most).groupBy(*by).agg(F.max("bin").alias("_last"))
    return keyed.join(F.broadcast(last), by).where(bin_ <= F.col("_last")).drop("_last")


def bounded(keyed: DataFrame, by: str, numbers: DataFrame, most: int, key: str = "key") -> DataFrame:
    """The rows of ``keyed`` under a bound that leaves about twice ``most`` of evenly spread keys of each group; ``numbers``: groups (_by) and their numbers of keys (n)."""
    share = F.lit(2.0 * most + SPARE) / F.col("n")
    limit = F.when(share < 1, F.lpad(F.lower(F.hex((share * F.lit(float(16**BOUND_DIGITS))).cast("long"))), BOUND_DIGITS, "0"))
    limits = numbers.select("_by", limit.alias("_limit"))
    return keyed.join(F.broadcast(limits), F.col(by) == F.col("_by")).where(F.col("_limit").isNull() | (F.substring(key, 1, BOUND_DIGITS) <= F.col("_limit"))).drop("_by", "_limit")


def thresholds(keyed: DataFrame, by: list[str], sizes: list[int], key: str = "key") -> DataFrame:
    """The n-th least key of each group for each size n (no row where a group has fewer): ``by``, size, limit.

    Keys are counted in bins by their first digits; only the bins that hold a
    wanted key are sorted, so a group of any size is selected from without
    sorting it.
    """
    bins = keyed.groupBy(*by, F.substring(key, 1, BIN_DIGITS).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array(*(F.lit(n).cast("long") for n in sizes))
    found = bins.withColumn("upto", F.sum("n").over(w)).select(*by, "bin", "upto", (F.col("upto") - F.col("n")).alias("before"), F.explode(wanted).alias("size"))
    # At most one bin for each group and size.
    found = found.where((F.col("before") < F.col("size")) & (F.col("size") <= F.col("upto"))).select(*by, "bin", "size", (F.col("size") - F.col("before")).alias("place"))
    inside = keyed.select(*by, key, F.substring(key, 1, BIN_DIGITS).alias("bin")).join(F.broadcast(found), [*by, "bin"])
    ranked = inside.withColumn("k", F.row_number().over(Window.partitionBy(*by, "size").orderBy(key)))
    return ranked.where("k = place").select(*by, F.col("size"), F.col(key).alias("limit"))


def levels(lineages: DataFrame, keys: list[str], sizes: list[int], seeds: list[int], by: str = "half") -> DataFrame:
    """``keys``, ``by``, seed, the least size whose sample holds the lineage, and the largest that its group has; lineages in no sample are left out.

    ``lineages`` are distinct and non-null.  A group of fewer lineages than a
    size has no sample of it.
    """
    # Settled, as counting the groups reads all lineages.
    numbers = settled(lineages.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("n")), "numbers")
    keyed = lineages.select(*keys, by, F.explode(F.array(*(F.lit(s) for s in seeds))).alias("seed")).withColumn("key", order_key(F.col("seed"), keys))
    # Only keys that a sample can hold are written, and keys are worked out once, as evenly spread ones leave enough under a bound.
    few = settled(bounded(keyed, by, numbers, max(sizes)), "order-keys")
    short = numbers.join(few.groupBy(by, "seed").agg(F.count("*").alias("has")), F.col("_by") == F.col(by), "left").groupBy("_by", "n").agg(F.min("has").alias("has"), F.count("has").alias("seeds"))
    wanted = F.least(F.col("n"), F.lit(max(sizes)))
    if short.where((F.col("seeds") < len(set(seeds))) | (F.col("has") < wanted)).isEmpty():
        keyed = few
    else:
        keyed = settled(least_keys(keyed, [by, "seed"], max(sizes)), "order-keys-by-bins")
    limits = thresholds(keyed, [by, "seed"], sizes)
    # One row a group and seed, with the limits in the order of sizes: groups times seeds times sizes in all.
    limits = limits.groupBy(by, "seed").agg(F.array_sort(F.collect_list(F.struct("size", "limit"))).alias("limits"))
    level = F.try_element_at(F.filter("limits", lambda x: F.col("key") <= x["limit"]), F.lit(1))["size"]
    placed = keyed.join(F.broadcast(limits), [by, "seed"]).withColumn("level", level)
    return placed.where("level is not null").select(*keys, by, "seed", "level", F.element_at("limits", -1)["size"].alias("top"))


def means(rows: DataFrame, lineage: list[str], guides: list[str], value: str, sizes: list[int], seeds: list[int]) -> DataFrame:
    """The mean ``value`` of each guide in each half, seed and size: half, seed, size, guides, v, n (rows)."""
    return _sampled(lineage_sums(rows, lineage, value), lineage, guides, sizes, seeds)


def lineage_sums(rows: DataFrame, lineage: list[str], value: str) -> DataFrame:
    """``lineage``, its half, and the sum ``s`` and number ``c`` of its known values, settled."""
    sums = present(rows, [*lineage, value]).groupBy(*lineage).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    return settled(halves(sums, lineage), "lineage-sums")


def _sampled(sums: DataFrame, lineage: list[str], guides: list[str], sizes: list[int], seeds: list[int]) -> DataFrame:
    # Settled, so that small samples are broadcast and the lineages stay where they are.
    chosen = settled(levels(sums.select(*lineage, "half"), lineage, sizes, seeds), "chosen")
    sums = sums.drop("half").join(chosen, lineage).groupBy("half", "seed", "level", "top", *guides).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    # What a level adds counts in all larger samples too.
    larger = F.filter(F.array(*(F.lit(n).cast("long") for n in sizes)), lambda n: n.between(F.col("level"), F.col("top")))
    spread = sums.select("half", "seed", *guides, "s", "c", F.explode(larger).alias("size"))
    return spread.groupBy("half", "seed", "size", *guides).agg((F.sum("s") / F.sum("c")).alias("v"), F.sum("c").alias("n"))


def control_scores(table: DataFrame, by: list[str], control: Column, value: str = "v") -> DataFrame:
    """``z``: distance from the controls' mean in their standard deviations, within each ``by``."""
    stats = table.where(control).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    same = reduce(Column.__and__, (F.col(c) == F.col(f"_{c}") for c in by))
    return table.join(F.broadcast(stats), same, "left").withColumn("z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s", *(f"_{c}" for c in by))


def concordance(rows: DataFrame, lineage: list[str], guides: list[str], value: str, sizes: list[int], seeds: list[int], control: Column) -> DataFrame:
    """Correlations of the guides' z-scores for each size and seed: size, seed, r_sampled, r_full, n_guides.

    ``r_sampled`` compares the samples of both halves, ``r_full`` the sample of
    the first with all of the second.  A guide that one side lacks has a score of
    0 there; guides that no side has take no part.
    """
    return concordance_of(lineage_sums(rows, lineage, value), lineage, guides, sizes, seeds, control)


def concordance_of(sums: DataFrame, lineage: list[str], guides: list[str], sizes: list[int], seeds: list[int], control: Column) -> DataFrame:
    """As ``concordance``, of a settled table of lineages with their half, sum ``s`` and number ``c`` of values."""
    table = settled(control_scores(_sampled(sums, lineage, guides, sizes, seeds), ["half", "seed", "size"], control), "downsampled")
    first = table.where("half = 1").select("size", "seed", *guides, F.coalesce("z", F.lit(0.0)).alias("a"))
    second = table.where("half = 2").select("size", "seed", *guides, F.coalesce("z", F.lit(0.0)).alias("b"))
    grid = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("size"), F.lit(s).alias("seed")) for n in sizes for s in seeds)))
    other = sums.where("half = 2").groupBy(*guides).agg((F.sum("s") / F.sum("c")).alias("v"))
    full = control_scores(other.withColumn("side", F.lit(2)), ["side"], control).select(*guides, F.coalesce("z", F.lit(0.0)).alias("b"), grid.alias("g")).select("g.size", "g.seed", *guides, "b")
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def compared(other: DataFrame, name: str) -> DataFrame:
        both = first.join(other, ["size", "seed", *guides], "full")
        return both.groupBy("size", "seed").agg(F.corr(zero("a"), zero("b")).alias(f"r_{name}"), F.count("*").alias(f"n_{name}"), F.count("a").alias("has"))

    sampled, all_ = compared(second, "sampled"), compared(full, "full").where("has > 0")
    return sampled.join(all_, ["size", "seed"]).select("size", "seed", "r_sampled", "n_sampled", "r_full", "n_full")
