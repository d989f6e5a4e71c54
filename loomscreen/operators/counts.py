"""Counting molecules, lineages and guides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all known: groups never have a null key."""
    return df.na.drop(subset=keys)


#: Rows that a task of a spread table has at most, about; tables of up to four times as many are left to Spark.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks whose number grows with ``rows``, so that no task's memory does.

    Joins and groups by more keys than these need no further exchange.
    """
    if rows <= 4 * TASK_ROWS:
        return df
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def umi_collapse(reads: DataFrame, lineage: list[str], umi: str, transcript: str, kinds: dict[str, str]) -> DataFrame:
    """Distinct molecules of each transcript for each lineage, zero where it has none.

    ``kinds``: output column -> value of ``transcript``.  First the distinct
    (lineage, transcript, molecule) rows, then plain counts of them: two hash
    aggregations with map-side combine, and no expansion of rows for several
    distinct counts.
    """
    rows = present(reads, [*lineage, umi, transcript]).where(F.col(transcript).isin(*kinds.values()))
    once = rows.select(*lineage, transcript, umi).distinct()
    return once.groupBy(*lineage).agg(*(F.count_if(F.col(transcript) == v).alias(c) for c, v in kinds.items()))


def sketches(df: DataFrame, keys: list[str], value: Column | str, size: int = 12, name: str = "sketch") -> DataFrame:
    """One mergeable sketch of the distinct values (long, text or binary) of each group, of 2^size registers at most.

    Sketches can be written by sample and day and merged later without the
    rows.  A merged count has a standard error of 1.04 / 2^(size / 2).
    """
    return present(df, keys).groupBy(*keys).agg(F.hll_sketch_agg(value, size).alias(name))


def merged(stored: DataFrame, keys: list[str], name: str = "sketch", count: str = "n") -> DataFrame:
    """The union of stored sketches for each group of coarser keys, and its estimated number of distinct values."""
    return stored.groupBy(*keys).agg(F.hll_union_agg(name).alias(name)).withColumn(count, F.hll_sketch_estimate(name))


def measurement_counts(df: DataFrame, guides: list[str], lineage: list[str]) -> DataFrame:
    """Distinct lineages of each guide or pair."""
    return present(df, lineage).select(*lineage).distinct().groupBy(*guides).agg(F.count("*").alias("n_lineages"))


def representation(df: DataFrame, guides: list[str], name: str = "repr") -> DataFrame:
    """Share of all rows that each guide has."""
    counts = present(df, guides).groupBy(*guides).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*guides, (F.col("n") / F.col("total")).alias(name))


def pseudobulk(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums of the measures by group."""
    return present(df, keys).groupBy(*keys).agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures))


def at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups of n rows or more."""
    large = present(df, keys).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(*keys)
    return df.join(large, keys, "left_semi")
