"""Running counts, sums and minima over a whole table's order, without gathering the table in one task.

Rows are dealt to ranges of the order and written once, with their range and
their place in it; ranges have a few numbers each, which are summed up and
added back.  The write fixes the ranges: they are sampled, so planning them
twice could give two different sets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import settled

#: Columns of ``ranged`` tables: the range, and a number that grows in the range.
RANGE, PLACE = "_range", "_place"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in sorted ranges of ``order``; equal keys share a range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return settled(rows.withColumns({RANGE: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}), "ranges")


def carried(rows: DataFrame, by: list[str], new: dict[str, tuple[Column, Callable[[Column], Column]]], last_first: bool = False, whole: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """``rows`` with aggregates over all earlier ranges (later ones if ``last_first``) of the same ``by``.

    ``new`` names pairs of (aggregate of a range, how ranges' values add up); null
    where there is no such range.  ``whole`` names pairs that add up over all
    ranges.  The ranges' values are written once; Spark broadcasts them where
    their file is small.
    """
    whole = whole or {}
    sums = rows.groupBy(*by, RANGE).agg(*(once.alias(c) for c, (once, _) in (new | whole).items()))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy(F.desc(RANGE) if last_first else RANGE).rowsBetween(Window.unboundedPreceding, -1)
    added = [over(F.col(c)).over(before).alias(c) for c, (_, over) in new.items()] + [over(F.col(c)).over(group).alias(c) for c, (_, over) in whole.items()]
    sums = settled(sums.select(*(F.col(c).alias(f"_of_{c}") for c in [*by, RANGE]), *added), "sums")
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, RANGE]))
    return rows.join(sums, same).drop(*(f"_of_{c}" for c in [*by, RANGE]))


def numbered(df: DataFrame, order: str, name: str = "rec_no") -> DataFrame:
    """Rows numbered 1, 2, ... in the order of a column; equal keys in any order."""
    rows = carried(ranged(df, order), [], {"_before": (F.count("*"), F.sum)})
    # The place starts at the range's number times 2 ** 33.
    place = F.col(PLACE) - F.col(RANGE).cast("long") * F.lit(1 << 33)
    return rows.withColumn(name, place + F.coalesce("_before", F.lit(0)) + 1).drop(RANGE, PLACE, "_before")


def nearest(points: DataFrame, centres: DataFrame, x: str, centre: str, name: str) -> DataFrame:
    """``points`` with the name of the centre (columns ``centre``, ``name``) nearest to ``x``, ties to the lesser name; null without a known x or any centre.

    Points and centres stand in one order, so the nearest is the last centre
    before a point or the first one after it; no pairs are made.
    """
    one = centres.where(F.col(centre).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(centre).cast("double").alias("c")).agg(F.min(name).alias("k"))
    known = points.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("at"), F.struct(*points.columns).alias("row"), F.lit(None).cast(one.select(F.struct("c", "k").alias("s")).schema["s"].dataType).alias("s"))
    # A hash deals points at one place over several ranges.
    both = known.unionByName(one.select(F.col("c").alias("at"), F.lit(None).cast(known.schema["row"].dataType).alias("row"), F.struct("c", "k").alias("s"))).withColumn("_tie", F.xxhash64("row"))
    rows = carried(ranged(both, "at", "_tie"), [], {"_below": (F.max("s"), F.max)})
    rows = carried(rows, [], {"_above": (F.min("s"), F.min)}, last_first=True)
    here = Window.partitionBy(RANGE).orderBy(PLACE)
    below = F.greatest("_below", F.max("s").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    above = F.least("_above", F.min("s").over(here.rowsBetween(0, Window.unboundedFollowing)))
    found = rows.withColumns({"_b": below, "_a": above}).where("row is not null")
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.c")).alias("d"), F.col(f"{c}.k").alias("k")))
    found = found.select("row.*", F.least(away("_b"), away("_a"))["k"].alias(name))
    return found.unionByName(points.where(F.col(x).isNull()).withColumn(name, F.lit(None).cast(one.schema["k"].dataType)))
