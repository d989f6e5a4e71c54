"""The steps of a screen, each a function from DataFrame to DataFrame.

Scalars that a step needs over the whole table (thresholds, ranges, control
means) are one-row aggregates joined by a broadcast of that one row.  Such a
table is used twice, so tables that are costly to make and small beside the
rows (lineages, guides) are settled first: written to the scratch folder and
read again, instead of being worked out from the rows twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import field
from ..sources.scratch import settled
from ..spec import ScreenSpec
from .counts import present


def with_scalars(df: DataFrame, *scalars: Column) -> DataFrame:
    """``df`` with aggregates over all its rows as columns."""
    return df.crossJoin(F.broadcast(df.agg(*scalars)))


def with_representation(df: DataFrame, rep: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a representation table; its numbers are 0 where it lacks the guide, texts stay null."""
    joined = df.join(rep, keys, "left")
    numbers = [f.name for f in rep.schema.fields if f.name not in keys and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    return joined.na.fill(0, subset=numbers) if numbers else joined


def lineage_shares(df: DataFrame, spec: ScreenSpec) -> DataFrame:
    """For each lineage and transcript, its share of the guide's total; null where that is 0."""
    sums = present(df, spec.lineage).groupBy(*spec.lineage).agg(*(F.coalesce(F.sum(t).cast("double"), F.lit(0.0)).alias(t) for t in spec.transcripts))
    sums = settled(sums, "lineages")
    # A sum and a join, not a window: a guide with many lineages is summed before the shuffle, and its join can be split.
    # The totals are settled too, so that a few guides' are broadcast and many lineages stay where they are.
    totals = settled(sums.groupBy(*spec.guides).agg(*(F.sum(t).alias(f"all_{t}") for t in spec.transcripts)), "totals")
    return sums.join(totals, list(spec.guides)).select(*spec.lineage, *(F.try_divide(F.col(t), F.col(f"all_{t}")).alias(f"share_{t}") for t in spec.transcripts))


def filter_lineages(df: DataFrame, spec: ScreenSpec, floor: float | None = 0.05) -> DataFrame:
    """Rows of lineages that aren't over-represented in any transcript.

    A lineage is kept if each share is under the mean plus three standard
    deviations of all shares (null as 0), or under ``floor`` if that is more.
    The rows are read twice: settle them first if they are costly to make.
    """
    shares = settled(lineage_shares(df, spec), "shares")
    limits, under = _limits(spec, floor)
    # Most lineages are kept, so the few others are joined: every known lineage of the rows has shares.
    gone = settled(with_scalars(shares, *limits).where(~under).select(*spec.lineage), "gone")
    return present(df, spec.lineage).join(gone, spec.lineage, "left_anti")


def kept_lineages(shares: DataFrame, spec: ScreenSpec, floor: float | None = 0.05) -> DataFrame:
    """As ``filter_lineages``, of a settled table with a row and the shares of each lineage."""
    limits, under = _limits(spec, floor)
    return shares.crossJoin(F.broadcast(settled(shares.agg(*limits), "limits"))).where(under).select(*shares.columns)


def _limits(spec: ScreenSpec, floor: float | None) -> tuple[list[Column], Column]:
    """Aggregates that limit the shares, and whether a lineage is under them all."""
    names = [f"share_{t}" for t in spec.transcripts]
    limits = []
    for n in names:
        x = F.coalesce(n, F.lit(0.0))
        limit = F.avg(x) + 3 * F.stddev_samp(x)
        limits.append((F.greatest(limit, F.lit(floor)) if floor is not None else limit).alias(f"limit_{n}"))
    return limits, F.coalesce(reduce(Column.__and__, (F.col(n) < F.col(f"limit_{n}") for n in names)), F.lit(False))


def log_transform(df: DataFrame, columns: list[str], pseudocount: float = 10) -> DataFrame:
    return df.withColumns({f"log2_{c}": F.log2(F.col(c) + F.lit(float(pseudocount))) for c in columns})


def set_control(df: DataFrame, guides: list[str], prefix: str = "non") -> DataFrame:
    """``control``: every guide starts with the prefix."""
    return df.withColumn("control", F.coalesce(reduce(Column.__and__, (F.col(g).startswith(prefix) for g in guides)), F.lit(False)))


def guide_ids(df: DataFrame, guides: list[str], order: str, separator: str = "_", gene_position: int = 0) -> DataFrame:
    """``guide``, ``gene`` and ``guide_id`` of all distinct guides.

    A gene with one guide keeps its bare name; others are numbered from 1 by
    the guides' least ``order``, then their names.
    """
    rows = reduce(DataFrame.unionByName, (df.select(F.col(g).alias("guide"), F.col(order).alias("seen")) for g in guides))
    first = present(rows, ["guide"]).groupBy("guide").agg(F.min("seen").alias("seen")).withColumn("gene", field(F.col("guide"), separator, gene_position))
    by_gene = Window.partitionBy("gene")
    number = F.row_number().over(by_gene.orderBy("seen", "guide"))
    alone = F.count("*").over(by_gene) == 1
    return first.select("guide", "gene", F.when(alone, F.col("gene")).otherwise(F.concat_ws(separator, "gene", number.cast("string"))).alias("guide_id"))


def relabel(df: DataFrame, column: str, ids: DataFrame, key: str = "guide", value: str = "guide_id") -> DataFrame:
    """Replace the values of a column that ``ids`` knows; others stay."""
    names = ids.select(F.col(key).alias(column), F.col(value).alias("_new"))
    return df.join(names, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def one_hot(df: DataFrame, columns: list[str], values: dict[str, list] | None = None) -> tuple[DataFrame, list[str]]:
    """A 0/1 column for every value of each column, and the new columns' names.

    Values are looked up unless given: sample columns have few.
    """
    made: dict[str, Column] = {}
    for c in columns:
        found = values[c] if values else [r[0] for r in df.select(c).distinct().orderBy(c).collect() if r[0] is not None]
        made |= {f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1).otherwise(0) for v in found}
    return df.withColumns(made), list(made)


def rescale(df: DataFrame, column: str, lo: Column, hi: Column, name: str) -> DataFrame:
    """Linear map of the column's range to lo .. hi (columns may refer to aggregates of the same table)."""
    x = with_scalars(df, F.min(column).alias("_a"), F.max(column).alias("_b"))
    return x.withColumn(name, F.try_divide(F.col(column) - F.col("_a"), F.col("_b") - F.col("_a")) * (hi - lo) + lo).drop("_a", "_b")


def control_z(df: DataFrame, value: str, name: str, control: str = "control") -> DataFrame:
    """Distance from the controls' mean in their standard deviations."""
    of_control = F.when(F.col(control), F.col(value))
    x = with_scalars(df, F.avg(of_control).alias("_m"), F.stddev_samp(of_control).alias("_s"))
    return x.withColumn(name, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def summary(df: DataFrame, spec: ScreenSpec, identity: str, reporter: str, rep: str | None = None, pseudocount: float = 1e-7) -> DataFrame:
    """One row a guide or pair: identity as a log2 fold change of shares over ``rep`` (else the mean), reporter mean, and both z-scores."""
    rows = present(df, list(spec.guides))
    x = F.col(identity)
    if "rescaled" not in identity:
        scaled = with_scalars(rows, F.min(identity).alias("_a"), F.max(identity).alias("_b"))
        rows = scaled.withColumn(identity, F.when(F.col("_a") < 0, F.try_divide(x - F.col("_a"), F.col("_b") - F.col("_a"))).otherwise(x)).drop("_a", "_b")
    keys = [*spec.guides, "control"]
    if rep:
        # A guide has one representation; its reporter mean is over all its rows.
        sums = settled(rows.groupBy(*keys, rep).agg(F.sum(identity).alias("_s"), F.avg(reporter).alias("reporter")), "guides")
        out = with_scalars(sums, F.sum("_s").alias("_all")).withColumn("identity", F.log2(F.col("_s") / F.col("_all") + pseudocount) - F.log2(F.col(rep) + pseudocount)).drop("_s", "_all")
    else:
        out = settled(rows.groupBy(*keys).agg(F.avg(identity).alias("identity"), F.avg(reporter).alias("reporter")), "guides")
    return control_z(control_z(out, "identity", "identity_z"), "reporter", "reporter_z")
