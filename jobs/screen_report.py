"""Report a one-guide screen: hits by replicate, and how far its depth suffices.

A batch job.  It reads the molecule table and the guide library of a folder,
removes over-represented lineages, and writes two tables:

* ``guides``, partitioned by replicate: for each guide its lineages' mean log2
  reporter, its z-score against the control guides, and its rank-test p-value
  and false-discovery rate against all control lineages of the replicate;
* ``saturation``, partitioned by size: correlations of guide scores between half
  screens that were downsampled to that many lineages, for several seeds.

A run overwrites the partitions that it computes (replicates, sizes) and no
others, and everything in it is a function of the tables and settings, samples
included; so running it again gives the same output.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscreen.operators import counts, downsample, ranks, screen
from loomscreen.plans.workflows import validate
from loomscreen.sources.scratch import settled
from loomscreen.spec import ScreenSpec

log = logging.getLogger("jobs.screen_report")

SPEC = ScreenSpec(guides=("guide",), barcodes=("barcode",), identity="identity", reporter="reporter", rep="replicate")
GUIDES = "guide string, gene string, control boolean, lineages long, reporter double, z double, p_value double, fdr double, replicate string"
SATURATION = "seed int, r_sampled double, n_sampled long, r_full double, n_full long, size long"


def library(spark: SparkSession, tables: str, config: dict) -> DataFrame:
    """id and gene of every known guide."""
    rows = spark.read.parquet(f"{tables}/{config['library']}.parquet").select(F.col(config["library_guide"]).alias("id"), F.col(config["gene"]).alias("gene"))
    return rows.where("id is not null and gene is not null").groupBy("id").agg(F.min("gene").alias("gene"))


def molecules(spark: SparkSession, tables: str, config: dict) -> DataFrame:
    """id (of the guide), barcode, replicate, identity and reporter of every row."""
    names = {"id": "guide", "barcode": "barcode", "replicate": "replicate", "identity": "identity", "reporter": "reporter"}
    return spark.read.parquet(f"{tables}/{config['molecules']}.parquet").select(*(F.col(config[c]).alias(name) for name, c in names.items()))


def lineages(rows: DataFrame, known: DataFrame, config: dict) -> DataFrame:
    """One row a lineage of a known guide: its molecule rows, sum ``s`` and number ``c`` of known log2 reporters, half, and its shares.

    Everything that is reported is a function of these rows, so molecule rows
    are grouped once, before their guides get names.  Most lineages have a row or
    two, so rows are dealt as they are, not added up before.
    """
    rows = rows.na.drop(subset=["id", "barcode", "replicate", "reporter"]).repartition("id", "barcode", "replicate")
    rows = screen.log_transform(rows, ["reporter"], config["pseudocount"])
    sums = (F.coalesce(F.sum(t).cast("double"), F.lit(0.0)).alias(t) for t in SPEC.transcripts)
    sums = settled(rows.groupBy("id", "barcode", "replicate").agg(F.count("*").alias("rows"), F.sum("log2_reporter").alias("s"), F.count("log2_reporter").alias("c"), *sums), "report-sums")
    # Settled, so that a few guides' totals are broadcast.
    totals = sums.groupBy(F.col("id").alias("_id")).agg(*(F.sum(t).alias(f"all_{t}") for t in SPEC.transcripts))
    guides = settled(known.join(totals, F.col("id") == F.col("_id")).drop("_id").withColumnRenamed("id", "_id"), "report-guides")
    shares = (F.try_divide(F.col(t), F.col(f"all_{t}")).alias(f"share_{t}") for t in SPEC.transcripts)
    # A task's guides are few beside its lineages, so these aren't sorted.
    few = guides.count() <= counts.TASK_ROWS * int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = sums.join(guides.hint("shuffle_hash") if few else guides, F.col("id") == F.col("_id")).select(F.col("_id").alias("id"), "gene", "barcode", "replicate", "rows", "s", "c", *shares)
    return settled(downsample.halves(named.withColumn("guide", guide()), SPEC.lineage).drop("guide"), "report-lineages")


def guide() -> Column:
    """The name of a guide."""
    return F.concat_ws("_", "gene", F.col("id").cast("string"))


def hits(rows: DataFrame, known: DataFrame, prefix: str) -> DataFrame:
    """One row a guide and replicate, from rows of lineages."""
    # Rounded, so that the order in which a lineage's rows are added up decides no tie.
    rows = rows.select("replicate", "id", "control", F.round(F.try_divide("s", "c"), 9).alias("x"))
    # The controls of a replicate are one group of the test; a guide's lineages are compared with those of their own replicate.
    tested = ranks.mann_whitney_within(rows, "replicate", ["id"], "x", "control")
    tested = screen.set_control(tested.join(known, "id").withColumn("guide", guide()), ["guide"], prefix)
    # Settled, as the controls' scores use it twice.
    tested = settled(tested.select("replicate", "id", "gene", "control", F.col("rows").alias("lineages"), F.col("mean").alias("reporter"), F.col("p").alias("p_value")), "report-tests")
    scored = downsample.control_scores(tested, ["replicate"], F.col("control"), "reporter")
    return ranks.bh_adjust(scored, "p_value", "fdr", "replicate").select(guide().alias("guide"), "gene", "control", "lineages", "reporter", "z", "p_value", "fdr", "replicate")


def run(spark: SparkSession, tables: str, out: str, config: dict) -> tuple[DataFrame, DataFrame]:
    """Write both tables; return them read back."""
    rows, known = molecules(spark, tables, config), library(spark, tables, config)
    found = lineages(rows, known, config)
    read = found.agg(F.sum("rows")).first()[0]
    if read is None:
        validate(rows.join(known, "id").withColumn("guide", guide()), SPEC)
    log.info("read %d molecule rows of known guides from %s", read or 0, tables)
    kept = screen.kept_lineages(found, SPEC, config["share_floor"]).drop(*(f"share_{t}" for t in SPEC.transcripts))
    log.info("kept %d rows of lineages that aren't over-represented", kept.agg(F.sum("rows")).first()[0] or 0)
    kept = screen.set_control(kept.withColumn("guide", guide()), ["guide"], config["control_prefix"])
    grid = downsample.concordance_of(kept.where("c > 0"), SPEC.lineage, ["id", "control"], config["sizes"], config["seeds"], F.col("control"))
    out_tables = []
    for name, table, by, schema in (("guides", hits(kept, known, config["control_prefix"]), "replicate", GUIDES), ("saturation", grid, "size", SATURATION)):
        table.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{out}/{name}")
        out_tables.append(spark.read.schema(schema).parquet(f"{out}/{name}"))
        log.info("%s/%s has %d rows now", out, name, out_tables[-1].count())
    return tuple(out_tables)


if __name__ == "__main__":
    from jobs.cli import main

    main("report a one-guide screen", "screen_report.json", {"tables": "the folder of the molecule and library tables", "out": "the folder of the two reports"}, run)
