"""Count molecules of new reads: an incremental job.

Reads come as Parquet files in a folder that grows (a text column of bases, or
of letters that stand for bases, and the sample's name).  Each run takes the
files that the checkpoint doesn't know yet, calls guide, barcode and molecule of
each read, and brings two tables up to date:

* ``reads``, partitioned by batch and sample: reads of each molecule in one
  batch of files;
* ``molecules``, partitioned by sample: reads and distinct molecules of each
  guide and barcode so far.

A batch that is run again (a lost driver, a failed write) overwrites its own
partitions of ``reads``, and ``molecules`` is worked out from ``reads`` for the
samples of the batch and overwritten sample by sample, so no read counts twice
and a run without new files changes nothing.  Only samples that a batch holds
are counted again, from their molecules, never from their reads.

Reads without a guide, with a barcode or molecule of the wrong length, or with
an unknown base in either are left out.  A null or empty sample is named by
``unassigned``.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscreen.functions import sequences as sq

log = logging.getLogger("jobs.molecules")

COUNTS = "guide string, barcode string, molecules long, reads long, sample string"
CALLED = "guide string, barcode string, molecule string, reads long, batch long, sample string"


def called(reads: DataFrame, config: dict) -> DataFrame:
    """sample, guide, barcode and molecule of each read; empty or null where a part can't be called."""
    x = F.col(config["sequence"])
    seq = sq.letters_as_bases(x, config["letters"], config["bases"]) if config["letters"] else F.upper(x)

    def part(place: list[int], column: str = "seq"):
        start, stop = place
        bases = sq.slice_of(F.col(column), start, stop)
        return F.when((F.length(bases) == stop - start) & ~bases.contains("N"), bases)

    sample = F.coalesce(F.nullif(F.col(config["sample"]).cast("string"), F.lit("")), F.lit(config["unassigned"]))
    rows = reads.select(sample.alias("sample"), seq.alias("seq"))
    return rows.select("sample", sq.tolerant_guide(F.col("seq"), config["motif"]).alias("guide"), sq.revcomp(part(config["barcode"])).alias("barcode"), part(config["molecule"]).alias("molecule"))


def written(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite the partitions that ``df`` has rows of, and no others; Spark splits large ones into several files."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take_batch(batch: DataFrame, number: int, out: str, config: dict) -> int:
    """Add one batch of new reads to both tables; the number of its reads."""
    spark, seen = batch.sparkSession, batch.count()
    usable = called(batch, config).where("guide <> '' and barcode is not null and molecule is not null")
    counts = usable.groupBy("sample", "guide", "barcode", "molecule").agg(F.count("*").alias("reads"))
    written(counts.withColumn("batch", F.lit(number).cast("long")), f"{out}/reads", ["batch", "sample"])
    all_reads = spark.read.schema(CALLED).parquet(f"{out}/reads")
    mine = all_reads.where(F.col("batch") == number)
    kept = mine.agg(F.coalesce(F.sum("reads"), F.lit(0))).first()[0]
    log.info("batch %d: read %d reads, wrote %d of them to %s/reads", number, seen, kept, out)
    if kept:
        # Both columns are partitions, so other samples' files aren't opened.
        touched = mine.select("sample").distinct()
        once = all_reads.join(touched, "sample", "left_semi").groupBy("sample", "guide", "barcode", "molecule").agg(F.sum("reads").alias("reads"))
        written(once.groupBy("sample", "guide", "barcode").agg(F.count("*").alias("molecules"), F.sum("reads").alias("reads")), f"{out}/molecules", ["sample"])
        log.info("batch %d: wrote %d lineages to %s/molecules", number, table(spark, out).join(touched, "sample", "left_semi").count(), out)
    return seen


def run(spark: SparkSession, reads: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Take what is new in ``reads``; return the molecule table as it stands."""
    schema = spark.read.parquet(reads).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(reads)
    taken: list[int] = []
    query = (
        stream.select(config["sample"], config["sequence"]).writeStream.foreachBatch(lambda batch, number: taken.append(take_batch(batch, number, out, config)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    log.info("took %d new reads of %s in %d batches", sum(taken), reads, len(taken))
    return table(spark, out)


def table(spark: SparkSession, out: str) -> DataFrame:
    """The molecule table: guide, barcode, molecules, reads, sample."""
    try:
        return spark.read.schema(COUNTS).parquet(f"{out}/molecules")
    except Exception as e:  # no batch had a usable read yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], COUNTS)


if __name__ == "__main__":
    from jobs.cli import main

    main(
        "count molecules of new reads", "molecules.json",
        {"reads": "the folder (or glob) of Parquet files of reads", "out": "the folder of the two tables", "checkpoint": "the folder that remembers which files were taken"}, run,
    )
