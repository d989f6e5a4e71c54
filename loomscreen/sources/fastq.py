"""Sequencing records from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks
from .scratch import settled


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, rec_no, name, seq, qual of every record of the (gzipped) files at ``path``.

    A plainly gzipped file is one split, as it can't be read from its middle;
    block-compressed ones are read in splits by ``block_records``.
    """
    return assembled(placed_lines(spark, path))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of text files with their file, split (at) and a number that grows in the split (m)."""
    place = {"file": F.col("_metadata.file_path"), "at": F.col("_metadata.file_block_start"), "m": F.monotonically_increasing_id()}
    return spark.read.text(path).withColumns(place)


def block_records(spark: SparkSession, path: str, split_bytes: int = blocks.SPLIT_BYTES) -> DataFrame:
    """As ``records``, of block-compressed files, each read in splits of about so many compressed bytes."""
    return assembled(blocks.lines(spark, path, split_bytes))


def assembled(lines: DataFrame) -> DataFrame:
    """Records from lines (file, at: their split, m: a number that grows in the split, value).

    Lines are written once with their split and their place in it.  A split's
    lines before it come from the splits' counts, so a file is never sorted or
    numbered in one task.  A record whose header lacks '@' raises.
    """
    rec = _fours(lines)
    bad = F.raise_error(F.concat(F.lit("a record's header doesn't start with @: "), F.coalesce("header", F.lit(""))))
    name = F.when(F.col("header").startswith("@"), F.substring(F.col("header"), 2, 1 << 20)).otherwise(bad.cast("string"))
    return rec.select("file", "rec_no", name.alias("name"), "seq", "qual")


def faulty(lines: DataFrame) -> DataFrame:
    """file and rec_no of the records whose header lacks '@', instead of an error."""
    return _fours(lines).where(~F.coalesce(F.col("header").startswith("@"), F.lit(False))).select("file", "rec_no")


def _fours(lines: DataFrame) -> DataFrame:
    lines = settled(lines, "lines")
    splits = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "at", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    n = lines.join(splits, ["file", "at"]).withColumn("line", F.col("m") + F.col("shift"))
    rec = n.groupBy("file", F.floor(F.col("line") / 4).alias("rec_no")).agg(*(F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("header", "seq", "plus", "qual"))))
    return rec


def header_fields(df: DataFrame) -> DataFrame:
    """lane, tile, x, y and umi from a record's name."""
    part = lambda i: F.split_part("name", F.lit(":"), F.lit(i + 1))
    return df.withColumns({"lane": part(3), "tile": part(4), "x": part(5), "y": part(6), "umi": F.split_part(part(7), F.lit(" "), F.lit(1))})


def mates(*reads: DataFrame) -> DataFrame:
    """Join the records of several files by number; columns get suffixes 1, 2, ..."""
    out = None
    for k, r in enumerate(reads, 1):
        x = r.select("rec_no", *(F.col(c).alias(f"{c}{k}") for c in ("name", "seq", "qual")))
        out = x if out is None else out.join(x, "rec_no")
    return out
