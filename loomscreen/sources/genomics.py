"""Text records of variant callers and aligners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def variants(lines: DataFrame) -> DataFrame:
    """chrom, pos, id, info (map), svtype, support and read names of VCF lines (column value)."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 8)).select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), f[2].alias("id"), F.str_to_map(f[7], F.lit(";"), F.lit("=")).alias("info"))
    get = lambda k: F.try_element_at("info", F.lit(k))
    return rows.select("*", get("SVTYPE").alias("svtype"), get("SUPPORT").try_cast("long").alias("support"), F.split(get("RNAMES"), ",").alias("reads"))


def alignments(lines: DataFrame, exclude: int = 256 | 2048) -> DataFrame:
    """qname, flag and the line of primary SAM records."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).select(f[0].alias("qname"), f[1].try_cast("int").alias("flag"), "value")
    return rows.where(F.col("flag").bitwiseAND(F.lit(exclude)) == 0)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def variant_reads(v: DataFrame) -> DataFrame:
    """Distinct names of reads that support a variant."""
    return v.select(F.explode("reads").alias("qname")).where("qname <> ''").distinct()


def variant_report(v: DataFrame, a: DataFrame) -> DataFrame:
    """One row: variants by kind and support, supporting reads (instances and distinct), all reads, and percentages cut to 2 digits."""
    kinds = v.agg(
        *(F.count_if(F.col("svtype") == k).alias(k) for k in ("DEL", "INS", "DUP", "INV", "BND")),
        F.count_if(F.col("support") == 1).alias("single"), F.count_if((F.col("support") > 1) & (F.col("support") <= 5)).alias("few"), F.count_if(F.col("support") > 5).alias("many"), F.coalesce(F.sum("support"), F.lit(0)).alias("instances"),
    )
    reads = a.select("qname").distinct()
    supporting = variant_reads(v).agg(F.count("*").alias("supporting"))
    total = reads.agg(F.count("*").alias("reads"))
    out = kinds.crossJoin(supporting).crossJoin(total)
    cut = lambda c: (F.floor(F.try_divide(F.col(c) * 10000.0, F.col("reads"))) / 100)
    return out.withColumns({"pct_instances": cut("instances"), "pct_reads": cut("supporting")})


def without_variants(a: DataFrame, v: DataFrame) -> DataFrame:
    """Alignments of reads that support no variant."""
    return a.join(variant_reads(v), "qname", "left_anti")


def report_numbers(text: DataFrame, names: list[str]) -> DataFrame:
    """``name: number`` entries of whole text reports (column value)."""
    return text.select(*(F.regexp_extract("value", rf"{n}:\s+(\d+)", 1).try_cast("long").alias(n.lower().replace(" ", "_")) for n in names))
