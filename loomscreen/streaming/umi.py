"""Molecule counts from a stream of read tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New CSV files of a folder as they come."""
    return spark.readStream.schema(schema).option("header", True).csv(path)


def molecule_counts(reads: DataFrame, lineage: list[str], umi: str = "UMI", event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Distinct molecules of each lineage so far; with an event time, molecules are forgotten once their repeats would be later than ``late``."""
    rows = reads.na.drop(subset=[*lineage, umi])
    keys = [*lineage, umi]
    if event_time:
        once = rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    else:
        once = rows.dropDuplicates(keys)
    return once.groupBy(*lineage).agg(F.count("*").alias("molecules"))
