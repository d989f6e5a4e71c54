"""Finished screens and cell populations as folders of Parquet tables.

A screen is a folder with one Parquet table for each of its parts and
``spec.parquet``, one row with the columns' roles.  A cell population is three
tables: ``cells`` (one row a cell), ``genes`` (one row a gene) and ``counts``,
the matrix kept long (cell, gene, n; zeros absent).  Both are read lazily, by
any engine that reads Parquet, and run nobody's code when they are opened.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import ScreenSpec

_SPEC = "guides array<string>, barcodes array<string>, identity string, reporter string, samples array<string>, rep string"


def save_screen(path: str, spec: ScreenSpec, **tables: DataFrame) -> None:
    """Write a screen's tables under their names, and its spec; a folder that exists is an error."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    row = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(spec).items()}
    spark.createDataFrame([row], _SPEC).coalesce(1).write.parquet(f"{path}/spec.parquet")


def load_screen(spark: SparkSession, path: str, *names: str) -> tuple[ScreenSpec, dict[str, DataFrame]]:
    """The spec and the named tables."""
    row = spark.read.parquet(f"{path}/spec.parquet").first().asDict()
    spec = ScreenSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()})
    return spec, {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


@dataclass(frozen=True)
class Population:
    cells: DataFrame  # cell, and what is known of it
    genes: DataFrame  # gene, and what is known of it
    counts: DataFrame  # cell, gene, n

    def save(self, path: str) -> None:
        for name in ("cells", "genes", "counts"):
            getattr(self, name).write.parquet(f"{path}/{name}.parquet")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Population:
        return cls(*(spark.read.parquet(f"{path}/{name}.parquet") for name in ("cells", "genes", "counts")))

    def where(self, condition: str) -> Population:
        """The cells that meet a condition, with their counts."""
        cells = self.cells.where(condition)
        return Population(cells, self.genes, self.counts.join(cells.select("cell"), "cell", "left_semi"))

    def per_group(self, by: str) -> DataFrame:
        """Counts of every gene summed over each group's cells."""
        return self.counts.join(self.cells.select("cell", by), "cell").groupBy(by, "gene").agg(F.sum("n").alias("n"))
