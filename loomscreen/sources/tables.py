"""Delimited tables in, delimited tables out."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Collection, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV or TSV of a known schema; NaN and inf become null."""
    df = spark.read.schema(schema).option("header", header).option("sep", sep).option("mode", "FAILFAST").csv(path)
    numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in numbers}) if numbers else df


def read_named(spark: SparkSession, pattern: str, schema: str, key: str, name: str, sep: str = ",") -> DataFrame:
    """Files by a glob, with a key taken from each file's name by a regular expression's first group."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(pattern)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), key, 1).alias(name))


def samples(spark: SparkSession, pattern: str) -> DataFrame:
    """The folders that hold files of the glob, sorted."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("sample")).distinct().orderBy("sample")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    """The place of a cell's column from its reference: A is 0, AA is 26."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _words(element: ET.Element) -> str:
    """A string's text without its phonetic reading: plain or in runs."""
    return "".join(t.text or "" for e in element if e.tag != f"{_SHEET}rPh" for t in e.iter(f"{_SHEET}t"))


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """Number (from 0) and cells of each row of an Office Open XML workbook's sheet, by name or place; rows are read one after another."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = [(e.get("name"), e.get(f"{_RELATION}id")) for e in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")]
        chosen = sheets[sheet] if isinstance(sheet, int) else next((s for s in sheets if s[0] == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r} among {[s[0] for s in sheets]}")
        target = next(e.get("Target") for e in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if e.get("Id") == chosen[1])
        shared = [_words(e) for e in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        number = -1
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_SHEET}row":
                    continue
                number = int(row.get("r", number + 2)) - 1
                cells: list[str | None] = []
                for c in row.iter(f"{_SHEET}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, inline = c.find(f"{_SHEET}v"), c.find(f"{_SHEET}is")
                    text = _words(inline) if inline is not None else value.text if value is not None else None
                    kind = c.get("t")
                    cells[at] = shared[int(text)] if kind == "s" and text is not None else {"1": "true", "0": "false"}.get(text) if kind == "b" else None if kind == "e" else text
                row.clear()
                yield number, cells


def read_spreadsheet(spark: SparkSession, path: str, schema: str, sheet: str | int = 0, skip: int | Collection[int] = 0) -> DataFrame:
    """Workbooks (.xlsx) of a path or glob, one a task, by the names in the header row; numbers are cast, errors and empty cells are null.

    ``skip``: how many rows come before the header, or the numbers (from 0) of
    rows to leave out.  Blank rows are left out.  A workbook that lacks a column
    of the schema is an error.
    """
    fields = spark.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                header, found = None, []
                for number, cells in sheet_rows(content, sheet):
                    if number < skip if isinstance(skip, int) else number in skip:
                        continue
                    if header is None:
                        header = {name: k for k, name in reversed(list(enumerate(cells))) if name}
                        if missing := [n for n in names if n not in header]:
                            raise ValueError(f"no columns {missing} among {list(header)}")
                    elif any(x is not None for x in cells):
                        found.append([cells[header[n]] if header[n] < len(cells) else None for n in names])
                    if len(found) >= 10_000:
                        yield pd.DataFrame(found, columns=names, dtype=object)
                        found = []
                yield pd.DataFrame(found, columns=names, dtype=object)

    texts = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, texts)
    whole = ("byte", "short", "integer", "long")
    return df.select(*((F.col(f"`{f.name}`").try_cast("double") if f.dataType.typeName() in whole else F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in fields))


def write_table(df: DataFrame, path: str, rows_per_file: int = 2_000_000, mode: str = "error", general: list[str] | None = None) -> None:
    """CSV with a header, in files of bounded size; ``general`` columns are written in the shortest form."""
    out = df.withColumns({c: F.format_string("%s", F.regexp_replace(F.format_string("%.6g", F.col(c)), r"(\.\d*?)0+(e|$)", "$1$2")) for c in general}) if general else df
    out.write.mode(mode).option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def symbols(df: DataFrame, mapping: DataFrame, overrides: DataFrame | None = None, key: str = "gene") -> DataFrame:
    """Names for ids from a mapping table (id, symbol): overrides first, then the mapping, then the id itself."""
    maps = mapping.select("id", "symbol", F.lit(1).alias("_r"))
    if overrides is not None:
        maps = maps.unionByName(overrides.select("id", "symbol", F.lit(0).alias("_r")))
    best = maps.groupBy("id").agg(F.min_by("symbol", F.struct("_r", "symbol")).alias("symbol"))
    return df.join(best.withColumnRenamed("id", key), key, "left").withColumn("symbol", F.coalesce("symbol", F.col(key).cast("string")))
