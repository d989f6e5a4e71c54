"""Star-schema tables in the roles of a screen's tables, in Spark and as SQL.

Each function has a CTE of the same name and rows in ``CTES``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import letters_as_bases
from ..operators.counts import spread
from ..spec import ScreenSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONTROL = "NATION_2"
DUAL = ScreenSpec(guides=("p1", "p2"), barcodes=("barcode",), identity="ident", reporter="report", samples=("sample",), rep="rep")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-guide molecule table: p1, p2, barcode, rep, sample, ident, report."""
    t = lambda name: read(spark, sf_dir, name)
    side = lambda keyed, key, name: t(keyed).join(t("nation"), F.col(f"{key[0]}_nationkey") == F.col("n_nationkey")).select(key, F.col("n_name").alias(name))
    lines = t("lineitem")
    n = lines.count()
    orders = spread(t("orders").join(side("customer", "c_custkey", "p2"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "p2"), n, "o_orderkey")
    # The last join is by order, so rows of a lineage are together from then on.
    lines = lines.select("l_orderkey", "l_suppkey", "l_linestatus", "l_linenumber", "l_quantity", "l_extendedprice").join(side("supplier", "s_suppkey", "p1"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = spread(lines, n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("p1", "p2", F.col("l_orderkey").alias("barcode"), F.col("l_linestatus").alias("rep"), F.col("l_linenumber").alias("sample"), F.col("l_quantity").alias("ident"), F.col("l_extendedprice").alias("report"))


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-guide table: guide, gene, barcode, rep, ident, report."""
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.concat_ws("_", "p_brand", F.col("l_partkey").cast("string")).alias("guide"), F.col("p_brand").alias("gene"), F.col("l_orderkey").alias("barcode"), F.col("l_linestatus").alias("rep"), F.col("l_quantity").alias("ident"), F.col("l_extendedprice").alias("report"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read table: cell, kind, umi, transcript, value."""
    transcript = F.when(F.col("event_type").isin("click", "view"), "identity").otherwise("reporter")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("kind"), (F.col("event_id") % 97).alias("umi"), transcript.alias("transcript"), "value", "event_id")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of the documents as bases: doc_id, seq."""
    return read(spark, sf_dir, "documents").select("doc_id", letters_as_bases(F.col("text"), LETTERS, BASES).alias("seq"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long guide matrix: i, j, v (mean log2 reporter); cells of fewer than 60 rows are missing."""
    return dual(spark, sf_dir).groupBy("p1", "p2").agg(F.avg(F.log2(F.col("report") + 10)).alias("v"), F.count("*").alias("n")).where("n >= 60").select(F.col("p1").alias("i"), F.col("p2").alias("j"), "v")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a long matrix: i (vec_id), j (place), v, label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), "label", F.posexplode("embedding").alias("j", "v")).withColumn("v", F.col("v").cast("double"))


#: Fixed values of the analog sequences: letters and the bases that they stand for.
LETTERS, BASES = "EIOULRSDBFHJKMPQVWXYZ", "ACGTACGTTAACGTACGTNAC"

CTES = {
    "dual": """dual AS (SELECT sn.n_name AS p1, cn.n_name AS p2, l_orderkey AS barcode, l_linestatus AS rep, l_linenumber AS sample, l_quantity AS ident, l_extendedprice AS report
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey)""",
    "single": """single AS (SELECT concat(p_brand, '_', l_partkey) AS guide, p_brand AS gene, l_orderkey AS barcode, l_linestatus AS rep, l_quantity AS ident, l_extendedprice AS report
      FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "reads": """reads AS (SELECT user_id AS cell, event_type AS kind, event_id % 97 AS umi, CASE WHEN event_type IN ('click', 'view') THEN 'identity' ELSE 'reporter' END AS transcript, value, event_id FROM events)""",
    "sequences": f"""sequences AS (SELECT doc_id, translate(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}'), 'N', 'G') AS seq FROM documents)""",
    "cells": """cells AS (SELECT p1 AS i, p2 AS j, avg(log2(report + 10)) AS v FROM dual GROUP BY 1, 2 HAVING count(*) >= 60)""",
    "grid": """grid AS (SELECT vec_id AS i, label, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
}
_NEEDS = {"cells": ["dual"]}


def query(sql: str | None = None, uses: str = ""):
    """Register a query; ``uses`` names the CTEs that its SQL starts from."""

    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            names = list(dict.fromkeys(n for u in uses.split() for n in [*_NEEDS.get(u, []), u]))
            head = ", ".join(CTES[n] for n in names)
            body = sql.strip()
            if head:
                body = f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
            ORACLES[f.__name__] = body
        return f

    return take
