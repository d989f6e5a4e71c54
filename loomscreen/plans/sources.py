"""Round trips through files, and whole workflows, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import matrix, recall, running, screen, views
from ..sources import blocks, fastq, tables
from ..sources.scratch import folder, settled
from . import workflows
from .analogs import CONTROL, DUAL, cells, dual, query, read, sequences, single
from .sequencing import RC, SECOND, TOLERANT


def _written(spark, df, name, **options):
    path = folder(spark, name)
    df.write.options(**options).csv(path)
    return path


@query("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def src1_snk1_csv_round_trip(spark, d):
    path = folder(spark, "csv")
    tables.write_table(read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, rows_per_file=1000)
    return tables.read_table(spark, path, "c_custkey long, c_name string, c_acctbal double").withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("SELECT s_name AS _c0, s_suppkey AS _c1 FROM supplier")
def src2_headerless(spark, d):
    path = _written(spark, read(spark, d, "supplier").select("s_name", "s_suppkey"), "headerless")
    return tables.read_table(spark, path, "_c0 string, _c1 long", header=False)


@query("SELECT event_id, event_type FROM events")
def src3_tab_separated(spark, d):
    path = _written(spark, read(spark, d, "events").select("event_id", "event_type"), "tsv", sep="\t")
    return tables.read_table(spark, path, "event_id long, event_type string", header=False, sep="\t")


@query("SELECT user_id, sum(event_id)::BIGINT AS total FROM events GROUP BY 1")
def src4_table_with_index(spark, d):
    path = _written(spark, read(spark, d, "events").select("event_id", "user_id"), "indexed", sep="\t", header=True)
    return tables.read_table(spark, path, "event_id long, user_id long", sep="\t").groupBy("user_id").agg(F.sum("event_id").alias("total"))


@query("SELECT n_regionkey AS key, count(*) AS n FROM nation GROUP BY 1")
def src19_key_from_file_name(spark, d):
    base = folder(spark, "named")
    n = read(spark, d, "nation").select("n_name", "n_regionkey")
    n.write.partitionBy("n_regionkey").option("header", True).csv(base)
    files = spark.read.schema("n_name string").option("header", True).csv(f"{base}/*/*.csv")
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"n_regionkey=(\d+)", 1).cast("int").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def _records(spark, d):
    path = folder(spark, "fastq")
    p = read(spark, d, "pages")
    seq = F.translate(F.upper(F.regexp_replace("url", "[^A-Za-z]", "")), "EIOULRSDBFHJKMPQVWXYZ", "ACGTACGTTAACGTACGTNAC")
    name = F.concat(F.lit("i:1:f:3:4:"), F.col("page_id").cast("string"), F.lit(":9:U"), F.col("page_id").cast("string"))
    p.select(sq.fastq_text(name, seq, sq.masked_quality(seq)).alias("value")).repartition(3).write.option("compression", "gzip").text(path)
    return fastq.records(spark, path)


_SEQ = "translate(upper(regexp_replace(url, '[^A-Za-z]', '', 'g')), 'EIOULRSDBFHJKMPQVWXYZ', 'ACGTACGTTAACGTACGTNAC')"


@query(f"SELECT {_SEQ} AS seq, translate({_SEQ}, 'ACGTN', 'IIII!') AS qual FROM pages")
def src8_snk5_fastq_round_trip(spark, d):
    return _records(spark, d).select("seq", "qual")


@query(f"SELECT {_SEQ} AS seq FROM pages")
def src9_sequences_only(spark, d):
    return _records(spark, d).select("seq")


@query(f"SELECT substring({_SEQ}, 9) AS umi FROM pages")
def src10_umi_reads(spark, d):
    return _records(spark, d).select(sq.slice_of(F.col("seq"), 8).alias("umi"))


@query(f"SELECT reverse(translate(substring({_SEQ}, 1, 25), 'ATGC', 'TACG')) AS barcode FROM pages")
def src11_barcode_reads(spark, d):
    return _records(spark, d).select(sq.revcomp(F.substring("seq", 1, 25)).alias("barcode"))


@query("SELECT '3' AS lane, '4' AS tile, CAST(page_id AS VARCHAR) AS x, '9' AS y, concat('U', page_id) AS umi FROM pages")
def src16_header_fields(spark, d):
    return fastq.header_fields(_records(spark, d)).select("lane", "tile", "x", "y", "umi")


@query("SELECT concat('d', doc_id) AS name, seq, translate(seq, 'ACGTN', 'IIII!') AS qual, count(*) OVER () AS n FROM sequences WHERE seq <> ''", "sequences")
def src8_block_compressed(spark, d):
    """Records of block-compressed files, read in splits of 20,000 compressed bytes."""
    path = folder(spark, "blocks")
    x = F.col("seq")
    # Dealt by a key, so that the files' number is that of the tasks that Spark finds fit.
    rows = sequences(spark, d).repartition("doc_id").where("seq <> ''").select(sq.fastq_text(F.concat(F.lit("d"), F.col("doc_id").cast("string")), x, sq.masked_quality(x)).alias("value"))
    blocks.write_lines(rows, path)
    back = settled(fastq.block_records(spark, path, 20_000).select("name", "seq", "qual"), "records")
    return back.withColumn("n", F.lit(back.count()))


@query("""SELECT concat('r', event_id) AS qname, CAST(CASE WHEN event_id % 5 = 0 THEN 256 ELSE 16 END AS INTEGER) AS flag, 'chr' || (user_id % 3) AS rname, event_id + 1 AS pos, CAST(event_id % 60 AS INTEGER) AS mapq,
  (5 + event_id % 40) || 'M2I' AS cigar, CASE WHEN event_id % 2 = 0 THEN '=' ELSE '*' END AS rnext, event_id % 2 AS pnext, substring(repeat('ACGTN', 10), 1, CAST(7 + event_id % 40 AS INTEGER)) AS seq FROM events""")
def src22_binary_alignments(spark, d):
    """Binary alignment records, read in splits of 20,000 compressed bytes."""
    path, k = folder(spark, "alignments"), F.col("event_id")
    n = (k % 40).cast("int")
    seq = F.expr("substring(repeat('ACGTN', 10), 1, cast(7 + event_id % 40 as int))")
    rows = read(spark, d, "events").select("event_id", "user_id").repartition("event_id").select(
        F.concat(F.lit("r"), k.cast("string")).alias("qname"), F.when(k % 5 == 0, 256).otherwise(16).alias("flag"), F.concat(F.lit("chr"), (F.col("user_id") % 3).cast("string")).alias("rname"), (k + 1).alias("pos"), (k % 60).cast("int").alias("mapq"),
        F.concat((n + 5).cast("string"), F.lit("M2I")).alias("cigar"), F.when(k % 2 == 0, "=").otherwise("*").alias("rnext"), (k % 2).alias("pnext"), F.lit(0).cast("long").alias("tlen"), seq.alias("seq"), F.lit("*").alias("qual"),
    )
    blocks.write_alignments(rows, path, {f"chr{i}": 1 << 28 for i in range(3)})
    return blocks.alignments(spark, path, 20_000).select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "seq")


@query("""WITH s AS (SELECT l_orderkey, l_partkey FROM lineitem) SELECT l_partkey, count(*) AS kept FROM s GROUP BY 1""")
def snk3_appended_chunks(spark, d):
    path = folder(spark, "chunks")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    for odd in (0, 1):
        tables.write_table(rows.where(F.col("l_orderkey") % 2 == odd), path, 20_000, mode="append")
    return tables.read_table(spark, path, "l_orderkey long, l_partkey long").groupBy("l_partkey").agg(F.count("*").alias("kept"))


@query(f"""WITH g AS (SELECT row_number() OVER (ORDER BY doc_id) AS rec_no, seq, {TOLERANT} AS g1, {SECOND.replace("x", "substring(seq, 141)")} AS g2 FROM sequences),
lib AS (SELECT DISTINCT g1 AS b FROM g WHERE g1 <> ''), asked AS (SELECT g1 AS a FROM g WHERE g1 <> '' UNION SELECT g2 FROM g WHERE g2 <> ''),
scored AS (SELECT a, b, 100 * (1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)) AS score FROM asked, lib),
called AS (SELECT a, b, score FROM scored WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
SELECT x.b AS p1_identity, x.score AS p1_score, y.b AS p2_identity, y.score AS p2_score, {RC.format("substring(seq, 1, 25)")} AS barcode_mapped, substring(seq, 9, 12) AS "UMI"
FROM g JOIN called x ON x.a = g1 JOIN called y ON y.a = g2""", "sequences")
def pl10_process_reads(spark, d):
    """Guides, barcodes and molecules called from one analog read of each kind."""
    s = running.numbered(sequences(spark, d), "doc_id").select("rec_no", "seq")
    library = s.select(sq.tolerant_guide(F.col("seq")).alias("identity")).where("identity <> ''").distinct()
    barcodes = s.select(sq.revcomp(F.substring("seq", 1, 25)).alias("barcode")).distinct()
    return workflows.process_reads(s, s, s, s.withColumn("seq", F.substring("seq", 1, 20)), library, barcodes, least=60)


@query("SELECT p1, p2, barcode, rep, count(DISTINCT ident) FILTER (sample % 2 = 0) AS ident, count(DISTINCT ident) FILTER (sample % 2 = 1) AS report FROM dual GROUP BY ALL", "dual")
def pl11_collapse_dual(spark, d):
    reads = dual(spark, d).select("p1", "p2", "barcode", "rep", F.col("ident").alias("UMI"), F.when(F.col("sample") % 2 == 0, "identity").otherwise("reporter").alias("transcript"))
    return workflows.collapse(reads, DUAL.with_(samples=("rep",)))


@query("SELECT guide, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS repr FROM single GROUP BY 1", "single")
def pl12_representation(spark, d):
    from ..operators.counts import representation

    return representation(single(spark, d), ["guide"]).select("guide", F.round("repr", 9).alias("repr"))


@query("SELECT barcode, round(log2(ident + 10), 6) AS a, round(log2(report + 10), 6) AS b FROM dual", "dual")
def pl02_log_transform(spark, d):
    rows = screen.log_transform(dual(spark, d), ["ident", "report"])
    return rows.select("barcode", F.round("log2_ident", 6).alias("a"), F.round("log2_report", 6).alias("b"))


@query("SELECT p1, p2, p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%' AS control, count(*) AS n FROM dual GROUP BY ALL", "dual")
def pl03_set_control(spark, d):
    return screen.set_control(dual(spark, d), ["p1", "p2"], CONTROL).groupBy("p1", "p2", "control").agg(F.count("*").alias("n"))


@query()
def mx15_guide_activities(spark, d):
    """Raw and denoised pair tables and single effects, stacked with their names."""
    raw = cells(spark, d)
    out = None
    for name, m in (("raw", raw), ("pcp", workflows.denoised(raw))):
        singles = matrix.singles(m, CONTROL)
        parts = [(f"{name}_pairs", matrix.symmetrise(matrix.guide_pairs(m, CONTROL))), (f"{name}_singles", singles.select(F.col("control").alias("i"), F.col("guide").alias("j"), "v")), (f"{name}_effects", matrix.single_effects(singles).select(F.lit(None).cast("string").alias("i"), F.col("guide").alias("j"), F.col("x").alias("v")))]
        for kind, df in parts:
            df = df.select(F.lit(kind).alias("table"), "i", "j", "v")
            out = df if out is None else out.unionByName(df)
    return out


@query()
def vz6_vz8_cluster_correlations(spark, d):
    """Leaf positions of clusters with the correlation matrix in that order."""
    m = matrix.as_square(matrix.correlation(cells(spark, d)))
    dist = m.withColumn("v", 1 - F.coalesce(F.when(~F.isnan("v"), F.col("v")), F.lit(0.0)))
    from ..operators.cluster import order_of

    return matrix.reordered(m, order_of(spark, dist)[1])


@query("WITH p AS (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS pos, label FROM embeddings) SELECT label, min(pos) AS first, max(pos) + 1 AS stop, count(*) AS n FROM p GROUP BY 1")
def vz8_label_blocks(spark, d):
    p = recall.positions(read(spark, d, "embeddings").withColumn("k", F.struct("label", "vec_id")), "k", "label")
    return p.groupBy("label").agg(F.min("pos").cast("long").alias("first"), (F.max("pos") + 1).cast("long").alias("stop"), F.count("*").alias("n"))


@query("SELECT part, cluster, round(avg(v), 6) AS mean, count(v) AS n FROM (SELECT 'rows' AS part, i AS g, v FROM cells UNION ALL SELECT 'columns', j, v FROM cells) JOIN (SELECT n_name AS g, n_regionkey AS cluster FROM nation) USING (g) GROUP BY ALL", "cells")
def vz3_two_tables(spark, d):
    n = read(spark, d, "nation").select(F.col("n_name").alias("g"), F.col("n_regionkey").alias("cluster"))
    m = cells(spark, d)
    both = m.select(F.lit("rows").alias("part"), F.col("i").alias("g"), "v").unionByName(m.select(F.lit("columns").alias("part"), F.col("j").alias("g"), "v"))
    return views.mean_sem(both.join(n, "g"), ["part", "cluster"], "v").select("part", "cluster", F.round("mean", 6).alias("mean"), "n")
