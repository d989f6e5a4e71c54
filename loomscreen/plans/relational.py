"""Relational queries: projections, filters, joins, aggregates, windows, top-k, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequences as sq
from ..operators import counts, running, screen
from ..sources.scratch import settled
from .analogs import CONTROL, DUAL, dual, query, read, reads, single


def r6(x, name):
    return F.round(x, 6).alias(name)


@query("""WITH lin AS (SELECT p1, p2, barcode, rep, sum(ident) AS a, sum(report) AS b FROM dual GROUP BY ALL),
sh AS (SELECT *, a / nullif(sum(a) OVER (PARTITION BY p1, p2), 0) AS ra, b / nullif(sum(b) OVER (PARTITION BY p1, p2), 0) AS rb FROM lin),
th AS (SELECT greatest(avg(coalesce(ra, 0)) + 3 * stddev_samp(coalesce(ra, 0)), CAST(0.05 AS DOUBLE)) AS ta, greatest(avg(coalesce(rb, 0)) + 3 * stddev_samp(coalesce(rb, 0)), CAST(0.05 AS DOUBLE)) AS tb FROM sh),
kept AS (SELECT p1, p2, barcode, rep FROM sh, th WHERE ra < ta AND rb < tb),
r AS (SELECT d.* FROM dual d WHERE EXISTS (SELECT 1 FROM kept k WHERE k.p1 = d.p1 AND k.p2 = d.p2 AND k.barcode = d.barcode AND k.rep = d.rep)),
m AS (SELECT p1, p2, p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%' AS control, avg(log2(report + 10)) AS reporter FROM r GROUP BY ALL),
c AS (SELECT avg(reporter) FILTER (control) AS mu, stddev_samp(reporter) FILTER (control) AS sd FROM m)
SELECT p1, p2, control, round((reporter - mu) / nullif(sd, 0), 6) AS reporter_z FROM m, c""", "dual")
def p0_screen_hits(spark, d):
    """Lineage filter, control pairs, mean log2 reporter of each pair, z-score against controls."""
    rows = screen.log_transform(screen.filter_lineages(settled(dual(spark, d), "molecules"), DUAL), ["report"])
    rows = screen.set_control(rows, ["p1", "p2"], CONTROL)
    means = settled(rows.groupBy("p1", "p2", "control").agg(F.avg("log2_report").alias("reporter")), "means")
    return screen.control_z(means, "reporter", "z").select("p1", "p2", "control", r6(F.col("z"), "reporter_z"))


@query("""WITH lin AS (SELECT p1, p2, barcode, rep, sum(ident) AS a, sum(report) AS b FROM dual GROUP BY ALL),
sh AS (SELECT *, a / nullif(sum(a) OVER (PARTITION BY p1, p2), 0) AS ra, b / nullif(sum(b) OVER (PARTITION BY p1, p2), 0) AS rb FROM lin),
th AS (SELECT avg(coalesce(ra, 0)) + 3 * stddev_samp(coalesce(ra, 0)) AS ta, avg(coalesce(rb, 0)) + 3 * stddev_samp(coalesce(rb, 0)) AS tb FROM sh),
kept AS (SELECT p1, p2, barcode, rep FROM sh, th WHERE ra < ta AND rb < tb)
SELECT p1, count(*) AS n, round(sum(report), 2) AS total FROM dual d WHERE EXISTS (SELECT 1 FROM kept k WHERE k.p1 = d.p1 AND k.p2 = d.p2 AND k.barcode = d.barcode AND k.rep = d.rep) GROUP BY p1""", "dual")
def pl01_lineage_filter_no_floor(spark, d):
    return screen.filter_lineages(settled(dual(spark, d), "molecules"), DUAL, floor=None).groupBy("p1").agg(F.count("*").alias("n"), F.round(F.sum("report"), 2).alias("total"))


@query("SELECT rep, p2, ident FROM dual", "dual")
def prj1_columns(spark, d):
    return dual(spark, d).select("rep", "p2", "ident")


@query("SELECT barcode AS lineage, ident AS umi_identity FROM dual", "dual")
def prj2_rename(spark, d):
    return dual(spark, d).select("barcode", "ident").withColumnsRenamed({"barcode": "lineage", "ident": "umi_identity"})


@query("SELECT barcode, round(log2(ident + 10), 6) AS log2_ident, round(report * 2 - ident, 4) AS derived FROM dual", "dual")
def prj3_arithmetic(spark, d):
    return screen.log_transform(dual(spark, d), ["ident"]).select("barcode", r6(F.col("log2_ident"), "log2_ident"), F.round(F.col("report") * 2 - F.col("ident"), 4).alias("derived"))


@query("SELECT split_part(guide, '_', -1) AS protospacer, guide, gene FROM single", "single")
def prj4_insert_column(spark, d):
    return single(spark, d).select(sq.field(F.col("guide"), "_", -1).alias("protospacer"), "guide", "gene")


_IDS = """g AS (SELECT guide, gene, min(barcode) AS seen FROM single GROUP BY ALL),
ids AS (SELECT guide, gene, CASE WHEN count(*) OVER (PARTITION BY gene) = 1 THEN gene ELSE concat(gene, '_', row_number() OVER (PARTITION BY gene ORDER BY seen, guide)) END AS guide_id FROM g)"""


@query(f"WITH {_IDS} SELECT * FROM ids", "single")
def pl04_guide_ids(spark, d):
    return screen.guide_ids(single(spark, d), ["guide"], "barcode")


@query(f"WITH {_IDS} SELECT coalesce(guide_id, s.guide) AS guide, barcode FROM single s LEFT JOIN ids USING (guide)", "single")
def prj5_relabel(spark, d):
    rows = single(spark, d).select("guide", "barcode")
    return screen.relabel(rows, "guide", screen.guide_ids(single(spark, d), ["guide"], "barcode"))


@query("SELECT e.event_id, n.n_name AS name FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id")
def prj6_map_lookup(spark, d):
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("name"))
    return read(spark, d, "events").select("event_id", "user_id").join(names, "user_id", "left").select("event_id", "name")


@query("SELECT e.event_id, coalesce(n.n_name, 'unknown') AS name FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id")
def prj7_lookup_with_default(spark, d):
    return prj6_map_lookup(spark, d).na.fill("unknown", ["name"])


@query("SELECT p1, barcode FROM dual WHERE p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%'", "dual")
def flt1_controls(spark, d):
    return screen.set_control(dual(spark, d), ["p1", "p2"], CONTROL).where("control").select("p1", "barcode")


@query("SELECT barcode, ident, report FROM dual WHERE ident < 30 AND report < 40000", "dual")
def flt2_thresholds(spark, d):
    from functools import reduce

    limits = {"ident": 30.0, "report": 40000.0}
    return dual(spark, d).where(reduce(lambda a, b: a & b, (F.col(c) < v for c, v in limits.items()))).select("barcode", "ident", "report")


@query("SELECT event_id, value FROM events e WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_acctbal > 0)")
def flt3_semi_join(spark, d):
    known = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return read(spark, d, "events").join(known, "user_id", "left_semi").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value >= 75")
def flt4_score(spark, d):
    return read(spark, d, "events").where("value >= 75").select("event_id", "value")


@query("SELECT barcode, starts_with(p1, 'NATION_2') AS c1, NOT starts_with(p2, 'NATION_2') AS targeting FROM dual", "dual")
def flt5_prefix(spark, d):
    return dual(spark, d).select("barcode", F.col("p1").startswith(CONTROL).alias("c1"), (~F.col("p2").startswith(CONTROL)).alias("targeting"))


@query("SELECT event_id, value FROM events WHERE NOT (value BETWEEN 10 AND 20 OR value BETWEEN 60 AND 70)")
def flt6_masked_ranges(spark, d):
    masked = F.col("value").between(10, 20) | F.col("value").between(60, 70)
    return read(spark, d, "events").where(~masked).select("event_id", "value")


@query("SELECT doc_id FROM documents WHERE NOT contains(text, '|')")
def flt7_no_unknown(spark, d):
    return read(spark, d, "documents").where(~F.col("text").contains("|")).select("doc_id")


@query("""SELECT l_orderkey, l_partkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM part p WHERE p_partkey = l_partkey AND p_size < 25)
AND EXISTS (SELECT 1 FROM supplier s WHERE s_suppkey = l_suppkey AND s_acctbal > 0)""")
def flt8_several_masks(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    small = read(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    good = read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return rows.join(small, "l_partkey", "left_semi").join(good, "l_suppkey", "left_semi").select("l_orderkey", "l_partkey")


@query("SELECT i, j, v FROM (SELECT p1 AS i, p2 AS j, CASE WHEN count(*) >= 60 THEN round(avg(ident), 6) END AS v FROM dual GROUP BY ALL) WHERE v IS NOT NULL", "dual")
def flt9_not_null(spark, d):
    means = dual(spark, d).groupBy(F.col("p1").alias("i"), F.col("p2").alias("j")).agg(F.when(F.count("*") >= 60, F.round(F.avg("ident"), 6)).alias("v"))
    return means.na.drop(subset=["v"])


@query("SELECT event_id, round(100 / nullif(floor(value / 10), 0), 6) AS x FROM events WHERE floor(value / 10) <> 0")
def flt10_infinite_to_null(spark, d):
    x = F.try_divide(F.lit(100.0), F.floor(F.col("value") / 10))
    x = F.when(F.abs(x) != float("inf"), x)
    return read(spark, d, "events").select("event_id", r6(x, "x")).na.drop(subset=["x"])


@query("SELECT event_id FROM events WHERE event_type = 'click'")
def flt11_equality(spark, d):
    return read(spark, d, "events").where(F.col("event_type") == "click").select("event_id")


@query("""SELECT c_nationkey AS "FWER p-val", c_acctbal AS NES FROM customer WHERE c_acctbal > 100 AND c_nationkey > 10""")
def flt12_quoted_names(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_nationkey").alias("FWER p-val"), F.col("c_acctbal").alias("NES"))
    return rows.where((F.col("`FWER p-val`") > 10) & (F.col("NES") > 100))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE abs(c_acctbal) >= CASE WHEN c_acctbal > 0 THEN 3000 ELSE 500 END")
def flt13_signed_threshold(spark, d):
    x = F.col("c_acctbal")
    return read(spark, d, "customer").where(F.abs(x) >= F.when(x > 0, 3000).otherwise(500)).select("c_custkey", "c_acctbal")


@query("""WITH q AS (SELECT quantile_cont(c_acctbal, 0.01) AS a, quantile_cont(c_acctbal, 0.99) AS b FROM customer)
SELECT c_custkey, c_acctbal FROM customer, q WHERE c_acctbal < a OR c_acctbal > b""")
def flt14_outliers(spark, d):
    ends = F.percentile("c_acctbal", F.array(F.lit(0.01), F.lit(0.99)))
    rows = screen.with_scalars(read(spark, d, "customer"), ends.alias("q"))
    return rows.where((F.col("c_acctbal") < F.col("q")[0]) | (F.col("c_acctbal") > F.col("q")[1])).select("c_custkey", "c_acctbal")


@query("SELECT bool_and(o_custkey = c_custkey) AS equal, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def flt15_all_match(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.agg(F.bool_and(F.col("o_custkey") == F.col("c_custkey")).alias("equal"), F.count("*").alias("n"))


@query("""WITH rep AS (SELECT n_name AS p1, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4 GROUP BY 1)
SELECT p1, p2, round(coalesce(share, 0), 6) AS share, count(*) AS n FROM dual LEFT JOIN rep USING (p1) GROUP BY ALL""", "dual")
def jn1_representation_join(spark, d):
    homes = read(spark, d, "customer").join(read(spark, d, "nation").where("n_regionkey < 4"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("p1"))
    rows = screen.with_representation(dual(spark, d), counts.representation(homes, ["p1"], "share"), ["p1"])
    return rows.groupBy("p1", "p2", r6(F.col("share"), "share")).agg(F.count("*").alias("n"))


@query("SELECT o.o_custkey, o.n, l.total FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o LEFT JOIN (SELECT c_custkey, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1) l ON o.o_custkey = l.c_custkey")
def jn2_summary_left_join(spark, d):
    a = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = read(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    return a.join(b, "o_custkey", "left")


@query("""WITH a AS (SELECT cell, kind, count(DISTINCT umi) AS n FROM reads WHERE transcript = 'identity' GROUP BY ALL), b AS (SELECT cell, kind, count(DISTINCT umi) AS n FROM reads WHERE transcript = 'reporter' GROUP BY ALL)
SELECT cell, kind, coalesce(a.n, 0) AS UMI_identity, coalesce(b.n, 0) AS UMI_reporter FROM a FULL JOIN b USING (cell, kind)""", "reads")
def jn3_collapse_full_outer(spark, d):
    """Both transcripts' molecule counts in one pass, zeros included."""
    return counts.umi_collapse(reads(spark, d), ["cell", "kind"], "umi", "transcript", {"UMI_identity": "identity", "UMI_reporter": "reporter"})


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey")
def jn5_inner_other_names(spark, d):
    return read(spark, d, "events").join(read(spark, d, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")


@query("SELECT c_custkey AS k, c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def jn6_by_index(spark, d):
    a, b = read(spark, d, "customer"), read(spark, d, "supplier")
    return a.select(F.col("c_custkey").alias("k"), "c_name").join(b.select(F.col("s_suppkey").alias("k"), "s_name"), "k")


@query("""WITH w AS (SELECT p1, p2, rep, avg(log2(ident + 10)) AS ident, avg(log2(report + 10)) AS report FROM dual GROUP BY ALL)
SELECT p1, p2, round(a.ident, 6) AS ident_rep1, round(b.ident, 6) AS ident_rep2, round(a.report, 6) AS report_rep1, round(b.report, 6) AS report_rep2 FROM w a JOIN w b USING (p1, p2) WHERE a.rep = 'F' AND b.rep = 'O'""", "dual")
def jn7_replicates(spark, d):
    wide = dual(spark, d).groupBy("p1", "p2", "rep").agg(*(F.avg(F.log2(F.col(c) + 10)).alias(c) for c in ("ident", "report")))
    side = lambda rep, s: wide.where(F.col("rep") == rep).select("p1", "p2", r6(F.col("ident"), f"ident_{s}"), r6(F.col("report"), f"report_{s}"))
    return side("F", "rep1").join(side("O", "rep2"), ["p1", "p2"])


@query("""WITH a AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), b AS (SELECT gene, count(*) AS m FROM single WHERE rep = 'O' GROUP BY 1)
SELECT p_brand AS barcode, round(n / CAST((SELECT sum(n) FROM a) AS DOUBLE), 6) AS input_repr, round(coalesce(m / CAST((SELECT sum(m) FROM b) AS DOUBLE), 0), 6) AS observed FROM a LEFT JOIN b ON p_brand = gene""", "single")
def jn8_input_and_observed(spark, d):
    a = counts.representation(read(spark, d, "part").select(F.col("p_brand").alias("barcode")), ["barcode"], "input_repr")
    b = counts.representation(single(spark, d).where("rep = 'O'").select(F.col("gene").alias("barcode")), ["barcode"], "observed")
    return screen.with_representation(a, b, ["barcode"]).select("barcode", r6(F.col("input_repr"), "input_repr"), r6(F.col("observed"), "observed"))


@query("""WITH w AS (SELECT p1, p2, rep, avg(log2(report + 10)) AS v FROM dual GROUP BY ALL HAVING count(*) >= 40)
SELECT p1, p2, round(a.v, 6) AS a, round(b.v, 6) AS b FROM (SELECT * FROM w WHERE rep = 'F') a FULL JOIN (SELECT * FROM w WHERE rep = 'O') b USING (p1, p2)""", "dual")
def jn9_stacked_matrices(spark, d):
    w = dual(spark, d).groupBy("p1", "p2", "rep").agg(F.avg(F.log2(F.col("report") + 10)).alias("v"), F.count("*").alias("n")).where("n >= 40")
    side = lambda rep, s: w.where(F.col("rep") == rep).select("p1", "p2", r6(F.col("v"), s))
    return side("F", "a").join(side("O", "b"), ["p1", "p2"], "full_outer")


@query("SELECT l_orderkey, l_quantity FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def jn10_kept_lineages(spark, d):
    kept = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").join(kept, "l_orderkey", "left_semi").select("l_orderkey", "l_quantity")


@query("SELECT l_orderkey, l_quantity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def jn11_complement(spark, d):
    gone = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_quantity")


@query("SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.user_id)")
def jn12_records_not_listed(spark, d):
    listed = read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return read(spark, d, "events").join(listed, "user_id", "left_anti").select("event_id")


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, label, embedding[1] AS e FROM embeddings), s AS (SELECT * FROM p WHERE e > 0.15)
SELECT DISTINCT s.pos AS at, p.pos AS near, p.label AS cluster FROM s JOIN p ON s.label = p.label AND p.pos BETWEEN s.pos - 20 AND s.pos + 20 AND p.pos <> s.pos""")
def jn13_neighbours(spark, d):
    from ..operators import recall

    return recall.neighbours(recall.positions(read(spark, d, "embeddings"), "vec_id", "label", "embedding"), "embedding[0] > 0.15", 20)


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, label, embedding[2] AS e FROM embeddings)
SELECT a.pos AS at, a.label AS cluster FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.label = a.label AND b.e > 0.15 AND b.pos BETWEEN a.pos - 10 AND a.pos + 10)""")
def jn14_not_orphans(spark, d):
    from ..operators import recall

    p = recall.positions(read(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return recall.near(p, p.where("embedding[1] > 0.15"), 10).select(F.col("pos").alias("at"), F.col("label").alias("cluster"))


@query("SELECT a.i, c.i AS control, a.n * c.n AS pairs FROM (SELECT p1 AS i, count(*) AS n FROM dual GROUP BY 1) a, (SELECT p1 AS i, count(*) AS n FROM dual WHERE p1 LIKE 'NATION_2%' GROUP BY 1) c", "dual")
def jn15_all_with_controls(spark, d):
    a = dual(spark, d).groupBy(F.col("p1").alias("i")).agg(F.count("*").alias("n"))
    c = a.where(F.col("i").startswith(CONTROL)).select(F.col("i").alias("control"), F.col("n").alias("m"))
    # One row a control guide: a screen's control set is a short list of names.
    return a.crossJoin(c).select("i", "control", (F.col("n") * F.col("m")).alias("pairs"))


@query("SELECT p1, p2, round(coalesce(a.v, b.v), 6) AS v, a.v IS NULL AS turned FROM (SELECT least(p1, p2) AS p1, greatest(p1, p2) AS p2 FROM dual GROUP BY ALL) q LEFT JOIN (SELECT i AS p1, j AS p2, v FROM cells) a USING (p1, p2) LEFT JOIN (SELECT j AS p1, i AS p2, v FROM cells) b USING (p1, p2)", "cells")
def jn19_either_orientation(spark, d):
    from ..operators import matrix
    from .analogs import cells

    pairs = dual(spark, d).select(F.least("p1", "p2").alias("i"), F.greatest("p1", "p2").alias("j")).distinct()
    return matrix.lookup(pairs, cells(spark, d)).select(F.col("i").alias("p1"), F.col("j").alias("p2"), r6(F.col("v"), "v"), "turned")


@query("SELECT a.rn, a.name AS first, b.name AS second FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS rn, c_name AS name FROM customer) a JOIN (SELECT row_number() OVER (ORDER BY p_partkey) AS rn, p_name AS name FROM part) b USING (rn)")
def jn20_by_position(spark, d):
    a = running.numbered(read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("first")), "c_custkey", "rn")
    b = running.numbered(read(spark, d, "part").select("p_partkey", F.col("p_name").alias("second")), "p_partkey", "rn")
    return a.join(b, "rn").select(F.col("rn"), "first", "second")


@query("SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def jn21_dimensions(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "p_name", "s_name")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3")
def jn22_coordinates(spark, d):
    near = read(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return read(spark, d, "customer").join(near, "c_nationkey").select("c_custkey", "n_name")


@query("SELECT a.n_nationkey, b.pos FROM nation a JOIN (SELECT n_name, row_number() OVER (ORDER BY n_name DESC) - 1 AS pos FROM nation) b USING (n_name)")
def jn23_place_in_other_order(spark, d):
    n = read(spark, d, "nation")
    order = n.select("n_name", (F.row_number().over(Window.orderBy(F.desc("n_name"))) - 1).alias("pos"))
    return n.join(order, "n_name").select("n_nationkey", "pos")


@query("""WITH p AS (SELECT c_custkey AS k, c_nationkey AS x, c_acctbal / 1000 AS y FROM customer), s AS (SELECT s_suppkey AS q, s_nationkey AS x, s_acctbal / 1000 AS y FROM supplier)
SELECT q, count(*) AS n, round(sum(2.0 - sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2)), 4) AS weight FROM s JOIN p ON sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) < 2 GROUP BY q""")
def jn24_within_radius(spark, d):
    from ..operators import network

    p = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("double").alias("x"), (F.col("c_acctbal") / 1000).alias("y"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("q"), F.col("s_nationkey").cast("double").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    near = network.closeness(s, p, 2.0)
    return near.groupBy("q").agg(F.sum("n").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


# Aggregates


@query("SELECT p1, p2, barcode, rep, round(sum(ident), 4) AS ident, round(sum(report), 2) AS report FROM dual GROUP BY ALL", "dual")
def ag1_lineage_sums(spark, d):
    return counts.pseudobulk(dual(spark, d), DUAL.lineage, ["ident", "report"]).select(*DUAL.lineage, F.round("ident", 4).alias("ident"), F.round("report", 2).alias("report"))


@query("SELECT p1, p2, round(avg(log2(report + 10)), 6) AS report FROM dual GROUP BY ALL", "dual")
def ag2_means(spark, d):
    return dual(spark, d).groupBy("p1", "p2").agg(r6(F.avg(F.log2(F.col("report") + 10)), "report"))


@query("SELECT guide, count(*) AS n FROM single GROUP BY 1", "single")
def ag3_sizes(spark, d):
    return counts.present(single(spark, d), ["guide"]).groupBy("guide").agg(F.count("*").alias("n"))


@query("SELECT cell, kind, count(DISTINCT umi) AS n FROM reads GROUP BY ALL", "reads")
def ag4_umi_collapse(spark, d):
    return reads(spark, d).groupBy("cell", "kind").agg(F.count_distinct("umi").alias("n"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def ag5_value_counts(spark, d):
    return read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "user_id")


@query("SELECT p1, p2, count(*) AS n_lineages FROM (SELECT DISTINCT p1, p2, barcode, rep FROM dual) GROUP BY ALL", "dual")
def ag6_measurements(spark, d):
    return counts.measurement_counts(dual(spark, d), ["p1", "p2"], DUAL.lineage)


@query("SELECT p1, p2, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS viral_repr FROM dual GROUP BY ALL", "dual")
def ag7_frequency(spark, d):
    return counts.representation(dual(spark, d), ["p1", "p2"], "f").select("p1", "p2", F.round("f", 9).alias("viral_repr"))


_SUMMARY = """rep AS (SELECT p1, p2, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS q FROM dual GROUP BY ALL),
s AS (SELECT p1, p2, p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%' AS control, q, sum(ident) AS a, avg(log2(report + 10)) AS reporter FROM dual JOIN rep USING (p1, p2) GROUP BY ALL),
f AS (SELECT *, log2(a / sum(a) OVER () + 1e-7) - log2(q + 1e-7) AS lfc FROM s)"""


@query(f"WITH {_SUMMARY} SELECT p1, p2, round(lfc, 6) AS lfc FROM f", "dual")
def ag8_log_fold_change(spark, d):
    return _summary(spark, d).select("p1", "p2", r6(F.col("identity"), "lfc"))


def _summary(spark, d):
    rep = counts.representation(dual(spark, d), ["p1", "p2"], "q")
    rows = screen.log_transform(screen.with_representation(dual(spark, d), rep, ["p1", "p2"]), ["report"])
    return screen.summary(screen.set_control(rows, ["p1", "p2"], CONTROL), DUAL, "ident", "log2_report", rep="q")


_Z = "c AS (SELECT avg(lfc) FILTER (control) AS m1, stddev_samp(lfc) FILTER (control) AS s1, avg(reporter) FILTER (control) AS m2, stddev_samp(reporter) FILTER (control) AS s2 FROM f)"


@query(f"WITH {_SUMMARY}, {_Z} SELECT p1, p2, control, round(lfc, 6) AS identity, round((lfc - m1) / nullif(s1, 0), 5) AS identity_z, round(reporter, 6) AS reporter, round((reporter - m2) / nullif(s2, 0), 5) AS reporter_z FROM f, c", "dual")
def pl06_summary(spark, d):
    return _summary(spark, d).select("p1", "p2", "control", r6(F.col("identity"), "identity"), F.round("identity_z", 5).alias("identity_z"), r6(F.col("reporter"), "reporter"), F.round("reporter_z", 5).alias("reporter_z"))


@query("""WITH m AS (SELECT gene, gene LIKE 'Brand#1%' AS control, avg(ident) AS v FROM single GROUP BY ALL), c AS (SELECT avg(v) FILTER (control) AS mu, stddev_samp(v) FILTER (control) AS sd FROM m)
SELECT gene, round((v - mu) / nullif(sd, 0), 5) AS z FROM m, c""", "single")
def ag9_control_z(spark, d):
    rows = screen.set_control(single(spark, d), ["gene"], "Brand#1").groupBy("gene", "control").agg(F.avg("ident").alias("v"))
    return screen.control_z(rows, "v", "z").select("gene", F.round("z", 5).alias("z"))


@query("SELECT round(greatest(avg(value) + 3 * stddev_samp(value), CAST(0.05 AS DOUBLE)), 5) AS threshold FROM events")
def ag10_threshold(spark, d):
    return read(spark, d, "events").agg(F.round(F.greatest(F.avg("value") + 3 * F.stddev_samp("value"), F.lit(0.05)), 5).alias("threshold"))


@query("SELECT event_id, round((value - min(value) OVER ()) / nullif(max(value) OVER () - min(value) OVER (), 0) * 9 + 1, 6) AS x FROM events")
def ag11_rescale(spark, d):
    return screen.rescale(read(spark, d, "events"), "value", F.lit(1.0), F.lit(10.0), "x").select("event_id", r6(F.col("x"), "x"))


@query("SELECT p1, rep, median(report) AS mid FROM dual GROUP BY ALL", "dual")
def ag12_median(spark, d):
    return dual(spark, d).groupBy("p1", "rep").agg(F.median("report").alias("mid"))


@query("SELECT label, median(vec_id) AS mid FROM embeddings GROUP BY 1")
def ag13_cluster_median(spark, d):
    return read(spark, d, "embeddings").groupBy("label").agg(F.median("vec_id").alias("mid"))


@query("SELECT event_type, round(quantile_cont(value, CAST(0.02 AS DOUBLE)), 6) AS lo, round(quantile_cont(value, CAST(0.98 AS DOUBLE)), 6) AS hi FROM events GROUP BY 1")
def ag14_quantiles(spark, d):
    q = read(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    return q.select("event_type", r6(F.col("q")[0], "lo"), r6(F.col("q")[1], "hi"))


@query("SELECT count(DISTINCT guide) AS guides, count(DISTINCT gene) AS genes FROM single", "single")
def ag15_distinct(spark, d):
    return single(spark, d).agg(F.count_distinct("guide").alias("guides"), F.count_distinct("gene").alias("genes"))


@query("SELECT n_regionkey, array_to_string(list_sort(list_distinct(list(n_name))), ';') AS names FROM nation GROUP BY 1")
def ag16_sets(spark, d):
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ";").alias("names"))


@query("SELECT gene, round(arg_min(report, (barcode, ident, report)) FILTER (rep = 'F'), 2) AS report_F, round(arg_min(report, (barcode, ident, report)) FILTER (rep = 'O'), 2) AS \"report_O\" FROM single GROUP BY 1", "single")
def ag17_pivot_first(spark, d):
    out = single(spark, d).groupBy("gene").pivot("rep", ["F", "O"]).agg(F.round(F.min_by("report", F.struct("barcode", "ident", "report")), 2))
    return out.select("gene", F.col("F").alias("report_F"), F.col("O").alias("report_O"))


@query("SELECT p1, round(avg(log2(report + 10)), 6) AS mean, round(stddev_samp(log2(report + 10)) / sqrt(count(report)), 6) AS sem, count(report) AS n FROM dual GROUP BY 1", "dual")
def ag18_standard_error(spark, d):
    from ..operators import views

    t = views.mean_sem(screen.log_transform(dual(spark, d), ["report"]), ["p1"], "log2_report")
    return t.select("p1", r6(F.col("mean"), "mean"), r6(F.col("sem"), "sem"), "n")


@query("SELECT count(value) AS count, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(min(value), 5) AS min, round(quantile_cont(value, CAST(0.25 AS DOUBLE)), 5) AS q1, round(median(value), 5) AS q2, round(quantile_cont(value, CAST(0.75 AS DOUBLE)), 5) AS q3, round(max(value), 5) AS max FROM events")
def ag19_describe(spark, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = lambda x, n: F.round(x, 5).alias(n)
    return read(spark, d, "events").agg(F.count("value").alias("count"), r(F.avg("value"), "mean"), r(F.stddev_samp("value"), "std"), r(F.min("value"), "min"), r(q[0], "q1"), r(q[1], "q2"), r(q[2], "q3"), r(F.max("value"), "max"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70)")
def ag20_having(spark, d):
    return counts.at_least(read(spark, d, "events"), ["user_id"], 70).select("event_id", "user_id")


@query("SELECT count_if(event_type = 'click') AS click, count_if(event_type = 'view') AS view, count(*) AS n FROM events")
def ag21_by_category(spark, d):
    return read(spark, d, "events").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view")), F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, count(*) AS support FROM events GROUP BY 1) SELECT count_if(support <= 50) AS few, count_if(support > 50 AND support <= 70) AS some, count_if(support > 70) AS many, CAST(sum(support) AS BIGINT) AS total FROM s")
def ag22_support_buckets(spark, d):
    s = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("support"))
    x = F.col("support")
    return s.agg(F.count_if(x <= 50).alias("few"), F.count_if((x > 50) & (x <= 70)).alias("some"), F.count_if(x > 70).alias("many"), F.sum(x).alias("total"))


@query("SELECT event_type, floor(count(*) * 10000.0 / (SELECT count(*) FROM events)) / 100 AS pct FROM events GROUP BY 1")
def ag23_truncated_percentage(spark, d):
    n = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return screen.with_scalars(n, F.sum("n").alias("all")).select("event_type", (F.floor(F.col("n") * 10000.0 / F.col("all")) / 100).alias("pct"))


@query("SELECT round(avg(value), 5) AS mean FROM events WHERE NOT (value BETWEEN 10 AND 20)")
def ag24_masked_mean(spark, d):
    return read(spark, d, "events").where(~F.col("value").between(10, 20)).agg(F.round(F.avg("value"), 5).alias("mean"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN CAST(c_nationkey AS DOUBLE) WHEN c_custkey % 5 = 0 THEN round(c_acctbal, 4) ELSE round((c_acctbal + c_nationkey) / 2, 4) END AS mean FROM customer")
def ag25_row_mean(spark, d):
    a, b = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), F.when((F.col("c_custkey") % 5 != 0) | (F.col("c_custkey") % 7 == 0), F.col("c_nationkey").cast("double"))
    from ..operators.matrix import mean_of

    return read(spark, d, "customer").select("c_custkey", F.round(mean_of(a, b), 4).alias("mean"))


@query("SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END, 0) + c_nationkey, 4) AS total FROM customer")
def ag26_row_sum(spark, d):
    a = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))
    return read(spark, d, "customer").select("c_custkey", F.round(F.coalesce(a, F.lit(0.0)) + F.col("c_nationkey"), 4).alias("total"))


@query("SELECT bool_or(value > 50) AS any_large, bool_and(value >= 0) AS all_positive FROM events")
def ag28_any_all(spark, d):
    return read(spark, d, "events").agg(F.bool_or(F.col("value") > 50).alias("any_large"), F.bool_and(F.col("value") >= 0).alias("all_positive"))


@query("SELECT rep, round(corr(ident, report), 6) AS r FROM dual GROUP BY 1", "dual")
def ag29_correlation(spark, d):
    return dual(spark, d).groupBy("rep").agg(r6(F.corr("ident", "report"), "r"))


@query("WITH s AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS y FROM embeddings) SELECT j, round(corr(v, y), 6) AS r FROM grid JOIN s USING (i) GROUP BY 1", "grid")
def ag30_correlate_columns(spark, d):
    from .analogs import grid

    g = grid(spark, d)
    y = g.where("j = 0").select("i", F.col("v").alias("y"))
    return g.join(y, "i").groupBy("j").agg(r6(F.corr("v", "y"), "r"))


@query("SELECT gene, rep, round(avg(log2(ident + 10)), 6) AS x, round(avg(log2(report + 10)), 6) AS y FROM single GROUP BY ALL", "single")
def ag31_gene_cluster_mean(spark, d):
    return single(spark, d).groupBy("gene", "rep").agg(r6(F.avg(F.log2(F.col("ident") + 10)), "x"), r6(F.avg(F.log2(F.col("report") + 10)), "y"))


@query("SELECT floor(value / 10) AS x, event_type AS y FROM events GROUP BY ALL ORDER BY count(*) DESC, x, y LIMIT 1")
def ag32_fullest_cell(spark, d):
    c = read(spark, d, "events").groupBy(F.floor(F.col("value") / 10).cast("double").alias("x"), F.col("event_type").alias("y")).agg(F.count("*").alias("n"))
    return c.agg(F.min_by(F.struct("x", "y"), F.struct(-F.col("n"), "x", "y")).alias("c")).select("c.x", "c.y")


@query("SELECT l_linenumber AS code, count(*) AS n FROM lineitem GROUP BY 1")
def ag33_bin_counts(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("code")).agg(F.count("*").alias("n"))


# Windows, order, sets, shapes


@query("WITH l AS (SELECT p1, p2, barcode, rep, sum(report) AS b FROM dual GROUP BY ALL) SELECT p1, p2, barcode, rep, round(b / nullif(sum(b) OVER (PARTITION BY p1, p2), 0), 7) AS share FROM l", "dual")
def wn1_share_within_guide(spark, d):
    return screen.lineage_shares(dual(spark, d), DUAL).select(*DUAL.lineage, F.round("share_report", 7).alias("share"))


@query("SELECT gene, guide, row_number() OVER (PARTITION BY gene ORDER BY seen, guide) AS number FROM (SELECT gene, guide, min(barcode) AS seen FROM single GROUP BY ALL)", "single")
def wn2_number_in_group(spark, d):
    g = single(spark, d).groupBy("gene", "guide").agg(F.min("barcode").alias("seen"))
    return g.select("gene", "guide", F.row_number().over(Window.partitionBy("gene").orderBy("seen", "guide")).alias("number"))


@query("SELECT n_name, count(*) OVER (PARTITION BY n_regionkey) = 1 AS alone FROM nation")
def wn3_singletons(spark, d):
    return read(spark, d, "nation").select("n_name", (F.count("*").over(Window.partitionBy("n_regionkey")) == 1).alias("alone"))


@query("SELECT label, min(vec_id) AS seen, arg_min(vec_id % 3, vec_id) AS first_cluster FROM embeddings GROUP BY 1")
def wn6_first_seen(spark, d):
    return read(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("seen"), F.min_by(F.col("vec_id") % 3, "vec_id").alias("first_cluster"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment DESC, c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k = 1")
def wn7_tie_breaks(spark, d):
    best = F.min_by("c_custkey", F.struct(-F.col("c_acctbal"), "c_custkey"))
    top = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(best.alias("c_custkey"))
    return top.groupBy("c_nationkey").agg(F.max_by("c_custkey", "c_mktsegment").alias("c_custkey"))


@query("SELECT q, k FROM (SELECT s_suppkey AS q, n_nationkey AS k, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(s_acctbal / 400 - n_nationkey), n_nationkey) AS r FROM supplier, nation) WHERE r = 1")
def wn8_nearest(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("q"), (F.col("s_acctbal") / 400).alias("x"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return running.nearest(s, n.withColumn("c", F.col("k").cast("double")), "x", "c", "k").select("q", "k")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 5")
def wn9_top_in_group(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(spark, d, "customer").withColumn("k", F.row_number().over(w)).where("k <= 5").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS pos FROM nation")
def wn11_order_to_position(spark, d):
    return read(spark, d, "nation").select("n_name", (F.row_number().over(Window.orderBy("n_name")) - 1).alias("pos"))


@query("WITH p AS (SELECT n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_name) - 1 AS pos FROM nation) SELECT n_regionkey AS label, min(pos) AS start, max(pos) + 1 AS stop FROM p GROUP BY 1")
def wn12_blocks(spark, d):
    p = read(spark, d, "nation").select("n_regionkey", (F.row_number().over(Window.orderBy("n_regionkey", "n_name")) - 1).alias("pos"))
    return p.groupBy(F.col("n_regionkey").alias("label")).agg(F.min("pos").cast("long").alias("start"), (F.max("pos") + 1).cast("long").alias("stop"))


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER w AS step, event_type <> lag(event_type) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def wn14_differences(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(spark, d, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("step"), (F.col("event_type") != F.lag("event_type").over(w)).alias("changed"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 5) AS total, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS code FROM events")
def wn15_running_sum(spark, d):
    w = Window.partitionBy("user_id")
    total = F.sum("value").over(w.orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return read(spark, d, "events").select("user_id", "event_id", F.round(total, 5).alias("total"), F.dense_rank().over(w.orderBy("event_type")).alias("code"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sr1_sort(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 20 ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def sr2_largest(spark, d):
    return read(spark, d, "customer").where("c_nationkey < 20").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)


@query("SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 10")
def sr3_head(spark, d):
    return read(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").limit(10)


@query("WITH m AS (SELECT guide, avg(report) AS v FROM single GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY v, guide) AS r, count(*) OVER () AS n FROM m) SELECT guide FROM k WHERE r > n - floor(n * 10 / 100)", "single")
def sr4_top_percent(spark, d):
    m = single(spark, d).groupBy("guide").agg(F.avg("report").alias("v"))
    return screen_top(m, "v", "guide", 10)


def screen_top(df, value, tie, percent):
    from ..operators.views import top_percent

    return top_percent(df, value, tie, percent).select(tie)


@query("WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, (l_orderkey * 48271 + l_partkey * 16807 + l_suppkey * 69621 + 17) % 2147483647 AS h FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)) SELECT l_orderkey, l_partkey, l_suppkey FROM k ORDER BY h, l_orderkey, l_partkey, l_suppkey LIMIT 1000")
def sr6_sample_exactly(spark, d):
    from ..operators.sampling import exactly

    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    return exactly(rows, ["l_orderkey", "l_partkey", "l_suppkey"], 1000, seed=17)


@query("WITH k AS (SELECT o_orderkey, (o_orderkey * 48271 + 5) % 2147483647 AS h FROM orders) SELECT o_orderkey FROM k WHERE h < 2147483647 * 0.3")
def sr5_sample_fraction(spark, d):
    from ..operators.sampling import fraction

    return fraction(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.3, seed=5)


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def st1_union_all(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def st2_drop_duplicates(spark, d):
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query("SELECT p1 AS guide FROM dual UNION SELECT p2 FROM dual", "dual")
def st3_union_of_uniques(spark, d):
    x = dual(spark, d)
    return x.select(F.col("p1").alias("guide")).distinct().union(x.select("p2").distinct()).distinct()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def st4_difference(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("k")).subtract(read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT lang AS x, min(doc_id) AS seen FROM documents GROUP BY 1")
def st8_ordered_unique(spark, d):
    return read(spark, d, "documents").groupBy(F.col("lang").alias("x")).agg(F.min("doc_id").alias("seen")).orderBy("seen")


@query("SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM benchmark")
def st7_sort_unique(spark, d):
    return read(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).distinct()


@query("SELECT p1, rep, count(*) AS n FROM dual WHERE rep IN ('F', 'O') GROUP BY ALL", "dual")
def rs1_pivot_and_rs2_stack(spark, d):
    wide = dual(spark, d).groupBy("p1").pivot("rep", ["F", "O"]).agg(F.count("barcode"))
    return wide.unpivot(["p1"], ["F", "O"], "rep", "n").where("n is not null")


@query("SELECT gene, round(avg(log2(ident + 10)) FILTER (rep = 'F'), 6) AS ident_F, round(avg(log2(ident + 10)) FILTER (rep = 'O'), 6) AS \"ident_O\", round(avg(log2(report + 10)) FILTER (rep = 'F'), 6) AS report_F, round(avg(log2(report + 10)) FILTER (rep = 'O'), 6) AS \"report_O\" FROM single GROUP BY 1", "single")
def rs3_pivot_two_measures(spark, d):
    wide = single(spark, d).groupBy("gene").pivot("rep", ["F", "O"]).agg(*(r6(F.avg(F.log2(F.col(c) + 10)), c) for c in ("ident", "report")))
    return wide.select("gene", *(F.col(f"{r}_{m}").alias(f"{m}_{r}") for m in ("ident", "report") for r in ("F", "O")))


@query("SELECT barcode, CAST(rep = 'F' AS INT) AS \"rep_F\", CAST(rep = 'O' AS INT) AS \"rep_O\" FROM dual", "dual")
def rs4_one_hot(spark, d):
    rows, names = screen.one_hot(dual(spark, d), ["rep"], {"rep": ["F", "O"]})
    return rows.select("barcode", *names)


@query("SELECT j AS i, i AS j, round(v, 6) AS v FROM cells", "cells")
def rs7_transpose(spark, d):
    from .analogs import cells

    return cells(spark, d).select(F.col("j").alias("i"), F.col("i").alias("j"), r6(F.col("v"), "v"))


@query("SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place, unnest(string_split(text, chr(10))) AS line FROM documents")
def rs8_explode(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))


@query("SELECT i, j, round(v, 6) AS v FROM cells WHERE i <= j", "cells")
def rs9_upper_triangle(spark, d):
    from .analogs import cells

    return cells(spark, d).where("i <= j").select("i", "j", r6(F.col("v"), "v"))


@query("SELECT i, j, CASE WHEN i <> j THEN round(v, 6) END AS v FROM cells", "cells")
def rs10_mask_diagonal(spark, d):
    from .analogs import cells

    return cells(spark, d).select("i", "j", F.when(F.col("i") != F.col("j"), F.round("v", 6)).alias("v"))
