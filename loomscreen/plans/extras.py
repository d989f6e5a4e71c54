"""Smaller operators: membership, maps, masks, wraps, selectors and fit tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import matrix, models, ranks, screen
from ..sources import fastq, stored, tables
from ..sources.scratch import folder, settled
from . import workflows
from .analogs import CONTROL, DUAL, cells, dual, query, read, reads


def wrapped(x: Column, width: int) -> Column:
    """Labels broken at spaces into lines of at most ``width`` characters; longer words stay whole."""
    return F.rtrim(F.regexp_replace(x, rf"(\S{{{width},}}|.{{1,{width}}})(?:\s+|$)", "$1\n"), F.lit("\n"))


@query("SELECT n_regionkey, list_contains(list(n_name), 'NATION_7') AS has, len(list_intersect(list(n_name), ['NATION_1', 'NATION_2', 'NATION_3'])) AS common FROM nation GROUP BY 1")
def ar1_membership(spark, d):
    s = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_set("n_name").alias("names"))
    wanted = F.array(*(F.lit(f"NATION_{k}") for k in (1, 2, 3)))
    return s.select("n_regionkey", F.array_contains("names", "NATION_7").alias("has"), F.size(F.array_intersect("names", wanted)).cast("long").alias("common"))


@query("SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS id FROM region")
def mp1_inverted_map(spark, d):
    m = read(spark, d, "region").agg(F.map_from_entries(F.collect_list(F.struct(F.col("r_regionkey").cast("string"), "r_name"))).alias("m"))
    return m.select(F.explode("m").alias("id", "name")).select("name", "id")


@query("SELECT event_id, round(value, 6) AS x1, round(value * value, 4) AS x2, round(value * value * value, 2) AS x3 FROM events")
def mt8_powers(spark, d):
    p = models.powers(F.col("value"), 3)
    return read(spark, d, "events").select("event_id", F.round(p[0], 6).alias("x1"), F.round(p[1], 4).alias("x2"), F.round(p[2], 2).alias("x3"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 10 END AS x, coalesce(nullif(event_id % 4, 0), -1) AS filled FROM events")
def mt9_mt16_sentinels(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", F.nullif(F.col("event_id") % 10, F.lit(0)).alias("x"), F.coalesce(F.nullif(F.col("event_id") % 4, F.lit(0)), F.lit(-1)).alias("filled"))


@query("""WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS e FROM lineitem), k AS (SELECT unnest(range(0, 11)) AS i),
g AS (SELECT k.i, m.i AS j, a + (b - a) * k.i / 10 AS x, c + (e - c) * m.i / 10 AS y FROM k, k m, r),
n AS (SELECT CAST(round((l_quantity - a) / (b - a) * 10) AS BIGINT) AS i, CAST(round((l_extendedprice - c) / (e - c) * 10) AS BIGINT) AS j, count(*) AS n FROM lineitem, r GROUP BY ALL)
SELECT i, j, round(x, 4) AS x, round(y, 4) AS y, coalesce(n, 0) AS n FROM g LEFT JOIN n USING (i, j)""")
def mt13_grid(spark, d):
    """An 11 x 11 grid over the ranges of two columns, with the rows nearest to each of its points."""
    rows = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    ends = rows.agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"), F.min("l_extendedprice").alias("c"), F.max("l_extendedprice").alias("e"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long")))
    x, y = F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / 10, F.col("c") + (F.col("e") - F.col("c")) * F.col("j") / 10
    grid = ends.withColumn("i", k).withColumn("j", k).select("i", "j", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
    step = lambda v, lo, hi: F.round((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * 10).cast("long")
    near = rows.crossJoin(F.broadcast(ends)).groupBy(step("l_quantity", "a", "b").alias("i"), step("l_extendedprice", "c", "e").alias("j")).agg(F.count("*").alias("n"))
    return grid.join(near, ["i", "j"], "left").select("i", "j", "x", "y", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_id FROM events WHERE value > 50 AND event_type <> 'view'")
def snk4_kept_records(spark, d):
    path = folder(spark, "kept")
    read(spark, d, "events").where((F.col("value") > 50) & (F.col("event_type") != "view")).select("event_id").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS idx, n_name FROM nation")
def snk2_csv_with_index(spark, d):
    from ..operators.running import numbered

    path = folder(spark, "indexed")
    tables.write_table(numbered(read(spark, d, "nation"), "n_nationkey", "idx").select("idx", "n_name"), path)
    return tables.read_table(spark, path, "idx long, n_name string")


@query('SELECT event_id, CAST(event_type = \'click\' AS INT) AS event_type_click, CAST(event_type = \'view\' AS INT) AS event_type_view, round(value / 3, 6) AS third FROM events')
def rs5_rs6_dummies_beside_columns(spark, d):
    rows, names = screen.one_hot(read(spark, d, "events"), ["event_type"], {"event_type": ["click", "view"]})
    return rows.withColumns({"third": F.round(F.col("value") / 3, 6)}).select("event_id", *names, "third")


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS mid FROM events GROUP BY 1")
def rs12_split_by_group(spark, d):
    """One folder a group; a reader of one group opens no other's files."""
    path = folder(spark, "groups")
    read(spark, d, "events").select("event_type", "value").hint("rebalance", "event_type").write.partitionBy("event_type").parquet(path)
    return spark.read.schema("value double, event_type string").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("mid"))


@query(r"""SELECT item_id, rtrim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '(\S{40,}|.{1,40})(?:\s+|$)', E'\\1\n', 'g'), chr(10)) AS label FROM benchmark""")
def str16_wrapped_labels(spark, d):
    return read(spark, d, "benchmark").select("item_id", wrapped(F.regexp_replace("text", r"\s+", " "), 40).alias("label"))


@query("""WITH mem AS (SELECT DISTINCT n_regionkey AS cluster, n_name AS gene FROM nation, (VALUES (1), (2)) t(k)) SELECT a.cluster AS c1, b.cluster AS c2, round(avg(v), 6) AS v
FROM cells JOIN mem a ON a.gene = i JOIN mem b ON b.gene = j WHERE a.cluster <> b.cluster OR i <> j GROUP BY ALL""", "cells")
def mx18_from_significant_table(spark, d):
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("gene"))
    return matrix.complex_matrix(cells(spark, d), n.union(n).distinct()).where("v is not null").select("c1", "c2", F.round("v", 6).alias("v"))


@query("""WITH m AS (SELECT p1 AS i, p2 AS j, avg(log2(ident + 10)) AS v FROM dual GROUP BY ALL), mem AS (SELECT n_regionkey AS cluster, n_name AS gene FROM nation)
SELECT a.cluster AS c1, b.cluster AS c2, round(avg(v), 6) AS v FROM m JOIN mem a ON a.gene = i JOIN mem b ON b.gene = j WHERE a.cluster <> b.cluster OR i <> j GROUP BY ALL""", "dual")
def mx19_selected_matrix(spark, d):
    """The identity table instead of the reporter's."""
    m = dual(spark, d).groupBy(F.col("p1").alias("i"), F.col("p2").alias("j")).agg(F.avg(F.log2(F.col("ident") + 10)).alias("v"))
    n = read(spark, d, "nation").select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("gene"))
    return matrix.complex_matrix(m, n).where("v is not null").select("c1", "c2", F.round("v", 6).alias("v"))


@query()
def vz7_query_fit_table(spark, d):
    """Observed, expected and residual of every partner of every guide, with the residual's z in the guide's row."""
    m = settled(cells(spark, d), "cells")
    effects = matrix.single_effects(matrix.singles(m, CONTROL))
    pairs = matrix.symmetrise(matrix.guide_pairs(m, CONTROL), keep_single=True)
    resid = settled(models.per_gene(pairs, effects), "resid").withColumnRenamed("v", "resid")
    rows = pairs.join(resid, ["i", "j"]).withColumn("expected", F.col("v") - F.col("resid"))
    s = rows.groupBy("i").agg(F.stddev_pop("resid").alias("sigma"))
    return rows.join(s, "i").withColumn("z", F.try_divide("resid", "sigma"))


@query("SELECT event_type AS kind, event_id % 97 AS gene, count(*) AS n FROM events WHERE user_id % 3 = 0 GROUP BY ALL")
def src6_cell_population(spark, d):
    """A population stored and opened again: some cells' counts, summed by kind."""
    e = reads(spark, d)
    kind = e.select(F.concat_ws("/", "kind", F.col("cell").cast("string")).alias("cell"), "kind", F.col("cell").alias("user")).distinct()
    counts = e.groupBy(F.concat_ws("/", "kind", F.col("cell").cast("string")).alias("cell"), F.col("umi").alias("gene")).agg(F.count("*").alias("n"))
    path = folder(spark, "population")
    stored.Population(kind, counts.select("gene").distinct(), counts).save(path)
    return stored.Population.load(spark, path).where("user % 3 = 0").per_group("kind")


@query("SELECT p1, p2, count(DISTINCT (barcode, rep)) AS n_lineages, round(sum(report), 2) AS total FROM dual GROUP BY ALL", "dual")
def src7_stored_screen(spark, d):
    """A screen stored and opened again, its roles with it."""
    path = folder(spark, "screen")
    stored.save_screen(path, DUAL, molecules=dual(spark, d))
    spec, found = stored.load_screen(spark, path, "molecules")
    lineages = found["molecules"].groupBy(*spec.lineage).agg(F.sum(spec.reporter).alias("s"))
    return lineages.groupBy(*spec.guides).agg(F.count("*").alias("n_lineages"), F.round(F.sum("s"), 2).alias("total"))


@query("SELECT c_mktsegment AS name, count(*) AS records, count(*) FILTER (c_custkey % 10 = 0) AS faults FROM customer GROUP BY 1")
def src17_header_check(spark, d):
    """Records of several files, and those whose header lacks '@': every tenth customer's."""
    path, key = folder(spark, "header"), F.col("c_custkey")
    text = F.concat(F.when(key % 10 == 0, "").otherwise("@"), F.lit("r"), key.cast("string"), F.lit("\nACGT\n+\nIIII"))
    read(spark, d, "customer").select("c_mktsegment", text.alias("value")).repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(path)
    lines = settled(fastq.placed_lines(spark, path), "lines")
    name = F.regexp_extract("file", "c_mktsegment=([^/]+)/", 1).alias("name")
    faults = fastq.faulty(lines).groupBy(name).agg(F.count("*").alias("faults"))
    return lines.groupBy(name).agg((F.count("*") / 4).cast("long").alias("records")).join(faults, "name", "left").select("name", "records", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


@query("SELECT concat('s=', n_regionkey) AS sample FROM nation GROUP BY 1")
def src18_sample_folders(spark, d):
    """The folders of a listing, each a sample."""
    path = folder(spark, "samples")
    read(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("s")).write.partitionBy("s").csv(path)
    return tables.samples(spark, f"{path}/*/*.csv")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
SELECT a.vec_id, round(sqrt(list_sum(list_transform(a.e, lambda x: x * x))), 6) AS norm, round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS to_next
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def mt12_norms_and_distances(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("o")), "vec_id")
    size = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, c: acc + c * c))
    return both.select("vec_id", F.round(size(F.col("e")), 6).alias("norm"), F.round(size(F.zip_with("e", "o", lambda a, b: a - b)), 6).alias("to_next"))


@query("SELECT o_orderkey, CAST(floor(log10(o_totalprice)) AS BIGINT) AS exponent, CAST(floor(o_totalprice * 5 / 100) AS BIGINT) AS tail FROM orders WHERE o_totalprice > 0")
def mt14_floors(spark, d):
    """Powers of ten, and the size of a tail of 5 per cent."""
    price = F.col("o_totalprice")
    return read(spark, d, "orders").where(price > 0).select("o_orderkey", F.floor(F.log10(price)).alias("exponent"), F.floor(price * 5 / 100).alias("tail"))


@query("""WITH e AS (SELECT user_id, value - 50 AS r FROM events WHERE value IS NOT NULL)
SELECT user_id, round(sum(CASE WHEN abs(r) <= 1.35 THEN 0.5 * r * r ELSE 1.35 * (abs(r) - 0.5 * 1.35) END), 4) AS loss FROM e GROUP BY 1""")
def mt11_huber_loss(spark, d):
    r = F.col("value") - 50
    return read(spark, d, "events").where("value is not null").groupBy("user_id").agg(F.round(F.sum(models.huber_loss(r, 1.35)), 4).alias("loss"))


@query("SELECT p1, p2, count(DISTINCT barcode) AS n_lineages FROM dual GROUP BY ALL", "dual")
def pl5_other_lineage_columns(spark, d):
    """Lineages without the replicate, by a changed spec."""
    spec = DUAL.with_(rep=None)
    return workflows.counts.measurement_counts(dual(spark, d), list(spec.guides), spec.lineage)


@query("""WITH g AS (SELECT DISTINCT p1, p2, barcode, rep FROM dual), r AS (SELECT n_name AS p1, n_nationkey / 100.0 AS repr FROM nation)
SELECT p1, p2, count(*) AS n_lineages, any_value(coalesce(repr, 0)) AS repr FROM g LEFT JOIN r USING (p1) GROUP BY ALL""", "dual")
def pl9_opened_screen(spark, d):
    """Validated rows, merged with a representation, and their measurement counts."""
    rep = read(spark, d, "nation").select(F.col("n_name").alias("p1"), (F.col("n_nationkey") / 100.0).alias("repr"))
    rows = screen.with_representation(workflows.validate(dual(spark, d), DUAL), rep, ["p1"])
    n = workflows.counts.measurement_counts(rows, list(DUAL.guides), DUAL.lineage)
    return n.join(rows.groupBy(*DUAL.guides).agg(F.first("repr").alias("repr")), list(DUAL.guides))
