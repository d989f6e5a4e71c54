"""Rank tests, matrices, models, recall and plot tables as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cluster, counts, lowrank, matrix, models, network, ranks, recall, running, sampling, screen, views
from ..sources.scratch import settled
from .analogs import CONTROL, DUAL, cells, dual, query, read, single


def r6(x, name):
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


# Ranks


@query("SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY floor(value)) + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / CAST(2 AS DOUBLE) AS rank FROM events")
def wn4_average_rank(spark, d):
    e = read(spark, d, "events").withColumn("x", F.floor("value"))
    return e.select("event_id", ranks.average_rank("x", "event_type").alias("rank"))


_MWU = """g AS (SELECT event_type AS k, floor(value) AS x FROM events), pairs AS (SELECT a.k AS g, c.k AS c, a.x, 1 AS mine FROM g a, (SELECT DISTINCT k FROM g WHERE k IN ('click', 'view')) c
UNION ALL SELECT a.k, c.k, c.x, 0 FROM (SELECT DISTINCT k FROM g) a, g c WHERE c.k IN ('click', 'view')),
r AS (SELECT *, rank() OVER (PARTITION BY g, c ORDER BY x) + (count(*) OVER (PARTITION BY g, c, x) - 1) / CAST(2 AS DOUBLE) AS rk, count(*) OVER (PARTITION BY g, c, x) AS t FROM pairs),
s AS (SELECT g, c, CAST(sum(mine) AS DOUBLE) AS n1, CAST(count(*) - sum(mine) AS DOUBLE) AS n2, sum(CASE WHEN mine = 1 THEN rk ELSE 0 END) AS r1, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY ALL),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s),
z AS (SELECT g, c, u, u / (n1 * n2) AS cles, 2 * u / (n1 * n2) - 1 AS rbc, greatest(abs(least(u, n1 * n2 - u) - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)"""


@query(f"WITH {_MWU} SELECT g, c, round(u, 3) AS u, round(cles, 6) AS cles, round(rbc, 6) AS rbc, round(z, 6) AS z FROM z")
def ml07_rank_test(spark, d):
    e = read(spark, d, "events").select("event_type", F.floor("value").alias("x"))
    t = ranks.mann_whitney(e, "event_type", "x", e.where(F.col("event_type").isin("click", "view")))
    return t.select("g", "c", F.round("u", 3).alias("u"), r6("cles", "cles"), r6("rbc", "rbc"), r6("z", "z"))


@query(f"WITH {_MWU} SELECT g AS event_type, round(median(cles), 6) AS cles, round(median(rbc), 6) AS rbc FROM z GROUP BY g")
def ml09_against_controls(spark, d):
    e = read(spark, d, "events").select("event_type", F.floor("value").alias("x"))
    t = ranks.against_controls(e, e.where(F.col("event_type").isin("click", "view")), "event_type", ["x"])
    return t.select("event_type", r6("cles", "cles"), r6("rbc", "rbc"))


@query("WITH k AS (SELECT l_linenumber, count(*) AS t FROM lineitem GROUP BY 1) SELECT CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM k")
def ml10_tie_term(spark, d):
    return ranks.tie_term(read(spark, d, "lineitem"), "l_linenumber")


@query("""WITH p AS (SELECT event_type, event_id, value / 1013 AS p FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM p)
SELECT event_type, event_id, round(least(1, min(p * n / k) OVER (PARTITION BY event_type ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 8) AS p_adj FROM r""")
def wn10_false_discovery(spark, d):
    p = read(spark, d, "events").select("event_type", "event_id", (F.col("value") / 1013).alias("p"))
    return ranks.bh_adjust(p, "p", "q", "event_type").select("event_type", "event_id", F.round("q", 8).alias("p_adj"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n, round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - corr(l_quantity, l_extendedprice) ** 2)), 3) AS t FROM lineitem")
def ml12_pearson(spark, d):
    return ranks.pearson_test(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r6("r", "r"), "n", F.round("t", 3).alias("t"))


# Matrices


@query("SELECT a.i, a.j, round((a.v + b.v) / 2, 6) AS v FROM cells a JOIN cells b ON a.i = b.j AND a.j = b.i", "cells")
def rs13_symmetrise(spark, d):
    return matrix.symmetrise(cells(spark, d)).select("i", "j", r6("v", "v"))


@query("SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, round(CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE (a.v + b.v) / 2 END, 6) AS v FROM cells a FULL JOIN cells b ON a.i = b.j AND a.j = b.i WHERE coalesce(a.i, b.j) <> coalesce(a.j, b.i)", "cells")
def ml05_symmetrise_keep_single(spark, d):
    return matrix.symmetrise(cells(spark, d), keep_single=True, mask_diagonal=True).select("i", "j", r6("v", "v"))


_SINGLES = """cg AS (SELECT i AS control, j AS guide, v FROM cells WHERE i LIKE 'NATION_2%' AND j NOT LIKE 'NATION_2%'), gc AS (SELECT j AS control, i AS guide, v FROM cells WHERE j LIKE 'NATION_2%' AND i NOT LIKE 'NATION_2%'),
sg AS (SELECT control, guide, CASE WHEN cg.v IS NULL THEN gc.v WHEN gc.v IS NULL THEN cg.v ELSE (cg.v + gc.v) / 2 END AS v FROM cg FULL JOIN gc USING (control, guide))"""


@query(f"WITH {_SINGLES} SELECT control, guide, round(v, 6) AS v FROM sg", "cells")
def jn04_swapped_full_outer(spark, d):
    return matrix.singles(cells(spark, d), CONTROL).select("control", "guide", r6("v", "v"))


@query(f"WITH {_SINGLES} SELECT guide, round(avg(v), 6) AS x FROM sg GROUP BY 1", "cells")
def ml06_single_effects(spark, d):
    return matrix.single_effects(matrix.singles(cells(spark, d), CONTROL)).select("guide", r6("x", "x"))


@query(f"WITH {_SINGLES}, e AS (SELECT guide, avg(v) AS x FROM sg GROUP BY 1) SELECT a.guide AS i, b.guide AS j, round(0.5 * (a.x * a.x + b.x * b.x) - 2 * (a.x + b.x) + 0.25 * a.x * b.x, 5) AS v FROM e a, e b", "cells")
def mx20_expected_surface(spark, d):
    e = matrix.single_effects(matrix.singles(cells(spark, d), CONTROL))
    return matrix.expected_joint(e, 0.5, -2.0, 0.25).select("i", "j", F.round("v", 5).alias("v"))


@query("SELECT i, j, round(v, 6) AS v FROM cells WHERE i NOT LIKE 'NATION_2%' AND j NOT LIKE 'NATION_2%'", "cells")
def mx14_guide_pairs(spark, d):
    return matrix.guide_pairs(cells(spark, d), CONTROL).select("i", "j", r6("v", "v"))


@query("SELECT p1 AS i, p2 AS j, round(avg(log2(report + 10)), 6) AS reporter, round(avg(log2(ident + 10)), 6) AS identity FROM dual GROUP BY ALL", "dual")
def mx13_activity_matrices(spark, d):
    x = screen.log_transform(dual(spark, d), ["ident", "report"])
    return x.groupBy(F.col("p1").alias("i"), F.col("p2").alias("j")).agg(r6(F.avg("log2_report"), "reporter"), r6(F.avg("log2_ident"), "identity"))


@query("SELECT i, j, round(v / nullif(stddev_pop(v) OVER (), 0), 5) AS z FROM cells", "cells")
def ag27_population_z(spark, d):
    return matrix.z_of_all(cells(spark, d)).select("i", "j", F.round("z", 5).alias("z"))


_COS = "cs AS (SELECT a.i AS a, b.i AS b, sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 0) AS v, corr(a.v, b.v) AS r, count(*) AS n FROM cells a JOIN cells b USING (j) WHERE a.i < b.i GROUP BY ALL)"


@query(f"WITH {_COS} SELECT a, b, round(v, 8) AS v FROM cs", "cells")
def mx1_cosine_shared(spark, d):
    return matrix.cosine(cells(spark, d)).select("a", "b", F.round("v", 8).alias("v"))


@query(f"WITH {_COS}, l AS (SELECT a AS x FROM cs UNION SELECT b FROM cs) SELECT i, j, round(v, 8) AS v FROM (SELECT a AS i, b AS j, v FROM cs UNION ALL SELECT b, a, v FROM cs UNION ALL SELECT x, x, 1 FROM l)", "cells")
def mx2_cosine_matrix(spark, d):
    return matrix.as_square(matrix.cosine(cells(spark, d))).select("i", "j", F.round("v", 8).alias("v"))


@query(f"WITH {_COS} SELECT a, b, round(least(greatest(1 - coalesce(v, 0), 0), 2), 8) AS v FROM cs", "cells")
def mx3_distance(spark, d):
    return matrix.distance(matrix.cosine(cells(spark, d))).select("a", "b", F.round("v", 8).alias("v"))


@query("""WITH l AS (SELECT i AS x FROM cells UNION SELECT j FROM cells), g AS (SELECT a.x AS i, b.x AS j, coalesce(v, 0) AS v FROM l a CROSS JOIN l b LEFT JOIN cells ON cells.i = a.x AND cells.j = b.x)
SELECT a.i AS a, b.i AS b, round(sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 0), 8) AS v FROM g a JOIN g b USING (j) WHERE a.i < b.i GROUP BY ALL""", "cells")
def mx6_dense_cosine(spark, d):
    g = matrix.grid(cells(spark, d)).na.fill(0.0, ["v"])
    return matrix.cosine(g).select("a", "b", F.round("v", 8).alias("v"))


@query(f"WITH {_COS} SELECT a, b, round(r, 6) AS v FROM cs", "cells")
def mx7_row_correlation(spark, d):
    x = matrix.correlation(cells(spark, d))
    return x.select("a", "b", r6(F.when(~F.isnan("v"), F.col("v")), "v"))


@query("""WITH p AS (SELECT a.i AS a, b.i AS b, j, a.v AS x, b.v AS y FROM cells a JOIN cells b USING (j) WHERE a.i < b.i), r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) AS ry FROM p)
SELECT a, b, round(corr(rx, ry), 6) AS v FROM r GROUP BY ALL""", "cells")
def mx7_spearman(spark, d):
    x = matrix.spearman(cells(spark, d))
    return x.select("a", "b", r6(F.when(~F.isnan("v"), F.col("v")), "v"))


@query("""WITH p AS (SELECT a.i AS a, b.i AS b, j, a.v AS x, b.v AS y FROM cells a JOIN cells b USING (j) WHERE a.i < b.i), l AS (SELECT DISTINCT a, b FROM p),
s AS (SELECT p.a, p.b, sign(p.x - q.x) AS sx, sign(p.y - q.y) AS sy FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.j < q.j)
SELECT l.a, l.b, round(sum(sx * sy) / nullif(sqrt(CAST(sum(sx * sx) AS DOUBLE) * sum(sy * sy)), 0), 6) AS v FROM l LEFT JOIN s ON l.a = s.a AND l.b = s.b GROUP BY ALL""", "cells")
def mx7_kendall(spark, d):
    return matrix.kendall(cells(spark, d)).select("a", "b", r6("v", "v"))


@query("SELECT i, j, round(sign(v) * greatest(abs(v) - 15, 0), 6) AS v FROM cells", "cells")
def mx9_soft_threshold(spark, d):
    return cells(spark, d).select("i", "j", F.round(matrix.soft(F.col("v"), 15.0), 6).alias("v"))


@query("SELECT i, j, round(v, 6) AS v FROM cells a WHERE EXISTS (SELECT 1 FROM cells b WHERE b.i = a.j AND b.j = a.i)", "cells")
def rs11_masked_as(spark, d):
    m = cells(spark, d)
    return matrix.masked_as(m, matrix.transposed(m)).select("i", "j", r6("v", "v"))


@query("WITH l AS (SELECT i AS x FROM cells UNION SELECT j FROM cells) SELECT a.x AS i, b.x AS j, round(v, 6) AS v FROM l a CROSS JOIN l b LEFT JOIN cells ON i = a.x AND j = b.x", "cells")
def rs14_full_grid(spark, d):
    return matrix.grid(cells(spark, d)).select("i", "j", r6("v", "v"))


@query("SELECT i AS label FROM cells UNION SELECT j FROM cells", "cells")
def st5_label_union(spark, d):
    return matrix.labels(cells(spark, d))


@query("WITH o AS (SELECT n_name AS x, row_number() OVER (ORDER BY n_regionkey, n_name) AS p FROM nation) SELECT a.p AS pi, b.p AS pj, round(v, 6) AS v FROM cells JOIN o a ON a.x = i JOIN o b ON b.x = j", "cells")
def sr8_reorder(spark, d):
    order = read(spark, d, "nation").select(F.col("n_name").alias("label"), F.row_number().over(Window.orderBy("n_regionkey", "n_name")).alias("position"))
    return matrix.reordered(cells(spark, d), order).select("pi", "pj", r6("v", "v"))


_MEMBERS = "mem AS (SELECT n_regionkey AS cluster, n_name AS gene FROM nation UNION ALL SELECT 9, n_name FROM nation WHERE n_nationkey % 6 = 0 UNION ALL SELECT 10, 'NO_SUCH_GENE')"


def _members(spark, d):
    n = read(spark, d, "nation")
    extra = n.where("n_nationkey % 6 = 0").select(F.lit(9).alias("cluster"), F.col("n_name").alias("gene"))
    lost = spark.createDataFrame([(10, "NO_SUCH_GENE")], "cluster int, gene string")
    return n.select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("gene")).unionByName(extra).unionByName(lost)


@query(f"""WITH {_MEMBERS}, v AS (SELECT a.cluster AS c1, b.cluster AS c2, avg(v) AS v FROM cells JOIN mem a ON a.gene = i JOIN mem b ON b.gene = j WHERE a.cluster <> b.cluster OR i <> j GROUP BY ALL),
k AS (SELECT DISTINCT cluster FROM mem WHERE gene IN (SELECT i FROM cells UNION SELECT j FROM cells)) SELECT a.cluster AS c1, b.cluster AS c2, round(v, 6) AS v FROM k a CROSS JOIN k b LEFT JOIN v ON c1 = a.cluster AND c2 = b.cluster""", "cells")
def mx17_complex_matrix(spark, d):
    return matrix.complex_matrix(cells(spark, d), _members(spark, d)).select("c1", "c2", r6("v", "v"))


# Models


@query("WITH x AS (SELECT p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%' AS control, log2(ident + 10) AS x, log2(report + 10) AS y, p1 FROM dual), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x WHERE control) SELECT p1, round(avg(y - a - b * x), 6) AS resid FROM x, f GROUP BY 1", "dual")
def ml02_regress_reporter(spark, d):
    rows = screen.set_control(screen.log_transform(dual(spark, d), ["ident", "report"]), ["p1", "p2"], CONTROL)
    out, _ = models.regress_reporter(rows, DUAL, [])
    return out.groupBy("p1").agg(r6(F.avg("log2_reporter_resid"), "resid"))


@query("SELECT round(regr_r2(log2(report + 10), log2(ident + 10)), 6) AS r2, count(*) AS n FROM dual", "dual")
def ml21_fit_quality(spark, d):
    rows = screen.log_transform(dual(spark, d), ["ident", "report"])
    fit = models.ols(rows, [F.col("log2_ident")], F.col("log2_report"))
    return spark.createDataFrame([(round(fit["r2"], 6), fit["n"])], "r2 double, n long")


# The penalised likelihood's only minimum, by 3000 gradient steps scaled by a third of each coefficient's curvature.
@query("""WITH ctl AS (SELECT sample, rep, count(ident) AS n, sum(CAST(ident AS DOUBLE)) AS y FROM dual WHERE p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%' GROUP BY ALL),
cell AS MATERIALIZED (SELECT list(n ORDER BY sample, rep) AS n, list(y ORDER BY sample, rep) AS y, list(sample ORDER BY sample, rep) AS s, list(rep ORDER BY sample, rep) AS r, sum(n) AS total, sum(y) AS ys, list_sort(list(DISTINCT sample)) AS sl, list_sort(list(DISTINCT rep)) AS rl FROM ctl),
fit AS MATERIALIZED (WITH RECURSIVE it AS (
  SELECT 0 AS k, ln(ys / total) AS b0, list_transform(sl, lambda x: 0.0::DOUBLE) AS bs, list_transform(rl, lambda x: 0.0::DOUBLE) AS br FROM cell
  UNION ALL
  SELECT k + 1, b0 - (list_sum(mu) - ys) / (3 * list_sum(mu)),
    list_transform(bs, lambda b, a: b - (list_sum(list_transform(mu, lambda m, i: CASE WHEN s[i] = sl[a] THEN m - y[i] ELSE 0 END)) / total + b) / (3 * (list_sum(list_transform(mu, lambda m, i: CASE WHEN s[i] = sl[a] THEN m ELSE 0 END)) / total + 1))),
    list_transform(br, lambda b, a: b - (list_sum(list_transform(mu, lambda m, i: CASE WHEN r[i] = rl[a] THEN m - y[i] ELSE 0 END)) / total + b) / (3 * (list_sum(list_transform(mu, lambda m, i: CASE WHEN r[i] = rl[a] THEN m ELSE 0 END)) / total + 1)))
  FROM (SELECT *, list_transform(n, lambda x, i: x * exp(b0 + bs[list_position(sl, s[i])] + br[list_position(rl, r[i])])) AS mu FROM it, cell WHERE k < 3000))
  SELECT * FROM it WHERE k = 3000),
res AS (SELECT p1, ident, ident - exp(b0 + coalesce(bs[list_position(sl, sample)], 0) + coalesce(br[list_position(rl, rep)], 0)) AS e FROM dual, fit, cell),
b AS (SELECT min(e) AS a, max(e) AS z, min(ident) AS lo, max(ident) AS hi FROM res)
SELECT p1, round(avg(log2((e - a) / nullif(z - a, 0) * (hi - lo) + lo + 1)), 6) AS identity FROM res, b GROUP BY 1""", "dual")
def ml01_poisson_residuals(spark, d):
    rows = screen.set_control(dual(spark, d), ["p1", "p2"], CONTROL)
    rows, names = screen.one_hot(rows, ["sample", "rep"])
    return models.regress_identity_poisson(rows, DUAL, names).groupBy("p1").agg(r6(F.avg("log2_identity_resid_rescaled"), "identity"))


def _interactions(spark, d, method):
    m = settled(cells(spark, d), "cells")
    return models.interactions(matrix.symmetrise(matrix.guide_pairs(m, CONTROL), keep_single=True), matrix.singles(m, CONTROL), method)


@query()
def ml03_joint_interactions(spark, d):
    return _interactions(spark, d, "joint")


@query()
def ml04_per_gene_interactions(spark, d):
    return _interactions(spark, d, "per_gene")


@query()
def mx11_low_rank(spark, d):
    m = dual(spark, d).groupBy("rep", F.col("p1").alias("i"), F.col("p2").alias("j")).agg(F.avg(F.log2(F.col("report") + 10)).alias("v"))
    return lowrank.split_matrices(m, "rep")


@query()
def mx4_linkage(spark, d):
    return cluster.order_of(spark, matrix.as_square(matrix.distance(matrix.cosine(cells(spark, d))), 0.0))[0]


@query()
def mx5_leaf_order(spark, d):
    return cluster.order_of(spark, matrix.as_square(matrix.distance(matrix.cosine(cells(spark, d))), 0.0))[1]


@query()
def pl08_dual_screen(spark, d):
    """Lineage filter, controls, residuals, activity matrix, low-rank denoising and interactions in one run."""
    from .workflows import standard_dual

    return standard_dual(dual(spark, d), DUAL.with_(samples=("rep",)), prefix=CONTROL, pcp=True, method="per_gene").interactions


# Least squares with a full set of replicate dummies is that of values off their replicate's mean; the Poisson fit is ml01's with replicates alone.
@query("""WITH lin AS (SELECT guide, barcode, rep, sum(ident) AS a, sum(report) AS b FROM single GROUP BY ALL),
sh AS (SELECT *, a / nullif(sum(a) OVER (PARTITION BY guide), 0) AS ra, b / nullif(sum(b) OVER (PARTITION BY guide), 0) AS rb FROM lin),
th AS (SELECT greatest(avg(coalesce(ra, 0)) + 3 * stddev_samp(coalesce(ra, 0)), CAST(0.05 AS DOUBLE)) AS ta, greatest(avg(coalesce(rb, 0)) + 3 * stddev_samp(coalesce(rb, 0)), CAST(0.05 AS DOUBLE)) AS tb FROM sh),
kept AS (SELECT guide, barcode, rep FROM sh, th WHERE ra < ta AND rb < tb),
r AS MATERIALIZED (SELECT guide, rep, guide LIKE 'Brand#1%' AS control, CAST(ident AS DOUBLE) AS ident, log2(ident + 10) AS x, log2(report + 10) AS y FROM single s WHERE EXISTS (SELECT 1 FROM kept k WHERE k.guide = s.guide AND k.barcode = s.barcode AND k.rep = s.rep)),
mean AS MATERIALIZED (SELECT rep, avg(x) AS mx, avg(x * x) AS mq, avg(y) AS my FROM r WHERE control GROUP BY 1),
sums AS (SELECT sum(u * u) AS uu, sum(u * q) AS uq, sum(q * q) AS qq, sum(u * v) AS uv, sum(q * v) AS qv FROM (SELECT x - mx AS u, x * x - mq AS q, y - my AS v FROM r JOIN mean USING (rep) WHERE control)),
line AS (SELECT (qq * uv - uq * qv) / (uu * qq - uq * uq) AS b1, (uu * qv - uq * uv) / (uu * qq - uq * uq) AS b2 FROM sums),
cell AS MATERIALIZED (SELECT list(k ORDER BY rep) AS n, list(t ORDER BY rep) AS ts, list(rep ORDER BY rep) AS rl, sum(k) AS total, sum(t) AS ys FROM (SELECT rep, count(ident) AS k, sum(ident) AS t FROM r WHERE control GROUP BY 1)),
fit AS MATERIALIZED (WITH RECURSIVE it AS (
  SELECT 0 AS k, ln(ys / total) AS b0, list_transform(rl, lambda x: 0.0::DOUBLE) AS br FROM cell
  UNION ALL
  SELECT k + 1, b0 - (list_sum(mu) - ys) / (3 * list_sum(mu)), list_transform(br, lambda b, a: b - ((mu[a] - ts[a]) / total + b) / (3 * (mu[a] / total + 1)))
  FROM (SELECT *, list_transform(n, lambda x, i: x * exp(b0 + br[i])) AS mu FROM it, cell WHERE k < 3000))
  SELECT b0, br FROM it WHERE k = 3000),
res AS (SELECT guide, control, ident, ident - exp(b0 + br[list_position(rl, rep)]) AS e, y - my - b1 * (x - mx) - b2 * (x * x - mq) AS resid FROM r JOIN mean USING (rep), line, fit, cell),
ends AS (SELECT min(e) AS a, max(e) AS z, min(ident) AS lo, max(ident) AS hi FROM res),
g AS (SELECT guide, control, avg((e - a) / nullif(z - a, 0) * (hi - lo) + lo) AS identity, avg(resid) AS reporter FROM res, ends GROUP BY ALL),
c AS (SELECT avg(identity) FILTER (control) AS m1, stddev_samp(identity) FILTER (control) AS s1, avg(reporter) FILTER (control) AS m2, stddev_samp(reporter) FILTER (control) AS s2 FROM g)
SELECT guide, control, round(identity, 6) AS identity, round(reporter, 6) AS reporter, round((identity - m1) / nullif(s1, 0), 5) AS identity_z, round((reporter - m2) / nullif(s2, 0), 5) AS reporter_z FROM g, c""", "single")
def pl07_single_screen(spark, d):
    """Lineage filter, controls, both regressions and the guides' summary in one run."""
    from ..spec import ScreenSpec
    from .workflows import standard_single

    spec = ScreenSpec(guides=("guide",), barcodes=("barcode",), identity="ident", reporter="report", samples=("rep",), rep="rep")
    t = standard_single(single(spark, d), spec, prefix="Brand#1", degree=2).summary
    return t.select("guide", "control", r6("identity", "identity"), r6("reporter", "reporter"), F.round("identity_z", 5).alias("identity_z"), F.round("reporter_z", 5).alias("reporter_z"))


# Recall


def _order(spark, d):
    e = read(spark, d, "embeddings")
    e = running.numbered(e.select("label", "vec_id", F.struct("label", "vec_id").alias("_o")), "_o", "pos")
    return e.select((F.col("pos") - 1).alias("pos"), F.col("vec_id").alias("guide"), F.concat_ws("_", F.col("label").cast("string"), (F.col("vec_id") % 4).cast("string")).alias("gene"))


def _sets(spark):
    x = F.floor(F.col("id") / 4)
    return spark.range(40).select(F.concat(F.lit("c"), (x % 6).cast("string")).alias("cluster"), F.concat_ws("_", x.cast("string"), (F.col("id") % 4).cast("string")).alias("gene"))


_ORDER = "ord AS (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS pos, vec_id AS guide, 'c' || (label % 6) AS cluster FROM embeddings)"


@query(f"WITH {_ORDER} SELECT a.guide, a.pos, a.cluster, round(avg(CAST(b.cluster = a.cluster AS DOUBLE)), 8) AS score FROM ord a JOIN ord b ON b.pos BETWEEN a.pos - 20 AND a.pos + 20 AND b.pos <> a.pos GROUP BY ALL")
def wn5_ml14_observed_recall(spark, d):
    return recall.observed(_order(spark, d), _sets(spark)).select("guide", "pos", "cluster", F.round("score", 8).alias("score"))


@query()
def ml13_recall(spark, d):
    return recall.permutation_recall(_order(spark, d), _sets(spark))[1]


@query()
def ml17_joint_recall(spark, d):
    sets = _sets(spark).withColumn("set_name", F.when(F.col("cluster") < "c3", "one").otherwise("two"))
    return recall.joint(_order(spark, d), sets)[1]


@query(f"""WITH {_ORDER}, k AS (SELECT vec_id FROM embeddings WHERE embedding[1] > 0.2), s AS (SELECT cluster, pos FROM ord JOIN k ON vec_id = guide) SELECT DISTINCT o.cluster, o.pos, o.guide IN (SELECT vec_id FROM k) AS scored FROM ord o JOIN s ON s.cluster = o.cluster AND abs(o.pos - s.pos) <= 15""")
def ml16_expand(spark, d):
    x = _order(spark, d).join(_sets(spark), "gene").select("cluster", F.col("guide").alias("gene"), "pos")
    hits = read(spark, d, "embeddings").where("embedding[0] > 0.2").select(F.col("vec_id").alias("gene"))
    grown = recall.expand(x.join(hits, "gene", "left_semi").withColumn("score", F.lit(1.0)), x, 15)
    return grown.select("cluster", "pos", F.col("score").isNotNull().alias("scored"))


_ROWS = """x AS (SELECT c_nationkey AS gene, c_nationkey * 7 AS pos, c_mktsegment AS cluster, max(c_acctbal) AS score FROM customer GROUP BY ALL),
m AS (SELECT cluster, median(pos) AS mid, count(*) AS n FROM x GROUP BY 1), y AS (SELECT *, abs(pos - mid) AS far, min(cluster) OVER (PARTITION BY gene, pos) = cluster AS seen FROM x JOIN m USING (cluster))"""


@query(f"WITH {_ROWS} SELECT gene, pos, cluster FROM (SELECT *, row_number() OVER (PARTITION BY gene, pos ORDER BY far <= 80 DESC, CASE WHEN far <= 80 THEN -n END NULLS FIRST, CASE WHEN far <= 80 THEN -coalesce(score, 0) END NULLS FIRST, CASE WHEN far <= 80 THEN CAST(NOT seen AS INT) END NULLS FIRST, CASE WHEN far > 80 THEN far END NULLS FIRST, cluster) AS k FROM y) WHERE k = 1")
def ml15_assign(spark, d):
    x = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("gene"), (F.col("c_nationkey") * 7).alias("pos"), F.col("c_mktsegment").alias("cluster")).agg(F.max("c_acctbal").alias("score"))
    return recall.assign(x).select("gene", "pos", "cluster")


# Plot tables


@query("WITH q AS (SELECT quantile_cont(c_acctbal, CAST(0.01 AS DOUBLE)) AS a, quantile_cont(c_acctbal, CAST(0.99 AS DOUBLE)) AS b FROM customer) SELECT c_custkey, c_acctbal > b AS high FROM customer, q WHERE c_acctbal < a OR c_acctbal > b")
def vz1_outliers(spark, d):
    x = screen.with_scalars(read(spark, d, "customer"), F.percentile("c_acctbal", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    return x.where((F.col("c_acctbal") < F.col("q")[0]) | (F.col("c_acctbal") > F.col("q")[1])).select("c_custkey", (F.col("c_acctbal") > F.col("q")[1]).alias("high"))


@query(f"WITH {_MEMBERS} SELECT cluster, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n FROM cells JOIN mem ON gene = i GROUP BY 1", "cells")
def vz2_cluster_bars(spark, d):
    x = cells(spark, d).join(_members(spark, d).withColumnRenamed("gene", "i"), "i")
    return views.mean_sem(x, ["cluster"], "v").select("cluster", r6("mean", "mean"), r6("sem", "sem"), "n")


@query("SELECT i, j, CASE WHEN i <= j THEN 'reporter' ELSE 'identity' END AS part, round(CASE WHEN i <= j THEN a ELSE b END, 6) AS v FROM (SELECT p1 AS i, p2 AS j, avg(log2(report + 10)) AS a, avg(log2(ident + 10)) AS b FROM dual GROUP BY ALL)", "dual")
def vz4_split_matrix(spark, d):
    m = screen.log_transform(dual(spark, d), ["ident", "report"]).groupBy(F.col("p1").alias("i"), F.col("p2").alias("j")).agg(F.avg("log2_report").alias("a"), F.avg("log2_ident").alias("b"))
    upper = m.where("i <= j").select("i", "j", F.lit("reporter").alias("part"), r6("a", "v"))
    return upper.unionByName(m.where("i > j").select("i", "j", F.lit("identity").alias("part"), r6("b", "v")))


@query("SELECT i, j, round(v / nullif(stddev_samp(v) OVER (), 0), 5) AS v FROM cells WHERE i <= j", "cells")
def vz5_scaled_half(spark, d):
    return screen.with_scalars(cells(spark, d).where("i <= j"), F.stddev_samp("v").alias("s")).select("i", "j", F.round(F.try_divide("v", "s"), 5).alias("v"))


@query("""WITH t AS (SELECT concat(p_brand, p_partkey) AS term, p_brand AS x, p_retailprice / 3000 AS p, concat(p_size, '/', p_partkey) AS o, p_size / CAST(nullif(p_partkey, 0) AS DOUBLE) AS ratio FROM part), k AS (SELECT *, log10(1 / greatest(least(p, 1), 1e-5)) AS p_inv FROM t WHERE p <= 0.5)
SELECT term AS "Term", round(p_inv, 6) AS p_inv, round(ratio, 6) AS "Hits_ratio" FROM k QUALIFY row_number() OVER (PARTITION BY x ORDER BY p_inv DESC, term) <= 4""")
def vz9_term_table(spark, d):
    t = read(spark, d, "part").select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("Term"), F.col("p_brand").alias("x"), (F.col("p_retailprice") / 3000).alias("p"), F.concat_ws("/", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")).alias("Overlap"))
    return views.term_table(t, "p", 0.5, 4, by="x").select("Term", r6("p_inv", "p_inv"), r6("Hits_ratio", "Hits_ratio"))


@query()
def vz11_axis_orders(spark, d):
    """Both axes of a dot plot of brands and types: the mean price of each pair, items ordered by single linkage."""
    t = read(spark, d, "part").groupBy("p_brand", "p_type").agg((F.avg("p_retailprice") / 1000).alias("v"))
    x, y = views.axis_order(t, "p_brand", "p_type", "v"), views.axis_order(t, "p_type", "p_brand", "v")
    return x.withColumn("axis", F.lit("x")).unionByName(y.withColumn("axis", F.lit("y"))).select("axis", "position", "label")


@query("""WITH g AS (SELECT DISTINCT p_brand AS t, p_size AS x FROM part), n AS (SELECT t, count(*) AS n FROM g GROUP BY 1)
SELECT a.t AS a, b.t AS b, count(*) AS shared, round(count(*) / CAST(any_value(na.n) + any_value(nb.n) - count(*) AS DOUBLE), 6) AS jaccard, round(count(*) / CAST(least(any_value(na.n), any_value(nb.n)) AS DOUBLE), 6) AS overlap
FROM g a JOIN g b USING (x) JOIN n na ON na.t = a.t JOIN n nb ON nb.t = b.t WHERE a.t < b.t GROUP BY a.t, b.t""")
def vz10_jn18_term_edges(spark, d):
    t = read(spark, d, "part").groupBy(F.col("p_brand").alias("term")).agg(F.collect_set(F.col("p_size").cast("string")).alias("genes"))
    return views.term_edges(t).select("a", "b", "shared", r6("jaccard", "jaccard"), r6("overlap", "overlap"))


@query("SELECT i, j, round(v, 6) AS v FROM (SELECT i, j, v - 15.2 AS v FROM cells) WHERE i < j AND abs(v) >= CASE WHEN v > 0 THEN 0.05 ELSE 0.02 END", "cells")
def vz13_edges(spark, d):
    m = cells(spark, d).withColumn("v", F.col("v") - F.lit(15.2))
    return network.edges(m, 0.05, 0.02).select("i", "j", r6("v", "v"))


@query("""WITH e AS MATERIALIZED (SELECT i, j, v, i || sign(v) AS a, j || sign(v) AS b, row_number() OVER (ORDER BY abs(v) DESC, i, j) AS k FROM (SELECT i, j, v - 15.2 AS v FROM cells) WHERE i < j AND abs(v) >= CASE WHEN v > 0 THEN 0.05 ELSE 0.02 END),
g AS (WITH RECURSIVE t AS (SELECT 0::BIGINT AS k, false AS keep, []::VARCHAR[] AS used UNION ALL SELECT k, free, CASE WHEN free THEN used || [a, b] ELSE used END
  FROM (SELECT e.k, e.a, e.b, used, len(list_filter(used, lambda x: x = e.a)) < 3 AND len(list_filter(used, lambda x: x = e.b)) < 3 AS free FROM t JOIN e ON e.k = t.k + 1)) SELECT k FROM t WHERE keep)
SELECT i, j, round(v, 6) AS v FROM e JOIN g USING (k)""", "cells")
def sr9_capped_edges(spark, d):
    m = cells(spark, d).withColumn("v", F.col("v") - F.lit(15.2))
    return network.capped(network.edges(m, 0.05, 0.02), 3).select("i", "j", r6("v", "v"))


_CURVES = """e AS (SELECT i, j, v - 15.2 AS v FROM cells WHERE i < j AND abs(v - 15.2) >= CASE WHEN v > 15.2 THEN 0.05 ELSE 0.02 END),
pt AS (SELECT c_nationkey, c_acctbal / 1000 AS x, (c_custkey * 7919 % 1000) / 100.0 AS y FROM customer),
nd AS (SELECT n_name AS node, avg(x) AS x, avg(y) AS y FROM pt JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
sp AS (SELECT avg(x) AS mx, avg(y) AS my, median(sqrt((x - px) ** 2 + (y - py) ** 2)) AS spacing FROM (SELECT x, y, lag(x) OVER (ORDER BY node) AS px, lag(y) OVER (ORDER BY node) AS py FROM nd)),
g AS (SELECT i, j, v, a.x AS x1, a.y AS y1, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS len, mx, my, spacing FROM e JOIN nd a ON a.node = i JOIN nd b ON b.node = j, sp),
lk AS (SELECT i, j, side, len, greatest(0.05, 1 - 2 * (t - 0.5) ** 4) AS w, x1 + t * dx - dy * 4 * t * (1 - t) * 0.06 * side AS px, y1 + t * dy + dx * 4 * t * (1 - t) * 0.06 * side AS py
  FROM g, (SELECT unnest([1, -1]) AS side), (SELECT 0.1 + 0.8 * k / 14 AS t FROM range(0, 15) r(k))),
hit AS (SELECT i, j, side, sum(CASE WHEN d < len * 0.3 THEN (1 - d / (len * 0.3)) * w ELSE 0 END) AS s, min(d) AS d FROM (SELECT lk.*, sqrt((x - px) ** 2 + (y - py) ** 2) AS d FROM lk JOIN nd ON node <> i AND node <> j) GROUP BY ALL),
back AS (SELECT i, j, side, sum(0.2 * w) AS s FROM lk JOIN pt ON (x - px) ** 2 + (y - py) ** 2 < (len * 0.25) ** 2 GROUP BY ALL),
both_ AS (SELECT hit.i, hit.j, hit.side, hit.s + coalesce(back.s, 0) AS s, d FROM hit LEFT JOIN back USING (i, j, side)),
sc AS (SELECT g.*, u.s AS us, u.d AS ud, n.s AS ns, n.d AS nd_, len / spacing AS r, (x1 + dx / 2 - mx) * -dy + (y1 + dy / 2 - my) * dx > 0 AS outward FROM g JOIN both_ u ON u.i = g.i AND u.j = g.j AND u.side = 1 JOIN both_ n ON n.i = g.i AND n.j = g.j AND n.side = -1),
bn AS (SELECT *, CASE WHEN r > 1.5 THEN least(r - 1, 3) ELSE 0 END AS bonus FROM sc),
up AS (SELECT *, round(us - CASE WHEN outward THEN bonus ELSE 0 END, 9) AS a, round(ns - CASE WHEN outward THEN 0 ELSE bonus END, 9) AS b FROM bn),
st AS (SELECT *, CASE WHEN a <= b THEN 1 ELSE -1 END AS direction, least(a, b) AS score, CASE WHEN a <= b THEN ud ELSE nd_ END AS d, 0.03 * CASE WHEN r > 1 THEN 1 + 1.5 * least(pow(r, 1.15) - 1, 5) ELSE 1 END AS k FROM up),
cv AS (SELECT *, CASE WHEN ns > 1 THEN least(k * (1 + least(ns / 10, 2)) * CASE WHEN d < len * 0.15 THEN 1 + (len * 0.15 - d) / (len * 0.15) ELSE 1 END, 0.45) ELSE k END AS curvature FROM st)"""


@query(f"WITH {_CURVES} SELECT i, j, direction, round(score, 5) AS score, round(curvature, 6) AS curvature, round(x1 + dx / 2 - dy * curvature * direction, 5) AS cx, round(y1 + dy / 2 + dx * curvature * direction, 5) AS cy FROM cv", "cells")
def vz13_curves(spark, d):
    """Curves between nations that keep off other nations' places and off the customers."""
    points = read(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") * 7919 % 1000 / 100).alias("y"))
    nation = read(spark, d, "nation")
    nodes = points.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("node")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    found = network.edges(cells(spark, d).withColumn("v", F.col("v") - F.lit(15.2)), 0.05, 0.02)
    t = network.curves(found, nodes, points)
    return t.select("i", "j", "direction", *(F.round(c, 6 if c == "curvature" else 5).alias(c) for c in ("score", "curvature", "cx", "cy")))


@query("""WITH p AS (SELECT label AS cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
st AS (SELECT cluster, count(*) AS n, min(x) - 0.1 * (max(x) - min(x)) AS ax, max(x) + 0.1 * (max(x) - min(x)) AS bx, min(y) - 0.1 * (max(y) - min(y)) AS ay, max(y) + 0.1 * (max(y) - min(y)) AS by_,
  covar_samp(x, x) * pow(count(*), -1 / 3.0) AS sxx, covar_samp(x, y) * pow(count(*), -1 / 3.0) AS sxy, covar_samp(y, y) * pow(count(*), -1 / 3.0) AS syy FROM p GROUP BY 1),
g AS (SELECT st.*, i.v AS i, j.v AS j, ax + (bx - ax) * i.v / 49 AS gx, ay + (by_ - ay) * j.v / 49 AS gy FROM st, range(0, 50) i(v), range(0, 50) j(v)),
k AS (SELECT cluster, g.n, gx, gy, i, j, sum(exp(-(syy * (x - gx) ** 2 - 2 * sxy * (x - gx) * (y - gy) + sxx * (y - gy) ** 2) / (sxx * syy - sxy * sxy) / 2)) AS s FROM g JOIN p USING (cluster) GROUP BY ALL)
SELECT cluster, round(gx, 6) AS x, round(gy, 6) AS y, n FROM k QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, j, i) = 1""")
def ml18_ml19_cluster_centres(spark, d):
    p = read(spark, d, "embeddings").select(F.col("vec_id").alias("gene"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    t = network.centres(read(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("gene")), p)
    return t.select("cluster", r6("x", "x"), r6("y", "y"), "n")


@query("SELECT kind, count(DISTINCT (cell, umi)) AS n, true AS within FROM reads GROUP BY 1", "reads")
def ag4_merged_sketches(spark, d):
    """Sketches of molecules by kind and transcript and hour of a read, written, read and merged by kind: within four standard errors of the exact number."""
    from .analogs import reads

    rows = reads(spark, d).withColumn("molecule", F.xxhash64("cell", "umi"))
    parts = settled(counts.sketches(rows.withColumn("batch", F.col("event_id") % 24), ["kind", "transcript", "batch"], "molecule"), "sketches")
    exact = rows.select("kind", "cell", "umi").distinct().groupBy("kind").agg(F.count("*").alias("exact"))
    t = counts.merged(parts, ["kind"]).join(exact, "kind")
    return t.select("kind", F.col("exact").alias("n"), (F.abs(F.col("n") - F.col("exact")) <= F.lit(4 * 1.04 / 64) * F.col("exact") + 1).alias("within"))


@query("SELECT floor(value / 5) * 5 AS bin, count(*) AS n FROM events GROUP BY 1")
def vz14_histogram(spark, d):
    return views.histogram(read(spark, d, "events"), "value", 5.0).select(F.col("bin").cast("double").alias("bin"), "n")


@query("""WITH r AS (SELECT guide AS gene, log2(sum(report)) - 20 AS weight, split_part(guide, '_', 1) = 'Brand#7' AS hit FROM single GROUP BY guide), t AS (SELECT sum(abs(weight)) FILTER (hit) AS w, count(*) FILTER (NOT hit) AS m FROM r)
SELECT gene, round(sum(CASE WHEN hit THEN abs(weight) / w ELSE -1.0 / m END) OVER (ORDER BY weight DESC, gene ROWS UNBOUNDED PRECEDING), 6) AS es FROM r, t""", "single")
def ml20_running_enrichment(spark, d):
    ranked = single(spark, d).groupBy(F.col("guide").alias("gene")).agg((F.log2(F.sum("report")) - 20).alias("weight"))
    chosen = ranked.where(F.split_part("gene", F.lit("_"), F.lit(1)) == "Brand#7").select("gene")
    return views.running_enrichment(ranked, chosen).select("gene", r6("es", "es"))


@query("""WITH g AS (SELECT l_suppkey AS gene, avg(l_extendedprice) - 38000 AS weight FROM lineitem GROUP BY 1),
r AS (SELECT gene, row_number() OVER (ORDER BY weight DESC, gene) - 1 AS rank, abs(weight) AS w, count(*) OVER () AS n FROM g),
hits AS (SELECT s_nationkey AS gene_set, rank, w, n FROM r JOIN supplier ON gene = s_suppkey),
sizes0 AS (SELECT DISTINCT size FROM (SELECT gene_set, count(*) AS size FROM hits GROUP BY 1) WHERE size < (SELECT count(*) FROM g)),
keys AS (SELECT permutation, rank, w, n, x * x % 2147483647 AS x FROM (SELECT permutation, rank, w, n, (x * 16807 + permutation) % 2147483647 AS x FROM (
  SELECT permutation, rank, w, n, (x * x + 16807) % 2147483647 AS x FROM (SELECT p AS permutation, rank, w, n, (rank * 48271 + (p + 1) * 69621) % 2147483647 AS x FROM r, range(0, 100000) t(p))))),
drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY permutation ORDER BY x, rank) AS k FROM keys) WHERE k <= (SELECT max(size) FROM sizes0)),
every AS (SELECT -1 - gene_set AS id, 0 AS permutation, rank, w, n FROM hits UNION ALL SELECT size, permutation, rank, w, n FROM drawn JOIN sizes0 ON k <= size),
sums AS (SELECT *, sum(w) OVER (PARTITION BY id, permutation) AS total, count(*) OVER (PARTITION BY id, permutation) AS size, sum(w) OVER (PARTITION BY id, permutation ORDER BY rank) AS up, row_number() OVER (PARTITION BY id, permutation ORDER BY rank) AS i FROM every),
ends AS (SELECT id, permutation, size, round(max(up / total - (rank - i + 1) / CAST(n - size AS DOUBLE)), 9) AS high, round(min((up - w) / total - (rank - i + 1) / CAST(n - size AS DOUBLE)), 9) AS low FROM sums WHERE size < n AND total > 0 GROUP BY ALL),
es AS (SELECT id, permutation, size, CASE WHEN high >= -low THEN high ELSE low END AS es, CASE WHEN high >= -low THEN CASE WHEN high >= 0 THEN 1 ELSE -1 END ELSE CASE WHEN low >= 0 THEN 1 ELSE -1 END END AS sign FROM ends),
null_ AS (SELECT * FROM es WHERE id >= 0), means AS (SELECT size, sign, avg(abs(es)) AS mean, count(*) AS n_null FROM null_ GROUP BY ALL),
mine AS (SELECT -1 - id AS gene_set, e.size, e.sign, es, round(abs(es) / mean, 9) AS x, n_null FROM es e LEFT JOIN means m ON m.size = e.size AND m.sign = e.sign WHERE id < 0),
theirs AS (SELECT t.size, t.sign, permutation, abs(es) AS a, round(abs(es) / mean, 9) AS x, sets FROM null_ t JOIN means USING (size, sign) JOIN (SELECT size, count(*) AS sets FROM mine GROUP BY 1) USING (size)),
peaks AS (SELECT sign, permutation, max(x) AS x FROM theirs GROUP BY ALL)
SELECT gene_set, size, round(es, 6) AS es, round(sign * x, 6) AS nes,
  round((SELECT count(*) FROM theirs t WHERE t.size = m.size AND t.sign = m.sign AND t.a >= abs(m.es)) / CAST(n_null AS DOUBLE), 6) AS p_value,
  round(least(1, (SELECT sum(sets) FROM theirs t WHERE t.sign = m.sign AND t.x >= m.x) / CAST((SELECT sum(sets) FROM theirs t WHERE t.sign = m.sign) AS DOUBLE)
    / ((SELECT count(*) FROM mine o WHERE o.sign = m.sign AND o.x >= m.x) / CAST((SELECT count(*) FROM mine o WHERE o.sign = m.sign) AS DOUBLE))), 6) AS fdr,
  round((SELECT count(*) FROM peaks k WHERE k.sign = m.sign AND k.x >= m.x) / 100000.0, 6) AS fwer FROM mine m""")
def ml20_enrichment(spark, d):
    """Nations' suppliers along the suppliers' mean prices, with 100,000 permutations."""
    from ..operators import enrichment

    genes = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("gene")).agg((F.avg("l_extendedprice") - 38000).alias("weight"))
    sets = read(spark, d, "supplier").select(F.col("s_nationkey").alias("gene_set"), F.col("s_suppkey").alias("gene"))
    t = enrichment.enrichment(genes, sets)
    return t.select("gene_set", "size", *(r6(c, c) for c in ("es", "nes", "p_value", "fdr", "fwer")))


@query("""WITH w AS (SELECT guide, rep, avg(log2(report + 10)) AS v FROM single GROUP BY ALL) SELECT round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM w a JOIN w b USING (guide) WHERE a.rep = 'F' AND b.rep = 'O'""", "single")
def pl19_replicate_concordance(spark, d):
    w = single(spark, d).groupBy("guide", "rep").agg(F.avg(F.log2(F.col("report") + 10)).alias("v"))
    a, b = w.where("rep = 'F'").select("guide", F.col("v").alias("a")), w.where("rep = 'O'").select("guide", F.col("v").alias("b"))
    return a.join(b, "guide").agg(r6(F.corr("a", "b"), "r"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT *, (l_orderkey * 48271 + l_partkey * 16807 + 3) % 2147483647 AS h FROM lineitem), m AS (SELECT l_suppkey, h < 1073741823 AS half, avg(log2(l_extendedprice)) AS v FROM h GROUP BY ALL)
SELECT round(corr(a.v, b.v), 6) AS r, count(*) AS n FROM m a JOIN m b USING (l_suppkey) WHERE a.half AND NOT b.half""")
def pl13_split_half(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    halves = [h.groupBy("l_suppkey").agg(F.avg(F.log2("l_extendedprice")).alias(n)) for h, n in zip(sampling.halves(x, ["l_orderkey", "l_partkey"], 3), "ab", strict=True)]
    return halves[0].join(halves[1], "l_suppkey").agg(r6(F.corr("a", "b"), "r"), F.count("*").alias("n"))


#: Sizes and seeds of the downsampling grid, and its rows' lineages with their halves and order keys in SQL.
SIZES, SEEDS = (500, 1000, 1500, 2000, 2500), (0, 1, 2, 3, 4)
_HALF = "CASE WHEN substring(md5(concat('half|', p1, '|', p2, '|', barcode, '|', rep)), 1, 20) < '8' THEN 1 ELSE 2 END"
_GRID = f"""SELECT round(r_sampled, 6) AS r_sampled, n_sampled, round(r_full, 6) AS r_full, n_full, size, seed FROM (WITH rows_ AS (SELECT *, log2(report + 10) AS x, {_HALF} AS half FROM dual),
lin AS (SELECT DISTINCT p1, p2, barcode, rep, half FROM rows_),
placed AS (SELECT *, row_number() OVER (PARTITION BY half, seed ORDER BY substring(md5(concat(seed, '|', p1, '|', p2, '|', barcode, '|', rep)), 1, 20)) AS k, count(*) OVER (PARTITION BY half, seed) AS held
  FROM lin, (SELECT unnest({list(SEEDS)}) AS seed)),
sizes AS (SELECT unnest({list(SIZES)}) AS size),
means AS (SELECT half, seed, size, p1, p2, p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%' AS control, avg(x) AS v FROM placed JOIN sizes ON k <= size AND size <= held JOIN rows_ USING (p1, p2, barcode, rep, half) GROUP BY ALL),
scores AS (SELECT half, seed, size, p1, p2, coalesce((v - avg(v) FILTER (control) OVER w) / nullif(stddev_samp(v) FILTER (control) OVER w, 0), 0) AS z FROM means WINDOW w AS (PARTITION BY half, seed, size)),
whole AS (SELECT p1, p2, p1 LIKE 'NATION_2%' AND p2 LIKE 'NATION_2%' AS control, avg(x) AS v FROM rows_ WHERE half = 2 GROUP BY ALL),
full_ AS (SELECT p1, p2, coalesce((v - avg(v) FILTER (control) OVER ()) / nullif(stddev_samp(v) FILTER (control) OVER (), 0), 0) AS z FROM whole),
a AS (SELECT * FROM scores WHERE half = 1), b AS (SELECT * FROM scores WHERE half = 2), g AS (SELECT DISTINCT size, seed FROM a),
sampled AS (SELECT size, seed, corr(coalesce(a.z, 0), coalesce(b.z, 0)) AS r_sampled, count(*) AS n_sampled FROM a FULL JOIN b USING (size, seed, p1, p2) GROUP BY 1, 2),
whole2 AS (SELECT size, seed, corr(coalesce(a.z, 0), coalesce(f.z, 0)) AS r_full, count(*) AS n_full FROM a FULL JOIN (SELECT * FROM full_, g) f USING (size, seed, p1, p2) GROUP BY 1, 2)
SELECT * FROM sampled JOIN whole2 USING (size, seed))"""


@query(_GRID, "dual")
def pl13_downsampling_grid(spark, d):
    """Correlations of pair scores of two half screens for five sizes and five seeds, both halves sampled and one."""
    from ..operators import downsample

    x = dual(spark, d).withColumn("x", F.log2(F.col("report") + 10))
    control = F.col("p1").startswith(CONTROL) & F.col("p2").startswith(CONTROL)
    t = downsample.concordance(x, ["p1", "p2", "barcode", "rep"], ["p1", "p2"], "x", list(SIZES), list(SEEDS), control)
    return t.select("size", "seed", r6("r_sampled", "r_sampled"), "n_sampled", r6("r_full", "r_full"), "n_full")


@query("""WITH m AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS j FROM embeddings), b AS (SELECT label, j, avg(CAST(v AS DOUBLE)) AS v FROM m GROUP BY ALL), c AS (SELECT j, avg(v) AS y FROM b GROUP BY 1)
SELECT label, round(corr(v, y), 5) AS r FROM b JOIN c USING (j) GROUP BY 1""")
def pl20_pseudobulk_correlation(spark, d):
    from .analogs import grid

    b = grid(spark, d).groupBy("label", "j").agg(F.avg("v").alias("v"))
    y = b.groupBy("j").agg(F.avg("v").alias("y"))
    return b.join(y, "j").groupBy("label").agg(F.round(F.corr("v", "y"), 5).alias("r"))


@query("""WITH w AS (SELECT gene, guide, avg(log2(report + 10)) FILTER (rep = 'F') AS "F", avg(log2(report + 10)) FILTER (rep = 'O') AS "O" FROM single GROUP BY ALL)
SELECT gene, guide, row_number() OVER (PARTITION BY gene ORDER BY guide) AS number, round("F", 6) AS "report_F", round("O", 6) AS "report_O" FROM w""", "single")
def pl18_wide_phenotypes(spark, d):
    w = screen.log_transform(single(spark, d), ["report"]).groupBy("gene", "guide").pivot("rep", ["F", "O"]).agg(F.avg("log2_report"))
    return w.select("gene", "guide", F.row_number().over(Window.partitionBy("gene").orderBy("guide")).alias("number"), r6("F", "report_F"), r6("O", "report_O"))


@query("""WITH w AS (SELECT gene, guide, avg(log2(report + 10)) FILTER (rep = 'F') AS f, avg(log2(report + 10)) FILTER (rep = 'O') AS o FROM single GROUP BY ALL), d AS (SELECT gene, guide, f - o AS change, abs(f + o) AS weight FROM w)
SELECT * FROM (SELECT gene, guide, round(change, 6) AS change, round(weight, 6) AS weight, 'up' AS pick FROM d WHERE change > 0.2 ORDER BY round(weight, 9) DESC, gene, guide LIMIT 50)
UNION ALL SELECT * FROM (SELECT gene, guide, round(change, 6) AS change, round(weight, 6) AS weight, 'down' AS pick FROM d WHERE change < -0.2 ORDER BY round(weight, 9) DESC, gene, guide LIMIT 50)""", "single")
def pl18_annotations(spark, d):
    """The 50 guides to label on each side of a change of 0.2."""
    w = screen.log_transform(single(spark, d), ["report"]).groupBy("gene", "guide").pivot("rep", ["F", "O"]).agg(F.avg("log2_report"))
    w = w.select("gene", "guide", (F.col("F") - F.col("O")).alias("change"), F.round(F.abs(F.col("F") + F.col("O")), 9).alias("weight"))
    t = views.annotated(w, {"up": (F.col("change") > 0.2, "weight"), "down": (F.col("change") < -0.2, "weight")})
    return t.select("gene", "guide", r6("change", "change"), r6("weight", "weight"), "pick")


@query("""WITH x AS (SELECT least(p1, p2) || '+' || greatest(p1, p2) AS pair, log2(report + 10) AS v FROM dual), k AS (SELECT pair, count(*) AS n, avg(v) AS m FROM x GROUP BY 1 HAVING count(*) >= 50), r AS (SELECT *, row_number() OVER (ORDER BY m, pair) AS q, count(*) OVER () AS t FROM k)
SELECT pair, n, round(m, 6) AS mean FROM r WHERE q > t - floor(t * 20 / 100)""", "dual")
def pl15_lineage_view(spark, d):
    from ..functions.sequences import pair_key

    x = dual(spark, d).select(pair_key(F.col("p1"), F.col("p2")).alias("pair"), F.log2(F.col("report") + 10).alias("v"))
    m = counts.at_least(x, ["pair"], 50).groupBy("pair").agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    return views.top_percent(m, "m", "pair", 20).select("pair", "n", r6("m", "mean"))


@query("SELECT event_id, round(log2(value + 1), 8) AS a, round(-log10(value / 101 + 1e-9), 6) AS b, round(sqrt(value) + pow(value, 2), 4) AS c, sign(value - 50) AS d, round(CASE WHEN abs(value - 50) <= 20 THEN 0.5 * (value - 50) ** 2 ELSE 20 * (abs(value - 50) - 10) END, 5) AS huber FROM events")
def mt_scalar_math(spark, d):
    x = F.col("value")
    r = F.abs(x - 50)
    return read(spark, d, "events").select("event_id", F.round(F.log2(x + 1), 8).alias("a"), F.round(-F.log10(x / 101 + F.lit(1e-9)), 6).alias("b"), F.round(F.sqrt(x) + F.pow(x, F.lit(2.0)), 4).alias("c"), F.signum(x - 50).alias("d"), F.round(F.when(r <= 20, 0.5 * r * r).otherwise(20 * (r - 10)), 5).alias("huber"))


@query("""WITH r AS (SELECT l_suppkey, corr(l_quantity, l_discount) AS r, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 2),
t AS (SELECT l_suppkey, n, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2) / 2.0 AS a, r * r AS y, 1 - r * r AS x FROM r),
f AS (SELECT *, lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) + a * ln(x) + 0.5 * ln(y) AS front,
  list_reduce(list_concat([CAST(1 AS DOUBLE)], list_transform(range(400, -1, -1), lambda n: CAST(n AS DOUBLE))), lambda acc, n: 1 + (a + 0.5 + n) / (1.5 + n) * y * acc) AS small,
  list_reduce(list_concat([CAST(1 AS DOUBLE)], list_transform(range(1000, -1, -1), lambda n: CAST(n AS DOUBLE))), lambda acc, n: 1 + (a + 0.5 + n) / (a + 1 + n) * x * acc) AS large FROM t),
p AS (SELECT *, CASE WHEN t * t < 25 THEN log10(1 - exp(front) / 0.5 * small) ELSE (front - ln(a) + ln(large)) / ln(10) END AS log10_p FROM f)
SELECT l_suppkey, n, round(t, 5) AS t, round(log10_p, 5) AS log10_p, CAST(floor(log10_p) + 1 AS INTEGER) AS bound FROM p""")
def mt6_t_tail(spark, d):
    """Each supplier's correlation of quantity and discount, its t and its two-sided tail; the oracle sums the incomplete beta function's series."""
    r = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.corr("l_quantity", "l_discount").alias("r"), F.count("*").alias("n")).where("n > 2")
    t = r.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    t = t.withColumn("log10_p", ranks.log10_t_tail_udf(F.col("t"), (F.col("n") - 2).cast("double")))
    return t.select("l_suppkey", "n", F.round("t", 5).alias("t"), F.round("log10_p", 5).alias("log10_p"), ranks.p_bound(F.col("log10_p")).alias("bound"))


@query("""WITH v AS (SELECT event_id, (value - 50) / 30 AS x, abs((value - 50) / 30) AS a FROM events),
e AS (SELECT *, CASE WHEN a < 3 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda n: (1 - 2 * (n % 2)) * pow(a, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))
  ELSE exp(-a * a) / sqrt(pi()) / list_reduce(list_concat([a], list_transform(range(80, 0, -1), lambda n: CAST(n AS DOUBLE))), lambda acc, n: a + n / 2 / acc) END AS tail FROM v)
SELECT event_id, round(CASE WHEN x < 0 THEN 2 - tail ELSE tail END, 8) + 0 AS erfc FROM e""")
def mt5_erfc(spark, d):
    """The oracle sums the series near 0 and the continued fraction beyond."""
    return read(spark, d, "events").select("event_id", F.round(ranks.erfc_udf((F.col("value") - 50) / 30), 8).alias("erfc"))
