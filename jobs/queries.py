"""The jobs as queries: each runs its job twice into one new folder and returns the whole output after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cli, molecules, screen_report
from loomscreen.plans.analogs import CTES
from loomscreen.plans.sequencing import RC, TOLERANT
from loomscreen.sources.scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def job1_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules and reads of every sample, guide and barcode among the documents' letters."""
    # A stream reads a folder or a glob; the table may be a single file.
    config, path = cli.settings(None, "molecules.json"), folder(spark, "job-molecules")
    for _ in range(2):
        out = molecules.run(spark, f"{sf_dir}/documents[.]parquet", f"{path}/out", f"{path}/checkpoint", config)
    return out


@query
def job2_screen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both reports of the one-guide screen, in one table."""
    config, path = cli.settings(None, "screen_report.json"), folder(spark, "job-report")
    for _ in range(2):
        guides, saturation = screen_report.run(spark, sf_dir, path, config)
    r6 = lambda c, name: F.round(c, 6).alias(name)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    a = guides.select(F.lit("guides").alias("report"), "guide", "control", "replicate", F.col("lineages").alias("n"), r6("reporter", "x"), r6("z", "z"), r6("p_value", "p"), r6("fdr", "fdr"), none("long", "size"), none("int", "seed"), none("long", "m"))
    b = saturation.select(F.lit("saturation").alias("report"), none("string", "guide"), none("boolean", "control"), none("string", "replicate"), F.col("n_sampled").alias("n"), r6("r_sampled", "x"), r6("r_full", "z"), none("double", "p"), none("double", "fdr"), "size", "seed", F.col("n_full").alias("m"))
    return a.unionByName(b)


_BARCODE, _MOLECULE = "substring(seq, 1, 25)", "substring(seq, 9, 12)"

ORACLES = {
    "job1_molecules": f"""
WITH {CTES["sequences"]},
called AS (
  SELECT coalesce(nullif(source, ''), 'unassigned') AS sample, {TOLERANT} AS guide,
    CASE WHEN length({_BARCODE}) = 25 THEN {RC.format(_BARCODE)} END AS barcode, CASE WHEN length({_MOLECULE}) = 12 THEN {_MOLECULE} END AS molecule
  FROM sequences JOIN documents USING (doc_id))
SELECT sample, guide, barcode, count(DISTINCT molecule) AS molecules, count(*) AS reads
FROM called WHERE guide <> '' AND barcode IS NOT NULL AND molecule IS NOT NULL GROUP BY ALL
""",
    "job2_screen_report": f"""
WITH {CTES["single"]},
sums AS (SELECT guide, barcode, rep, CAST(sum(ident) AS DOUBLE) AS a, CAST(sum(report) AS DOUBLE) AS b FROM single GROUP BY ALL),
shares AS (SELECT *, a / nullif(sum(a) OVER w, 0) AS ra, b / nullif(sum(b) OVER w, 0) AS rb FROM sums WINDOW w AS (PARTITION BY guide)),
limits AS (SELECT greatest(avg(coalesce(ra, 0)) + 3 * stddev_samp(coalesce(ra, 0)), 0.05) AS la, greatest(avg(coalesce(rb, 0)) + 3 * stddev_samp(coalesce(rb, 0)), 0.05) AS lb FROM shares),
rows_ AS (SELECT s.*, log2(report + 10) AS y, guide LIKE 'Brand#1%' AS control FROM single s JOIN shares USING (guide, barcode, rep), limits WHERE ra < la AND rb < lb),
lineages AS (SELECT rep, guide, control, barcode, round(avg(y), 9) AS x FROM rows_ GROUP BY ALL),
means AS (SELECT rep, guide, control, count(*) AS n, avg(x) AS reporter FROM lineages GROUP BY ALL),
scored AS (SELECT *, (reporter - avg(reporter) FILTER (control) OVER w) / nullif(stddev_samp(reporter) FILTER (control) OVER w, 0) AS z FROM means WINDOW w AS (PARTITION BY rep)),
of_controls AS (SELECT rep, x, count(*) AS m FROM lineages WHERE control GROUP BY ALL),
control_sums AS (SELECT rep, CAST(sum(m) AS DOUBLE) AS n2, sum(CAST(m AS DOUBLE) ** 3 - m) AS own FROM of_controls GROUP BY rep),
asked AS (SELECT rep, guide, x, CAST(count(*) AS DOUBLE) AS t FROM lineages GROUP BY ALL),
below AS (SELECT rep, x, sum(m) OVER (PARTITION BY rep ORDER BY x) AS upto, sum(m) OVER (PARTITION BY rep, x) AS e FROM (SELECT rep, x, m FROM of_controls UNION ALL SELECT DISTINCT rep, x, 0 FROM lineages)),
places AS (SELECT DISTINCT rep, x, CAST(upto - e AS DOUBLE) AS less, CAST(e AS DOUBLE) AS e FROM below),
us AS (SELECT rep, guide, sum(t) AS n1, sum(t * (less + e / 2)) AS u, sum((t + e) ** 3 - (t + e) - e ** 3 + e) AS more FROM asked JOIN places USING (rep, x) GROUP BY ALL),
zs AS (SELECT rep, guide, greatest(abs(least(u, n1 * n2 - u) - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - (own + more) / ((n1 + n2) * (n1 + n2 - 1)))) / sqrt(2.0) AS a FROM us JOIN control_sums USING (rep)),
ps AS (SELECT rep, guide, CASE WHEN a < 3 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda n: (1 - 2 * (n % 2)) * pow(a, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1))))
  ELSE exp(-a * a) / sqrt(pi()) / list_reduce(list_concat([a], list_transform(range(80, 0, -1), lambda n: CAST(n AS DOUBLE))), lambda acc, n: a + n / 2 / acc) END AS p FROM zs),
ordered AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY p) AS k, count(*) OVER (PARTITION BY rep) AS tests FROM ps),
adjusted AS (SELECT rep, guide, p, least(1, min(p * tests / k) OVER (PARTITION BY rep ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM ordered),
guides AS (SELECT 'guides' AS report, guide, control, rep AS replicate, n, round(reporter, 6) AS x, round(z, 6) AS z, round(p, 6) AS p, round(fdr, 6) AS fdr,
  CAST(NULL AS BIGINT) AS size, CAST(NULL AS INTEGER) AS seed, CAST(NULL AS BIGINT) AS m FROM scored JOIN adjusted USING (rep, guide)),
parted AS (SELECT *, CASE WHEN substring(md5(concat('half|', guide, '|', barcode, '|', rep)), 1, 20) < '8' THEN 1 ELSE 2 END AS half FROM rows_),
places2 AS (SELECT *, row_number() OVER (PARTITION BY half, seed ORDER BY substring(md5(concat(seed, '|', guide, '|', barcode, '|', rep)), 1, 20)) AS k, count(*) OVER (PARTITION BY half, seed) AS held
  FROM (SELECT DISTINCT guide, barcode, rep, half FROM parted), (SELECT unnest([0, 1, 2]) AS seed)),
sampled AS (SELECT half, seed, size, guide, control, avg(y) AS v FROM places2 JOIN (SELECT unnest([200, 400, 800, 1600]) AS size) ON k <= size AND size <= held JOIN parted USING (guide, barcode, rep, half) GROUP BY ALL),
scores AS (SELECT half, seed, size, guide, coalesce((v - avg(v) FILTER (control) OVER w) / nullif(stddev_samp(v) FILTER (control) OVER w, 0), 0) AS z FROM sampled WINDOW w AS (PARTITION BY half, seed, size)),
whole AS (SELECT guide, control, avg(y) AS v FROM parted WHERE half = 2 GROUP BY ALL),
full_ AS (SELECT guide, coalesce((v - avg(v) FILTER (control) OVER ()) / nullif(stddev_samp(v) FILTER (control) OVER (), 0), 0) AS z FROM whole),
a AS (SELECT * FROM scores WHERE half = 1), b AS (SELECT * FROM scores WHERE half = 2), g AS (SELECT DISTINCT size, seed FROM a),
one AS (SELECT size, seed, corr(coalesce(a.z, 0), coalesce(b.z, 0)) AS r, count(*) AS n FROM a FULL JOIN b USING (size, seed, guide) GROUP BY 1, 2),
two AS (SELECT size, seed, corr(coalesce(a.z, 0), coalesce(f.z, 0)) AS r, count(*) AS n FROM a FULL JOIN (SELECT * FROM full_, g) f USING (size, seed, guide) GROUP BY 1, 2)
SELECT * FROM guides
UNION ALL BY NAME SELECT 'saturation' AS report, NULL AS guide, NULL AS control, NULL AS replicate, one.n, round(one.r, 6) AS x, round(two.r, 6) AS z, NULL AS p, NULL AS fdr, CAST(size AS BIGINT) AS size, seed, two.n AS m
FROM one JOIN two USING (size, seed)
""",
}
