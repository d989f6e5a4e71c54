"""The batch job: reruns, partitions, and its numbers against SQL."""

import os
import subprocess
import sys

from jobs import cli, queries, screen_report

from ..oracle import connect, oracle, ours, same

D = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CONFIG = cli.settings(None, "screen_report.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    got = ours(queries.QUERIES["job2_screen_report"](spark, D))
    assert not same(got, oracle(connect(D), queries.ORACLES["job2_screen_report"]))


def test_reruns_and_other_partitions(spark, tmp_path):
    """A second run gives the same rows; partitions of other replicates and sizes stay."""
    out = str(tmp_path / "out")
    small = {**CONFIG, "sizes": [200, 400], "seeds": [0]}
    first = [rows(t) for t in screen_report.run(spark, D, out, small)]
    assert first == [rows(t) for t in screen_report.run(spark, D, out, small)]
    spark.read.schema(screen_report.GUIDES).parquet(f"{out}/guides").limit(1).drop("replicate").write.parquet(f"{out}/guides/replicate=old")
    guides, saturation = screen_report.run(spark, D, out, {**small, "sizes": [800]})
    assert guides.where("replicate = 'old'").count() == 1
    assert [r for r in rows(guides) if r[-1] != "old"] == first[0]
    assert {r.size for r in saturation.collect()} == {200, 400, 800}
    assert [r for r in rows(saturation) if r[-1] != 800] == first[1]


def test_nulls_and_unknown_guides(spark, tmp_path):
    """Rows with a null or unknown guide, barcode, replicate or reporter change nothing."""
    d = tmp_path / "in"
    t = spark.read.parquet(f"{D}/lineitem.parquet")
    cols = t.columns
    bad = t.limit(40)
    for k, c in enumerate(("l_partkey", "l_orderkey", "l_linestatus", "l_extendedprice")):
        bad = bad.withColumn(c, screen_report.F.when(screen_report.F.col("l_linenumber") % 4 != k, screen_report.F.col(c)))
    unknown = t.limit(3).withColumn("l_partkey", screen_report.F.lit(10**9).cast("long"))
    t.union(bad.select(cols)).union(unknown.select(cols)).write.parquet(f"{d}/lineitem.parquet")
    library = spark.read.parquet(f"{D}/part.parquet")
    library.union(library.limit(5)).write.parquet(f"{d}/part.parquet")
    small = {**CONFIG, "sizes": [200], "seeds": [0]}
    got = screen_report.run(spark, str(d), str(tmp_path / "a"), small)
    kept = bad.na.drop(subset=["l_partkey", "l_orderkey", "l_linestatus", "l_extendedprice"]).count()
    assert kept == 0 and [rows(x) for x in got] == [rows(x) for x in screen_report.run(spark, D, str(tmp_path / "b"), small)]


def test_command_line(tmp_path):
    (tmp_path / "c.json").write_text('{"sizes": [200], "seeds": [0]}')
    call = [sys.executable, "-m", "jobs.screen_report", "--tables", D, "--out", str(tmp_path / "out"), "--config", str(tmp_path / "c.json")]
    done = subprocess.run(call, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True, timeout=300)
    assert "rows now" in done.stderr and os.path.isdir(tmp_path / "out" / "saturation" / "size=200")
