"""The incremental job over input that grows, on copies."""

import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import cli, molecules, queries

from ..oracle import connect, oracle, ours, same

D = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CONFIG = cli.settings(None, "molecules.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_query_equals_sql(spark):
    got = ours(queries.QUERIES["job1_molecules"](spark, D))
    assert not same(got, oracle(connect(D), queries.ORACLES["job1_molecules"]))


def test_growing_input(spark, tmp_path, caplog):
    """The second run takes only the new files, and the result is that of one run over all."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    reads, out, checkpoint = (str(tmp_path / n) for n in ("reads", "out", "checkpoint"))
    part = lambda odd: docs.where(F.col("doc_id") % 3 == odd).coalesce(1)
    part(0).write.parquet(reads)
    caplog.set_level(logging.INFO, logger="jobs.molecules")
    first = rows(molecules.run(spark, reads, out, checkpoint, CONFIG))
    n0 = part(0).count()
    assert f"took {n0} new reads" in caplog.text and first
    before = files(out)
    caplog.clear()
    # Nothing new: nothing is written.
    assert rows(molecules.run(spark, reads, out, checkpoint, CONFIG)) == first
    assert "took 0 new reads" in caplog.text and files(out) == before
    # New reads, one of them a copy of an old one: its molecule isn't a new one.
    part(1).union(part(0).limit(1)).coalesce(1).write.mode("append").parquet(reads)
    part(2).write.mode("append").parquet(reads)
    caplog.clear()
    second = rows(molecules.run(spark, reads, out, checkpoint, {**CONFIG, "files_per_batch": 1}))
    assert f"took {docs.count() - n0 + 1} new reads of {reads} in 2 batches" in caplog.text
    whole = rows(molecules.run(spark, reads, str(tmp_path / "whole"), str(tmp_path / "whole-checkpoint"), CONFIG))
    assert second == whole
    # Files of earlier batches stay as they were.
    after = files(out)
    assert all(after[f] == t for f, t in before.items() if "/reads/batch=0/" in f)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    batch = spark.read.parquet(f"{D}/documents.parquet").select("source", "text")
    out = str(tmp_path / "out")
    for part, number in ((batch.limit(120), 0), (batch, 1), (batch, 1)):
        molecules.take_batch(part, number, out, CONFIG)
        last = rows(molecules.table(spark, out)) if number else None
    again = rows(molecules.table(spark, out))
    assert last == again and sum(r[3] for r in again) > len(again)


def test_only_samples_of_a_batch_are_written(spark, tmp_path):
    out, seq = str(tmp_path / "out"), "G" * 40 + "TAAAC" + "ACGT" * 10
    make = lambda *r: spark.createDataFrame(list(r), "source string, text string")
    plain = {**CONFIG, "letters": ""}
    molecules.take_batch(make(("a", seq), ("b", seq), (None, seq), ("", seq)), 0, out, plain)
    before = files(f"{out}/molecules")
    molecules.take_batch(make(("b", "A" + seq), ("b", seq)), 1, out, plain)
    after = files(f"{out}/molecules")
    assert {f for f in before if "sample=b" not in f and f.endswith(".parquet")} <= set(after)
    found = {(r.sample, r.barcode): (r.molecules, r.reads) for r in molecules.table(spark, out).collect()}
    assert found[("unassigned", "C" * 25)] == (1, 2) and found[("a", "C" * 25)] == (1, 1) and found[("b", "C" * 25)] == (1, 2)


def test_edges(spark, tmp_path):
    """Null, empty, short and unknown bases, a very long read, and no usable read at all."""
    seq = "G" * 40 + "TAAAC" + "ACGT" * 10
    plain = {**CONFIG, "letters": ""}
    bad = spark.createDataFrame([("a", None), ("a", ""), ("a", "ACGT"), ("a", "N" + seq), ("a", "T" * 30)], "source string, text string")
    out = str(tmp_path / "out")
    assert molecules.take_batch(bad, 0, out, plain) == 5
    assert molecules.table(spark, str(tmp_path / "none")).collect() == []
    molecules.take_batch(spark.createDataFrame([("a", seq + "ACGT" * 500_000)] * 2, "source string, text string"), 1, out, plain)
    assert [(r.molecules, r.reads) for r in molecules.table(spark, out).collect()] == [(1, 2)]


def test_command_line(spark, tmp_path):
    reads, out = str(tmp_path / "reads"), str(tmp_path / "out")
    spark.read.parquet(f"{D}/documents.parquet").limit(60).write.parquet(reads)
    (tmp_path / "c.json").write_text(json.dumps({"files_per_batch": 1}))
    call = [sys.executable, "-m", "jobs.molecules", "--reads", reads, "--out", out, "--checkpoint", str(tmp_path / "checkpoint"), "--config", str(tmp_path / "c.json")]
    done = subprocess.run(call, cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, check=True, timeout=300)
    assert "took 60 new reads" in done.stderr
    assert rows(molecules.table(spark, out)) == rows(molecules.run(spark, reads, str(tmp_path / "o"), str(tmp_path / "c"), CONFIG))


def test_unknown_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"barcod": 1}')
    with pytest.raises(ValueError, match="barcod"):
        cli.settings(str(tmp_path / "c.json"), "molecules.json")
