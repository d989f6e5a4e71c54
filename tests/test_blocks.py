"""Block-compressed files: every split size gives the same lines and records, read by hand too."""

import gzip
import os

import numpy as np
import pytest

from loomscreen.sources import blocks, fastq

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def written(path, texts):
    """A file of one block a text."""
    path.write_bytes(b"".join(blocks.block(t) for t in texts) + blocks.END)
    return str(path)


def split_up(path, size, step, names=()):
    return [blocks.Split(path, at, min(at + step, size), size, names) for at in range(0, size, step)]


@pytest.mark.parametrize("seed", range(6))
def test_lines_of_any_split(tmp_path, seed):
    """Lines across blocks, empty ones, one longer than a split, with and without a last newline."""
    rng = np.random.default_rng(seed)
    lines = [b"x" * int(n) for n in rng.choice([0, 1, 5, 30, 400, 3000], 300)]
    data = b"\n".join(b"%d:" % k + x if x else b"" for k, x in enumerate(lines)) + (b"\n" if seed % 2 else b"")
    cuts = sorted(rng.integers(0, len(data), 40).tolist())
    path = written(tmp_path / "a.gz", [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)])
    size = os.path.getsize(path)
    want = gzip.open(path).read().split(b"\n")
    want = want[:-1] if want[-1] == b"" else want
    for step in (1, 7, 40, 100, 333, 1000, size):
        parts = [[x for some in blocks.split_lines(s) for x in some] for s in split_up(path, size, step)]
        assert [x for p in parts for x in p] == want, step
        if step == 100:
            assert sum(bool(p) for p in parts) > 5


def alignment(rng, k):
    n = int(rng.integers(1, 300))
    seq = "".join(rng.choice(list("ACGTN"), n)) if k % 7 else "*"
    qual = "".join(chr(33 + int(q)) for q in rng.integers(0, 60, n)) if k % 7 and k % 3 else "*"
    ref = ("chr1", "chr2", "*")[k % 3]
    return (f"read/{k}:x", int(rng.integers(0, 4096)), ref, int(rng.integers(1, 10**8)) if ref != "*" else 0, int(rng.integers(0, 61)), f"{n}M3D" if k % 5 else "*", ("=", "*", "chr2")[k % 3] if ref != "*" else "*", int(rng.integers(0, 10**6)), int(rng.integers(-500, 500)), seq, qual)


@pytest.mark.parametrize("step", [1, 50, 777, 5000, 10**7])
def test_records_of_any_split(tmp_path, step):
    rng = np.random.default_rng(1)
    rows = [alignment(rng, k) for k in range(400)]
    rows = [r[:6] + ("=" if r[6] == r[2] != "*" else r[6],) + r[7:] for r in rows]
    places = {"chr1": 0, "chr2": 1}
    header = b"BAM\x01" + b"\x04\0\0\0text" + b"\x02\0\0\0" + b"".join(b"\x05\0\0\0" + n.encode() + b"\0" + b"\0\0\0\x10" for n in places)
    tags = b"NMC\x03" + b"MDZ10A5\0" + b"XAAq" + b"XFf\0\0\xc0?" + b"XBBs\x02\0\0\0\x01\0\xff\xff"
    bodies = []
    for k, r in enumerate(rows):
        b = blocks.encoded(r, places)
        if k % 2:
            b = (len(b) - 4 + len(tags)).to_bytes(4, "little") + b[4:] + tags
        bodies.append(b)
    data = header + b"".join(bodies)
    cuts = sorted(rng.integers(0, len(data), 60).tolist())
    path = written(tmp_path / "a.bam", [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)])
    size = os.path.getsize(path)
    got = [r for s in split_up(path, size, step, tuple(places)) for r in blocks.split_records(s)]
    assert [r[:-1] for r in got] == rows
    assert {r[-1] for r in got} == {"", "NM:i:3\tMD:Z:10A5\tXA:A:q\tXF:f:1.5\tXB:B:s,1,-1"}


def test_round_trips_in_several_partitions(spark, tmp_path):
    text = [f"@r{k}\n{'ACGT' * (k % 50 + 1)}\n+\n{'@III' * (k % 50 + 1)}" for k in range(5000)]
    path = f"file://{tmp_path}/fastq"
    blocks.write_lines(spark.createDataFrame([(t,) for t in text], "value string").coalesce(1), path)
    lines = blocks.lines(spark, path, 3000)
    assert lines.rdd.getNumPartitions() > 4
    found = fastq.block_records(spark, path, 3000).where("seq is not null").collect()
    assert sorted((int(r.name[1:]), r.rec_no) for r in found) == [(k, k) for k in range(5000)]
    assert {(r.name, r.seq, r.qual) for r in found} == {tuple(t[1:].split("\n"))[:2] + (t.split("\n")[3],) for t in text}
    # Any reader of gzip reads the file.
    (file,) = [f for f in os.listdir(tmp_path / "fastq") if f.endswith(".gz")]
    assert gzip.open(tmp_path / "fastq" / file, "rt").read().splitlines() == "\n".join(text).splitlines()


def test_empty_and_wrong_files(spark, tmp_path):
    path = written(tmp_path / "a.gz", [])
    assert [x for s in split_up(path, os.path.getsize(path), 10) for x in blocks.split_lines(s)] in ([], [[]], [[], []])
    assert blocks.lines(spark, str(tmp_path / "a.gz")).count() == 0
    (tmp_path / "plain").write_bytes(b"no blocks")
    with pytest.raises(Exception, match="no block begins"):
        blocks.lines(spark, str(tmp_path / "plain")).count()
