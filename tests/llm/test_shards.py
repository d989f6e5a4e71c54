import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomscreen.llm import shards
from loomscreen.llm.queries import QUERIES


def check(rows, docs, n):
    texts = Counter((k, (t or "")) for k, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter({}) + sum((Counter({(k, len(t.encode()) + 8, zlib.crc32(t.encode())): c}) for (k, t), c in texts.items()), Counter())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < n and sorted(v) == list(range(len(v))) for s, v in slots.items())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op10_kd_shards"](spark, f"/root/testdata/{sf}").collect()
    check(rows, docs, 24)
    size, of = Counter(), defaultdict(set)
    text = dict(docs)
    for r in rows:
        size[r.shard] += r.size
        of[text[r.doc_id]].add(r.shard)
    mean = sum(size.values()) / 24
    largest = max(len(t.encode()) for _, t in docs)
    print(sf, {k: round(v / mean, 3) for k, v in sorted(size.items())})
    assert all(abs(size[s] - mean) <= max(0.03 * mean, largest) for s in range(24))
    assert all(len(s) == 1 for s in of.values())


def test_edges(spark):
    docs = [(i, None) for i in range(5)] + [(7, "")] * 3 + [(i, "hot" * 50) for i in range(100, 400)] + [(9, "x" * 9000), (None, "z")]
    df = spark.createDataFrame([(*d, None, 3) for d in docs], "doc_id long, text string, lang string, size int")
    rows = shards.assign(df, [shards.coded(F.col("lang")), F.lit(1.0)], 4).collect()
    check(rows, docs, 4)
    assert len({r.shard for r in rows if r.size == 158}) > 1
    assert shards.assign(df.limit(0), [F.lit(1.0)], 4).collect() == []


def test_many_rows_of_one_key_and_text(spark):
    """Half of all bytes in equal rows: every shard gets its share, and slots are counted in buckets of a few hundred rows."""
    docs = [(5, "the same text " * 14)] * 2000 + [(100 + i, f"text {i} " * (10 + i % 20)) for i in range(2000)]
    df = spark.createDataFrame([(*d, "en", 1, 2, 3, 4) for d in docs], "doc_id long, text string, lang string, shard int, slot int, part int, row int").repartition(6)
    rows = shards.assign(df, [shards.coded(F.col("lang")), F.length("text")], 8).collect()
    check(rows, docs, 8)
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    mean = sum(size.values()) / 8
    print({k: round(v / mean, 3) for k, v in sorted(size.items())})
    assert len(size) == 8 and all(abs(v - mean) < 0.03 * mean for v in size.values())


def test_a_long_text(spark):
    docs = [(1, "long " * 1_000_000)] * 2 + [(i, f"short {i}") for i in range(2, 50)]
    rows = shards.assign(spark.createDataFrame(docs, "doc_id long, text string"), [F.lit(0.5)], 3).collect()
    check(rows, docs, 3)
    # Two texts fill two shards, as each exceeds the target.
    assert len({r.shard for r in rows if r.doc_id == 1}) == 2


def tree(units, lo, hi):
    """Shards of units (id, weight, keys) by the tree's definition: the widest dimension's weighted median, exactly."""
    if hi - lo == 1 or not units:
        return {u[0]: lo for u in units}
    width = [max(u[2][i] for u in units) // shards._TIE - min(u[2][i] for u in units) // shards._TIE for i in range(len(units[0][2]))]
    dim, middle = width.index(max(width)), lo + (hi - lo) // 2
    want, below, left = (middle - lo) / (hi - lo) * sum(u[1] for u in units), 0, 0
    units = sorted(units, key=lambda u: u[2][dim])
    for u in units:
        if below + u[1] > want:
            left += below + u[1] - want < want - below
            break
        below, left = below + u[1], left + 1
    return tree(units[:left], lo, middle) | tree(units[left:], middle, hi)


@pytest.mark.parametrize("n", [2, 5, 8])
def test_tree_by_brute_force(spark, n):
    """300 units of different sizes: every histogram round ends at one unit, so medians are exact."""
    rows = [(i, "w" * (1 + (i * 7919) % 900) + str(i), "abcd"[i * i % 4], f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    dims = [shards.coded(F.col("source")), shards.coded(F.col("lang")), F.length("text")]
    placed, units, target = shards._units(df, "doc_id", "text", dims, n)
    found = units.collect()
    assert len(found) == 300
    want = tree([((r.h, r.crc, r["size"], r.part), r.w, (r.k0, r.k1, r.k2)) for r in found], 0, n)
    of = {r.doc_id: want[r.h, r.crc, r["size"], r.part] for r in placed.collect()}
    got = {r.doc_id: r.shard for r in shards.assign(df, dims, n).collect()}
    assert got == of
