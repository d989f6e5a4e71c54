"""Sharding by a k-d tree over metadata, balanced in bytes.

The units of the tree are groups of equal texts, so copies share a shard; a
group larger than a shard's target is dealt in parts by a hash of its rows'
numbers, which tell rows of one key and text apart too.  A unit's place in each dimension is the metadata of its least row,
scaled to 31 bits over the table's range, with a hash of the text below it, so
that units with equal metadata can be told apart.  From one node that owns all
shards, every node is split along its widest dimension at the weighted median
(the share of bytes that its left shards should get), all nodes of a level at
once.  A median is found exactly enough by histograms: sums of bytes by bin
come to the driver (BINS rows a node), the bin that straddles the wanted share
is divided again, until it holds one unit or too few bytes to matter.

Splitting ends with one shard a leaf, that is with leaves of the target bytes.
Slots number a shard's rows from 0 without gaps: rows are counted by shard and
bucket, and numbered within buckets of a bounded expected size.

Edge cases: a null text counts as empty; null metadata lie at 0; repeated rows
get slots of their own; an empty table gives an empty result; fewer units than
shards leave some shards empty; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Bytes that a row takes besides its text.
ROW_BYTES = 8
BINS = 512
#: A straddling bin under this share of a shard's target isn't divided further.
NEAR = 0.0005
BUCKET_ROWS = 500
_TIE = 1 << 32


@dataclass
class Node:
    lo: int  # its shards: lo .. hi - 1
    hi: int


def coded(col: Column) -> Column:
    """A place between 0 and 1 for each value of a categorical column; null at 0."""
    return F.coalesce(F.when(col.isNotNull(), F.crc32(col.cast("string").cast("binary")) / F.lit(float(1 << 32))), F.lit(0.0))


def _units(df: DataFrame, key: str, text: str, dims: list[Column], shards: int) -> tuple[DataFrame, DataFrame, float]:
    """Rows, units and the target bytes of a shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        df.select(
            F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row"),
            *(F.coalesce(d.cast("double"), F.lit(0.0)).alias(f"d{i}") for i, d in enumerate(dims)),
        ),
        "shard-rows",
    )
    places = [f"d{i}" for i in range(len(dims))]
    total, *ranges = rows.agg(F.sum("size"), *(f(c) for c in places for f in (F.min, F.max))).first()
    target = (total or 0) / shards
    same = ["h", "crc", "size"]
    groups = rows.groupBy(*same).agg(F.sum("size").alias("w"))
    # At most `shards` groups exceed the target: they are broadcast.
    large = groups.where(F.col("w") > target).select(*same, F.ceil(F.col("w") / max(target / 16, 1)).cast("long").alias("parts"))
    rows = rows.join(F.broadcast(large), same, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    # An aggregate buffer of longs, not of structs: the least row by the key's hash stands for the unit.
    units = rows.groupBy(*same, "part").agg(F.sum("size").alias("w"), F.min_by(F.struct(*places), F.xxhash64("doc_id", *places)).alias("at"))
    keys = []
    for i, c in enumerate(places):
        a, b = ranges[2 * i] or 0.0, ranges[2 * i + 1] or 0.0
        scaled = F.floor((F.col(f"at.{c}") - F.lit(a)) / F.lit(max(b - a, 1e-300)) * F.lit(float((1 << 31) - 1)))
        keys.append((scaled * F.lit(_TIE) + F.pmod(F.xxhash64("h", "crc", "part", F.lit(i)), F.lit(_TIE))).cast("long").alias(f"k{i}"))
    units = stored(units.select(*same, "part", "w", *keys), "shard-units")
    return rows, units, target


def _key(dim: Column, n: int) -> Column:
    out = F.col("k0")
    for i in range(1, n):
        out = F.when(dim == i, F.col(f"k{i}")).otherwise(out)
    return out


def _thresholds(placed: DataFrame, nodes: dict[int, Node], widest: dict[int, tuple[int, int, int, int]], n_dims: int, target: float) -> dict[int, int]:
    """For each node the largest key that goes left."""
    spark = placed.sparkSession
    state = {k: (a, b, 0, (nodes[k].hi - nodes[k].lo) // 2 / (nodes[k].hi - nodes[k].lo) * w) for k, (_, a, b, w) in widest.items()}
    found: dict[int, int] = {}
    while state:
        asked = spark.createDataFrame([(k, widest[k][0], a, b, max(1, -(-(b - a + 1) // BINS))) for k, (a, b, _, _) in state.items()], "node int, dim int, a long, b long, step long")
        key = _key(F.col("dim"), n_dims)
        bins = (
            placed.join(F.broadcast(asked), "node").withColumn("key", key).where("key between a and b")
            .groupBy("node", F.floor((F.col("key") - F.col("a")) / F.col("step")).cast("int").alias("bin"))
            .agg(F.sum("w").alias("w"), F.min("key").alias("first"), F.max("key").alias("last"))
        )
        by_node: dict[int, list] = {}
        for r in bins.collect():
            by_node.setdefault(r.node, []).append((r.bin, int(r.w), r.first, r.last))
        left = {}
        for k, (a, _, before, want) in state.items():
            below, cut = before, a - 1
            for _, w, first, last in sorted(by_node.get(k, [])):
                if below + w <= want:
                    below, cut = below + w, last
                    continue
                if first == last or w <= NEAR * target:
                    cut = last if below + w - want < want - below else cut
                else:
                    left[k] = (first, last, below, want)
                break
            found[k] = cut
        state = left
    return found


def assign(df: DataFrame, dims: list[Column], shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows, units, target = _units(df, id_col, text_col, dims, shards)
    nodes, placed, n = {0: Node(0, shards)}, units.withColumn("node", F.lit(0)), len(dims)
    spark = df.sparkSession
    while any(x.hi - x.lo > 1 for x in nodes.values()):
        spans = placed.groupBy("node").agg(F.sum("w").alias("w"), *(f(f"k{i}").alias(f"{g}{i}") for i in range(n) for f, g in ((F.min, "a"), (F.max, "b")))).collect()
        open_nodes = {k: x for k, x in nodes.items() if x.hi - x.lo > 1}
        widest = {}
        for r in spans:
            if r.node in open_nodes:
                i = max(range(n), key=lambda i: (r[f"b{i}"] // _TIE - r[f"a{i}"] // _TIE, -i))
                widest[r.node] = (i, r[f"a{i}"], r[f"b{i}"], int(r.w))
        cuts = _thresholds(placed, nodes, widest, n, target)
        # A node's left child keeps its number; numbers are those of the nodes' first shards.
        splits, new = [], {k: x for k, x in nodes.items() if k not in open_nodes}
        for k, x in open_nodes.items():
            middle = x.lo + (x.hi - x.lo) // 2
            new |= {x.lo: Node(x.lo, middle), middle: Node(middle, x.hi)}
            if k in cuts:
                splits.append((k, widest[k][0], cuts[k], middle))
        table = spark.createDataFrame(splits, "node int, dim int, cut long, right_node int")
        moved = F.when(_key(F.col("dim"), n) > F.col("cut"), F.col("right_node")).otherwise(F.col("node"))
        # Written once a level: the next one's histograms read it several times.
        placed = stored(placed.join(F.broadcast(table), "node", "left").withColumn("node", moved).drop("dim", "cut", "right_node"), "shard-level")
        nodes = new
    same = ["h", "crc", "size", "part"]
    where = stored(placed.select(*same, F.col("node").alias("shard")), "shard-of-unit")
    placed_rows = stored(rows.select("doc_id", "row", *same).join(where, same).select("doc_id", "row", "size", "crc", "shard"), "shard-of-row")
    return numbered(placed_rows, shards)


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Number each shard's rows from 0, in buckets that a hash of the rows' own numbers fills evenly."""
    buckets = max(1, rows.count() // (shards * BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", F.expr("sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding)").alias("before"))
    at = F.expr("row_number() over (partition by shard, bucket order by doc_id, crc, size)")
    return rows.withColumn("at", at).join(before, ["shard", "bucket"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.coalesce("before", F.lit(0)) + F.col("at") - 1).cast("long").alias("slot")
    )
