"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

Texts are lower-cased and cut into words of letters and digits.  For every item
the windows of the item's number of words (all of a shorter text) are compared
with it by the weighted Jaccard similarity of their five-word shingles: the sum
over shingles of the lesser count over the sum of the greater one.  A text with
a window of THRESHOLD or more is contaminated by the item.

A window of THRESHOLD or more holds a certain number of shared shingles at least
(of two sets of m, 8/9 of m), wherever they stand in the item, so every start
whose window covers that many shingles of items of its length is fingerprinted,
and no other.  A fingerprint is a 64-bit SimHash of the window's words, in
BLOCKS blocks that fall into GROUPS groups.  Items are indexed by their length
and every pair of blocks of a group: fingerprints that differ in RADIUS bits at
most agree in more blocks than there are groups, so in two of one group, and the
index finds all of these by keys of eight bits.  Candidates are then verified by
the exact similarity.

The items' shingles are broadcast if a count shows no more than BROADCAST_ROWS
of them, and joined by a shuffle otherwise.  No Python runs on executors.

Edge cases: null or empty texts and items match nothing; items of fewer than
five words are one shingle of their length, matched wherever these words stand;
repeated rows are all reported; an item id that stands for several texts counts
by its most similar one; of equally similar windows the first that lines up with
a shared shingle (the first at all if none does) is the place; empty tables give an empty result; other columns of
the inputs are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SHINGLE = 5
THRESHOLD = 0.8
BITS = 64
BLOCKS, GROUPS = 16, 2
#: Fingerprints that differ in so many bits at most share a key for sure.
RADIUS = BLOCKS - GROUPS - 1
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """The lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingled(w: str, k: int) -> Column:
    """A hash of every k consecutive words of the array column ``w``; empty if there are fewer."""
    parts = ", ".join(f"{w}[i + {d}]" for d in range(k))
    return F.expr(f"if(size({w}) < {k}, cast(array() as array<bigint>), transform(sequence(0, size({w}) - {k}), i -> xxhash64({parts})))")


def simhash(hashes: str) -> Column:
    """The SimHash of an array of word hashes: a bit is set where over half of them have it."""
    half = f"size({hashes}) / 2.0D"
    return F.expr(
        f"aggregate(sequence(0, {BITS - 1}), 0L, (acc, b) -> acc | if(size(filter({hashes}, h -> getbit(h, b) = 1)) > {half}, shiftleft(1L, b), 0L))"
    )


def _keys(fingerprint: str) -> Column:
    """One number for each pair of blocks of a group: the pair and its bits."""
    width, per_group = BITS // BLOCKS, BLOCKS // GROUPS
    block = lambda i: f"(shiftrightunsigned({fingerprint}, {i * width}) & {(1 << width) - 1})"
    pairs = [p for g in range(GROUPS) for p in combinations(range(g * per_group, (g + 1) * per_group), 2)]
    return F.explode(F.array(*(F.expr(f"{k << 2 * width}L | shiftleft({block(i)}, {width}) | {block(j)}") for k, (i, j) in enumerate(pairs))))


def _starts() -> Column:
    """Starts of all windows that can be similar to an item of ``length`` words, from ``p``, the sorted places of its shingles in a text of ``n``.

    The window and the item have b and a shingles; a similarity of t takes
    t / (1 + t) * (a + b) common ones.  So many consecutive places within a
    window allow the starts from its last place's reach to its first place.
    """
    t = int(THRESHOLD * 1000)
    b = "(least(n, length) - k + 1)"
    need = f"cast(ceil({t} * (length - k + 1 + {b}) / {1000 + t}.0D) as int)"
    spans = f"transform(sequence(1, size(p) - {need} + 1), i -> struct(greatest(p[i + {need} - 2] - {b} + 1, 0) as lo, least(p[i - 1], greatest(n - length, 0)) as hi))"
    starts = f"array_distinct(flatten(transform(filter({spans}, x -> x.lo <= x.hi), x -> sequence(x.lo, x.hi))))"
    return F.expr(f"if(size(p) < {need}, cast(array() as array<int>), {starts})")


def _lined_up() -> Column:
    """Whether the window starts where a shared shingle's place in the item puts it, moved into the text if that is outside."""
    pairs = "exists(sequence(0, size(shingles) - 1), i -> exists(sequence(0, size(item_shingles) - 1), j -> {} and shingles[i] = item_shingles[j]))"
    same = "exists(sequence(0, least(size(shingles), size(item_shingles)) - 1), i -> shingles[i] = item_shingles[i])"
    return F.expr(f"{same} or (start = 0 and {pairs.format('i < j')}) or (start = greatest(n - length, 0) and {pairs.format('i > j')})")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(benchmark[item_col].alias("item_id"), words(benchmark[text_col]).alias("w")).where("size(w) > 0")
    rows = rows.withColumn("length", F.size("w")).withColumn("k", F.least("length", F.lit(SHINGLE)))
    sh = F.when(F.col("k") == SHINGLE, shingled("w", SHINGLE))
    for k in range(1, SHINGLE):
        sh = sh.when(F.col("k") == k, shingled("w", k))
    rows = rows.withColumn("shingles", sh).withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("variant", F.xxhash64("hashes")).drop("w")
    return stored(rows.dropDuplicates(["item_id", "variant"]).withColumn("fingerprint", simhash("hashes")), "items")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, c1, c2 (a hash of the text), item_id, similarity, and the first best window's place: start_word and n_words."""
    rows = docs.select(docs[id_col].alias("doc_id"), *text_key(docs[text_col])).where(docs[text_col].isNotNull())
    return rows.join(text_leaks(docs.select(docs[text_col].alias("text")), benchmark, item_col, item_text_col), ["c1", "c2"])


def text_key(text: Column) -> list[Column]:
    """128 bits of hash of a text: c1 and c2."""
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2")]


def text_leaks(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """c1, c2, item_id, similarity, start_word and n_words for every distinct ``text`` that holds an item."""
    items = _items(benchmark, item_col, item_text_col)
    texts = docs.where("text is not null").select(*text_key(F.col("text")), "text")
    row = ["c1", "c2"]
    at = items.select("k", "length", F.explode("shingles").alias("shingle"))
    # Items of the same length are looked for alike.
    lined = stored(at.groupBy("k", "shingle").agg(F.collect_set("length").alias("to")), "shingles")
    sizes = {r.k: r["count"] for r in lined.groupBy("k").count().collect()}
    places = None
    for k, n in sizes.items():
        found = lined.where(F.col("k") == k).select("shingle", "to")
        found = F.broadcast(found) if n <= BROADCAST_ROWS else found
        split = texts.select(*row, words(F.col("text")).alias("w"))
        hits = split.select(*row, F.size("w").alias("n"), F.posexplode(shingled("w", k)).alias("place", "shingle")).join(found, "shingle")
        part = hits.select(*row, "n", F.lit(k).alias("k"), F.explode("to").alias("length"), "place")
        places = part if places is None else places.unionByName(part)
    if places is None:
        places = texts.limit(0).select(*row, *(F.lit(0).alias(c) for c in ("n", "k", "length", "place")))
    at = places.groupBy(*row, "n", "k", "length").agg(F.array_sort(F.collect_set("place")).alias("p"))
    wanted = stored(at.select(*row, "length", F.explode(_starts()).alias("start")).groupBy(*row).agg(F.collect_list(F.struct("length", "start")).alias("windows")), "windows")
    # Texts come back for the windows' sake only, each once.
    again = texts.groupBy(*row).agg(F.first("text").alias("text")).join(wanted.hint("merge"), row).select(*row, words(F.col("text")).alias("w"), "windows")
    again = again.select(*row, F.transform("w", lambda x: F.xxhash64(x)).alias("h"), "w", "windows")
    cut = again.select(
        *row, F.expr("inline(transform(windows, x -> struct(x.length as length, x.start as start, size(w) as n, slice(h, x.start + 1, x.length) as hashes, slice(w, x.start + 1, x.length) as w)))"),
    )
    prints = stored(cut.withColumn("fingerprint", simhash("hashes")).withColumn("shingles", F.when(F.col("length") >= SHINGLE, shingled("w", SHINGLE)).otherwise(F.array(F.xxhash64("hashes")))).drop("w", "hashes"), "fingerprints")
    # Equal windows are looked up once.
    distinct = prints.select("length", "fingerprint").distinct().withColumn("key", _keys("fingerprint"))
    index = items.select("length", F.col("fingerprint").alias("item_print")).distinct().withColumn("key", _keys("item_print"))
    near = distinct.join(index, ["length", "key"]).where(f"bit_count(fingerprint ^ item_print) <= {RADIUS}").select("length", "fingerprint", "item_print").distinct()
    of_items = items.select("length", F.col("fingerprint").alias("item_print"), "item_id", F.col("shingles").alias("item_shingles"), F.col("hashes").alias("item_hashes"))
    pairs = stored(near.join(of_items, ["length", "item_print"]).select("length", "fingerprint", "item_id", F.when(F.col("length") >= SHINGLE, F.col("item_shingles")).otherwise(F.array(F.xxhash64("item_hashes"))).alias("item_shingles")), "candidates")
    both = prints.join(pairs, ["length", "fingerprint"])
    common = F.expr("aggregate(array_distinct(array_intersect(item_shingles, shingles)), 0, (acc, s) -> acc + least(size(filter(shingles, x -> x = s)), size(filter(item_shingles, x -> x = s))))")
    scored = both.withColumn("common", common).withColumn("all", F.size("shingles") + F.size("item_shingles") - F.col("common"))
    found = scored.where(F.col("common") * 1000 >= F.col("all") * int(THRESHOLD * 1000)).withColumn("similarity", F.col("common") / F.col("all"))
    best = found.groupBy(*row, "item_id").agg(F.max("similarity").alias("similarity"), F.min_by(F.struct("start", "length"), F.struct(-F.col("similarity"), ~_lined_up(), F.col("start"), F.col("length"))).alias("at"))
    return stored(best.select(*row, "item_id", "similarity", F.col("at.start").alias("start_word"), F.col("at.length").alias("n_words")), "leaks")
