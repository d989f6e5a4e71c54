"""Fuzzy identity calls and barcode whitelists."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import identity_score, known_bases
from ..sources.scratch import settled
from . import edits as near
from . import pairing

#: About the most identities and sequences of a group that is compared in full.
BROADCAST_LIBRARY, SEQUENCE_ROWS = 32_768, 4_096
#: Letters that a piece of the library's shortest identity has at least in the rounds that join by pieces, and the least share of all pairs at which a round isn't worth its join.
PIECE, DENSE = 4, 1 / 100
#: Pairs from which rounds work in tasks' arrays, and candidates a row of both sides from which a round does that joined by pieces before.
ARRAY_PAIRS, ROW_CANDIDATES = 1 << 26, 16
#: Letters that a half of the shortest identity has at least for each of its edits in these rounds; about the most identities, and the least and most sequences, of a group.
HALF_LETTERS, TREE_LIBRARY, WALKS = 3, 131_072, (1024, 8192)
#: Letters of the longest identities whose distances are worked out in bits of a machine word, and letters of a shared beginning that are kept.
WORD, KEPT = 64, 64


def candidates(seqs: DataFrame, library: DataFrame, edits: int) -> DataFrame:
    """Pairs (seq, identity) among which are all of at most ``edits`` edits; a pair may stand several times."""
    asked, pieces = _pieces(seqs, library, edits)
    return asked.join(pieces, ["m", "i", "piece"]).select("seq", "identity")


def _candidates_number(seqs: DataFrame, library: DataFrame, edits: int) -> float:
    """The rows of ``candidates``, from both sides' numbers by piece."""
    asked, pieces = (df.groupBy("m", "i", "piece").agg(F.count("*").cast("double").alias(n)) for df, n in zip(_pieces(seqs, library, edits), ("a", "b"), strict=True))
    return asked.join(pieces, ["m", "i", "piece"]).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0


def _pieces(seqs: DataFrame, library: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``candidates``: pieces of sequences' places and of identities.

    An identity is cut into edits + 1 pieces, one of which no edit touches.  It
    stands in the sequence moved by x letters, and with lengths that differ by
    d, moving takes at least |x| + |d - x| edits, which leaves few places.  Both
    sides meet by identity length, number of the piece and its letters.
    """
    n = edits + 1
    start = lambda m, i: f"({i} * {m} div {n})"
    size = lambda m, i: f"({start(m, f'({i} + 1)')} - {start(m, i)})"
    library = library.withColumn("m", F.length("identity"))
    pieces = library.selectExpr("identity", "m", f"posexplode(transform(sequence(0, {edits}), i -> substring(identity, {start('m', 'i')} + 1, {size('m', 'i')}))) AS (i, piece)")
    lengths = library.select("m").distinct()
    asked = seqs.selectExpr("seq", "length(seq) AS n", f"explode(sequence(greatest(length(seq) - {edits}, 0), length(seq) + {edits})) AS m").join(lengths, "m")
    places = (
        f"flatten(transform(sequence(0, {edits}), i -> transform(sequence(-(({edits} - n + m) div 2), ({edits} + n - m) div 2), "
        f"x -> struct(i, {start('m', 'i')} + x AS at, {size('m', 'i')} AS size))))"
    )
    asked = asked.selectExpr("seq", "n", "m", f"explode({places}) AS p").where("p.at >= 0 and p.at + p.size <= n")
    return asked.selectExpr("seq", "m", "p.i AS i", "substring(seq, p.at + 1, p.size) AS piece"), pieces


def best_match(seqs: DataFrame, library: DataFrame, least: float = 0.0) -> DataFrame:
    """For each distinct ``seq`` the library ``identity`` of the best score (ties by name), if it is ``least`` or more.

    Scores are worked out once for each distinct sequence, not for each read.
    Rounds of 0, 1, 2, 4 ... edits compare only pairs that share a piece; a
    sequence leaves as soon as no pair of more edits can score as well, or reach
    ``least``.  These rounds end where pieces would have under PIECE letters, or
    would leave DENSE of all pairs or too many rows.  Of large tables, rounds of
    3, 4, 5 ... edits follow that walk trees of the identities' halves.  What is
    left then, sequences far from all identities, is compared with each of them.
    Both work in groups of bounded size.  The result is that of comparing all
    pairs, at any size.
    """
    seqs, library = seqs.select("seq").distinct().where("seq is not null"), settled(library.select("identity").distinct().where("identity is not null"), "library")
    n, shortest, longest = library.agg(F.count("*"), F.min(F.length("identity")), F.max(F.length("identity"))).first()
    if shortest is None:
        return library.select(F.col("identity").alias("seq"), "identity", F.lit(0.0).alias("score")).limit(0)
    left, edits, last, out, trees = settled(seqs, "sequences"), 0, -1, None, False
    while True:
        m = left.count()
        if not m and out is not None:
            return out
        if not trees:
            trees = shortest // (edits + 1) < PIECE or (edits > 1 and _many(left, library, edits, m, n))
            edits = max(3, last + 1) if trees else edits
        if trees and (m * n < ARRAY_PAIRS or edits // 2 * HALF_LETTERS > shortest // 2 or longest + edits > near.WORD):
            break
        if trees:
            close = _near(left, library, edits, least, m)
        else:
            pairs = candidates(left, library, edits) if edits else left.join(library, left["seq"] == library["identity"]).select("seq", "identity")
            close = pairs.where(F.levenshtein("seq", "identity", edits) >= 0).withColumn("score", identity_score(F.col("seq"), F.col("identity"))).where(F.col("score") >= least)
        bound = _bound("seq", edits + 1, longest)
        final = settled(_best(close).where(F.col("score") > bound), "matches")
        out = final if out is None else out.unionByName(final)
        left = settled(left.where(bound >= least).join(final.select("seq"), "seq", "left_anti"), "sequences")
        last, edits = edits, edits + 1 if trees else 2 * edits or 1
    rest = _compared(left, library, least)
    return rest if out is None else out.unionByName(rest)


def _many(seqs: DataFrame, library: DataFrame, edits: int, m: int, n: int) -> bool:
    """A round by pieces isn't worth its join: for its share of all pairs, or its rows where tables are large."""
    number = _candidates_number(seqs, library, edits)
    return number > DENSE * m * n or (m * n >= ARRAY_PAIRS and number > ROW_CANDIDATES * (m + n))


def _near(seqs: DataFrame, library: DataFrame, edits: int, least: float, m: int) -> DataFrame:
    """The best pair of each sequence and group of identities among those of at most ``edits`` edits."""
    fair = -(-m // (2 * int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    walk = min(max(fair, WALKS[0]), WALKS[1])
    nearest = lambda a, b: near.within(a["seq"].tolist(), b["identity"].tolist(), edits, least)
    return pairing.compared(seqs.select("seq"), library.select("identity"), [], walk, TREE_LIBRARY, nearest, "seq string, identity string, score double")


def _bound(seq: str, edits: int, longest: int) -> Column:
    """The best score of a sequence and an identity that are at least so many edits apart."""
    n = F.length(seq)
    reach = F.least(F.greatest(n, F.lit(longest)), n + edits)
    return F.greatest(100.0 * (1 - edits / reach.cast("double")), F.lit(0.0))


def _compared(seqs: DataFrame, library: DataFrame, least: float) -> DataFrame:
    """Every sequence against every identity; those of more than WORD letters by Spark's own function."""
    schema = "seq string, identity string, score double"
    nearest = lambda a, b: _nearest(a["seq"].tolist(), b["identity"].tolist(), least)
    out = pairing.compared(seqs.select("seq"), library.where(F.length("identity") <= WORD).select("identity"), [], SEQUENCE_ROWS, BROADCAST_LIBRARY, nearest, schema)
    long = library.where(F.length("identity") > WORD).select("identity")
    if not long.isEmpty():
        scored = seqs.crossJoin(long).withColumn("score", identity_score(F.col("seq"), F.col("identity"))).where(F.col("score") >= least)
        out = out.unionByName(scored.select("seq", "identity", "score"))
    return _best(out)


def _nearest(seqs: list[str], library: list[str], least: float) -> pd.DataFrame:
    """For each sequence the identity of the best score, ties to the first in order, if it is ``least`` or more.

    A bit for each letter of an identity says how its column of the edit table
    steps up or down (the bit-parallel algorithm of Myers and Hyyro); a sequence's
    letters move all identities' columns at once.  Sequences are taken in order,
    so the columns of a shared beginning are kept.
    """
    if not seqs or not library:
        return pd.DataFrame({"seq": [], "identity": [], "score": []})
    library, seqs = sorted(library), sorted(seqs)
    lengths = np.array([len(x) for x in library])
    word = np.uint32 if lengths.max() <= 32 else np.uint64
    letters = np.full((len(library), max(1, int(lengths.max()))), 0x110000, dtype=np.uint32)
    for k, x in enumerate(library):
        letters[k, : len(x)] = [ord(c) for c in x]
    places = word(1) << np.arange(letters.shape[1], dtype=word)
    masks = {chr(c): ((letters == c) * places).sum(axis=1, dtype=word) for c in np.unique(letters) if c < 0x110000}
    none, one = np.zeros(len(library), dtype=word), word(1)
    own = ((np.arange(letters.shape[1]) < lengths[:, None]) * places).sum(axis=1, dtype=word)
    columns, last, rows = [(~none, none)], "", []
    for seq in seqs:
        shared = min(len(os.path.commonprefix([last, seq])), len(columns) - 1)
        del columns[shared + 1 :]
        up, down = columns[-1]
        for c in seq[shared:]:
            same = masks.get(c, none)
            inner = (((same & up) + up) ^ up) | same
            right, left = down | ~(inner | up), up & inner
            right = (right << one) | one
            outer = same | down
            up, down = (left << one) | ~(outer | right), outer & right
            if len(columns) <= KEPT:
                columns.append((up, down))
        last = seq
        edits = len(seq) + np.bitwise_count(up & own).astype(np.int64) - np.bitwise_count(down & own)
        longest = np.maximum(lengths, len(seq))
        score = 100.0 * (1 - edits / np.maximum(longest, 1))
        k = int(np.argmax(np.where(longest > 0, score, -1.0)))
        if longest[k] > 0 and score[k] >= least:
            rows.append((seq, library[k], float(score[k])))
    return pd.DataFrame(rows, columns=["seq", "identity", "score"])


def _best(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("seq").agg(F.min_by(F.struct("identity", "score"), F.struct(-F.col("score"), "identity")).alias("b"))
    return best.select("seq", "b.identity", "b.score")


def decode_sphere(known: DataFrame, radius: int, letters: str = "ACGT") -> DataFrame:
    """``word`` and ``barcode``: every word that is decoded, and the barcode that it stands for.

    A read has the barcode's length, whatever happened before: insertions push
    the barcode's end out of it, deletions let any letters follow.  So a barcode
    becomes a word by substitutions, insertions and deletions, then by cutting or
    filling up to its length.  A word within ``radius`` edits of a barcode, and of
    no other as few, is decoded to it.  Its rows grow with the barcodes times the
    size of a sphere, about (9 * length) ** radius / radius!.
    """
    bases = F.array(*(F.lit(c) for c in letters))
    w = F.col("word")
    before = lambda i: F.substring(w, F.lit(1), i)
    after = lambda i: F.substring(w, i + 1, F.length(w))
    gaps = F.sequence(F.lit(0), F.length(w))
    places = F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i < F.length(w))
    filled = lambda i, rest: F.transform(bases, lambda b: F.concat(before(i), b, rest))
    edited = F.concat(
        F.flatten(F.transform(gaps, lambda i: filled(i, after(i)))), F.flatten(F.transform(places, lambda i: filled(i, after(i + 1)))), F.transform(places, lambda i: F.concat(before(i), after(i + 1)))
    )
    rows = known.where("barcode is not null").select("barcode", F.col("barcode").alias("word"), F.lit(0).alias("edits")).distinct()
    reached = rows
    for k in range(1, radius + 1):
        rows = rows.select("barcode", F.explode(F.array_distinct(edited)).alias("word"), F.lit(k).alias("edits")).distinct()
        reached = reached.unionByName(rows)
    n = F.length("barcode")
    reached = reached.select("barcode", F.when(F.length("word") > n, F.substring(w, F.lit(1), n)).otherwise(w).alias("word"), "edits")
    for _ in range(radius):
        short = F.length("word") < n
        reached = reached.select("barcode", F.explode(F.when(short, F.transform(bases, lambda b: F.concat(w, b))).otherwise(F.array(w))).alias("word"), "edits")
    near = reached.groupBy("word", "barcode").agg(F.min("edits").alias("edits"))
    rivals = near.groupBy("word", "edits").agg(F.count("*").alias("n"), F.min("barcode").alias("barcode"))
    return rivals.groupBy("word").agg(F.min_by(F.struct("n", "barcode"), "edits").alias("b")).where("b.n = 1").select("word", F.col("b.barcode").alias("barcode"))


def decoded(df: DataFrame, known: DataFrame, column: str, radius: int = 1, into: str = "barcode_mapped", letters: str = "ACGT") -> DataFrame:
    """Rows whose barcode read is decoded, with what it stands for in ``into``; unknown bases are read as C."""
    words = df.select(F.col(column).alias("_read")).distinct().withColumn("word", known_bases(F.col("_read")))
    found = words.join(decode_sphere(known, radius, letters), "word").select("_read", F.col("barcode").alias(into))
    return df.join(found, df[column] == found["_read"]).drop("_read")


def whitelisted(df: DataFrame, known: DataFrame, column: str, correct: bool = False) -> DataFrame:
    """Rows whose barcode is known; with ``correct``, also those one substitution from exactly one known barcode, mapped to it."""
    names = known.select(F.col("barcode").alias(column)).distinct()
    exact = df.join(names, column, "left_semi")
    if not correct:
        return exact
    rest = df.join(names, column, "left_anti")
    wild = lambda c: F.expr(f"explode(transform(sequence(1, length({c})), i -> concat(substring({c}, 1, i - 1), '?', substring({c}, i + 1))))")
    a = rest.select(column).distinct().where(~F.col(column).contains("N")).withColumn("_w", wild(column))
    b = names.withColumnRenamed(column, "_to").withColumn("_w", wild("_to"))
    one = a.join(b, "_w").groupBy(column).agg(F.min("_to").alias("_to"), F.count_distinct("_to").alias("_n")).where("_n = 1").select(column, "_to")
    fixed = rest.join(one, column).withColumn(column, F.col("_to")).select(*df.columns)
    return exact.unionByName(fixed)
