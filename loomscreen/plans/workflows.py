"""Whole analyses: reads to molecules, one-guide screens, two-guide screens.

Each returns new DataFrames; nothing is changed in place.  Results of the
stages that are small (matrices over guides, dendrograms) may be collected by
the operators named in their own docstrings.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import cluster, counts, lowrank, matching, matrix, models, screen
from ..sources.scratch import settled
from ..spec import ScreenSpec


def validate(df: DataFrame, spec: ScreenSpec) -> DataFrame:
    """``df`` if it has rows and all columns that the spec names; else an error."""
    missing = [c for c in (*spec.lineage, *spec.transcripts, *spec.samples) if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def process_reads(first: DataFrame, second: DataFrame, barcodes: DataFrame, umis: DataFrame, library: DataFrame, whitelist: DataFrame, least: float = 80, motif: str = "TAAAC", skip: int = 140, correct: bool = False) -> DataFrame:
    """p1_identity, p2_identity, their scores, barcode_mapped and UMI of every molecule that all four reads support.

    Inputs are records (rec_no, seq) of the four files; guides are called once
    for each distinct sequence, barcodes by the whitelist (barcode), molecules
    by their bases after the first 8 without an N.
    """
    g1 = first.select("rec_no", sq.tolerant_guide(F.col("seq"), motif).alias("seq"))
    g2 = second.select("rec_no", sq.second_guide(F.col("seq"), skip=skip).alias("seq"))
    called = matching.best_match(g1.select("seq").union(g2.select("seq")).where("seq <> ''"), library, least)
    side = lambda g, p: g.join(called, "seq").select("rec_no", F.col("identity").alias(f"{p}_identity"), F.col("score").alias(f"{p}_score"))
    b = barcodes.select("rec_no", sq.revcomp(F.substring("seq", 1, 25)).alias("barcode_mapped"))
    b = matching.whitelisted(b, whitelist, "barcode_mapped", correct)
    u = umis.select("rec_no", sq.slice_of(F.col("seq"), 8).alias("UMI")).where(~F.col("UMI").contains("N"))
    return side(g1, "p1").join(side(g2, "p2"), "rec_no").join(b, "rec_no").join(u, "rec_no").drop("rec_no")


def collapse(reads: DataFrame, spec: ScreenSpec, umi: str = "UMI", transcript: str = "transcript") -> DataFrame:
    """The molecule table: distinct molecules of both transcripts for each lineage and sample."""
    keys = list(dict.fromkeys([*spec.lineage, *spec.samples]))
    return counts.umi_collapse(reads, keys, umi, transcript, {spec.identity: "identity", spec.reporter: "reporter"})


@dataclass(frozen=True)
class SingleResult:
    rows: DataFrame
    summary: DataFrame
    reporter_fit: dict


def standard_single(df: DataFrame, spec: ScreenSpec, rep: DataFrame | None = None, rep_column: str | None = None, prefix: str = "non", floor: float | None = 0.05, pseudocount: float = 10, degree: int = 1) -> SingleResult:
    """Filter, controls, logs, dummies, reporter and identity regressions, summary."""
    rows = validate(df, spec)
    if rep is not None:
        rows = screen.with_representation(rows, rep, list(spec.guides))
    rows = screen.log_transform(screen.set_control(screen.filter_lineages(rows, spec, floor), list(spec.guides), prefix), list(spec.transcripts), pseudocount)
    # The filtered rows feed both regressions and the summary.
    rows = settled(rows, "filtered")
    rows, names = screen.one_hot(rows, list(spec.samples)) if spec.samples else (rows, [])
    rows, fit = models.regress_reporter(rows, spec, names, degree)
    identity = f"log2_{spec.identity}"
    if names:
        rows, identity = models.regress_identity_poisson(rows, spec, names), "identity_resid_rescaled"
    return SingleResult(rows, screen.summary(rows, spec, identity, "log2_reporter_resid", rep_column), fit)


def activity(rows: DataFrame, spec: ScreenSpec, value: str) -> DataFrame:
    """The long matrix of pair means."""
    a, b = spec.guides
    return counts.present(rows, [a, b]).groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.avg(value).alias("v")).where("v is not null")


@dataclass(frozen=True)
class DualResult:
    rows: DataFrame
    summary: DataFrame
    reporter: DataFrame  # pair means (i, j, v), denoised if asked for
    singles: DataFrame  # (control, guide, v)
    effects: DataFrame  # (guide, x)
    pairs: DataFrame  # symmetric guide pairs
    interactions: DataFrame  # (i, j, v, z)


def denoised(m: DataFrame, **settings) -> DataFrame:
    """The low-rank part of one matrix, at its observed cells; warns if the split ended before it converged."""
    parts = settled(lowrank.split_matrices(m.withColumn("_m", F.lit(1)), "_m", **settings), "low_rank")
    if not parts.where("not converged").isEmpty():
        warnings.warn("the low-rank split ended before it converged; its best iterate is used", stacklevel=2)
    return matrix.masked_as(parts.select("i", "j", F.col("low").alias("v")), m)


def standard_dual(
    df: DataFrame, spec: ScreenSpec, rep: DataFrame | None = None, rep_column: str | None = None, prefix: str = "non", floor: float | None = 0.05, pseudocount: float = 10,
    degree: int = 1, pcp: bool = False, method: str = "per_gene", keep_single: bool = False, mask_diagonal: bool = False, **settings,
) -> DualResult:
    """standard_single with both guides as keys, then the matrices and interactions of pairs."""
    one = standard_single(df, spec, rep, rep_column, prefix, floor, pseudocount, degree)
    m = activity(one.rows, spec, "log2_reporter_resid")
    m = settled(denoised(m, **settings) if pcp else m, "activity")
    singles = matrix.singles(m, prefix)
    pairs = matrix.symmetrise(matrix.guide_pairs(m, prefix), keep_single, mask_diagonal)
    return DualResult(one.rows, one.summary, m, singles, matrix.single_effects(singles), pairs, models.interactions(pairs, singles, method))


def clustered(m: DataFrame, optimal: bool = True) -> tuple[DataFrame, DataFrame]:
    """Merges and leaf order of a symmetric matrix by cosine distance and average linkage."""
    d = matrix.as_square(matrix.distance(matrix.cosine(m)).select("a", "b", "v"), 0.0)
    return cluster.order_of(m.sparkSession, d, optimal=optimal)
