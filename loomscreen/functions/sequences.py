"""Column functions over DNA strings; all run inside the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(x: Column) -> Column:
    """Reverse complement; any letter but A, T, G, C (such as N) stays itself."""
    return F.reverse(F.translate(x, "ATGC", "TACG"))


def letters_as_bases(x: Column, letters: str, bases: str) -> Column:
    """The Latin letters of a text as bases: A, C, G and T stay, N is G, and ``letters`` stand for ``bases``."""
    seq = F.translate(F.upper(F.regexp_replace(x, "[^A-Za-z]", "")), letters, bases)
    return F.translate(seq, "N", "G")


def slice_of(x: Column, start: int, stop: int | None = None) -> Column:
    """Characters start .. stop - 1, counted from 0; to the end without ``stop``."""
    return F.substring(x, start + 1, 2**31 - 1 - start if stop is None else stop - start)


def field(x: Column, separator: str, position: int) -> Column:
    """The n-th part (from 0; negative from the end) of a separated string."""
    return F.split_part(x, F.lit(separator), F.lit(position + 1 if position >= 0 else position))


def ratio(x: Column) -> Column:
    """'a/b' as a number; null where b is 0 or the text isn't of that form."""
    return F.try_divide(field(x, "/", 0).try_cast("double"), field(x, "/", 1).try_cast("double"))


def pair_key(a: Column, b: Column, separator: str = "+") -> Column:
    """The same text for a pair in either order."""
    return F.concat(F.least(a, b), F.lit(separator), F.greatest(a, b))


def after_motif(x: Column, motifs: list[str], take: int) -> Column:
    """The ``take`` bases after the first motif of the list that occurs; null if none does."""
    out = F.lit(None).cast("string")
    for m in reversed(motifs):
        out = F.when(F.instr(x, m) > 0, F.substring(x, F.instr(x, m) + len(m), F.lit(take))).otherwise(out)
    return out


def first_guide(x: Column, motifs: tuple[str, ...] = ("TAAAC", "AAAC"), take: int = 20) -> Column:
    """Reverse complement of the bases after the first motif found; empty if none is."""
    return F.coalesce(revcomp(after_motif(x, list(motifs), take)), F.lit(""))


def second_guide(x: Column, motifs: tuple[str, ...] = ("CAAAC", "AAAC"), skip: int = 140, take: int = 20, strict: bool = True) -> Column:
    """As first_guide in the read without its first ``skip`` bases; else bases -23 .. -4 of what is left.

    strict: the tail is taken from 23 bases or more only; else also from less.
    """
    tail = slice_of(x, skip)
    n = F.length(tail)
    last = F.substring(tail, F.greatest(n - 22, F.lit(1)), F.greatest(F.least(F.lit(take), n - 3), F.lit(0)))
    fallback = F.when(n >= 23, last).otherwise(F.lit("")) if strict else last
    return revcomp(F.coalesce(after_motif(tail, list(motifs), take), fallback))


#: Fixed value: the order in which bases are tried.
TRIED_BASES = "ATCG"


def edit_variants(motif: str) -> list[str]:
    """The motif, then what one edit makes of it, each text once and in the order of tries.

    An edit puts a filler in place of ``width`` bases from a place on: a base for
    a base anywhere, nothing for an inner base, a base between two bases.
    """
    n = len(motif)
    kinds = ((1, range(n), TRIED_BASES), (1, range(1, n - 1), ("",)), (0, range(1, n), TRIED_BASES))
    tries = {motif: None}
    for width, places, fillers in kinds:
        tries |= dict.fromkeys(f"{motif[:at]}{filler}{motif[at + width :]}" for at, filler in product(places, fillers))
    return list(tries)


def tolerant_guide(x: Column, motif: str = "TAAAC", end: str = "CGT", take: int = 20) -> Column:
    """Motif search with one edit: the first variant that leaves ``take`` bases wins; else the bases that end with the last ``end``.

    A chain of native expressions, one for each variant, so no Python runs.
    """
    tries = [F.when((F.instr(x, v) > 0) & (F.length(x) - F.instr(x, v) - len(v) + 1 >= take), F.substring(x, F.instr(x, v) + len(v), F.lit(take))) for v in edit_variants(motif)]
    # Index (from 0) of the last occurrence of ``end``.
    last = F.length(x) - F.instr(F.reverse(x), end[::-1]) - len(end) + 1
    tail = F.when((F.instr(x, end) > 0) & (last >= take), F.substring(x, last - take + 2, F.lit(take)))
    return F.coalesce(revcomp(F.coalesce(*tries, tail)), F.lit(""))


def known_bases(x: Column) -> Column:
    """Every N read as C."""
    return F.replace(x, F.lit("N"), F.lit("C"))


def masked_quality(x: Column) -> Column:
    """A quality string: '!' at unknown bases, 'I' elsewhere."""
    return F.translate(x, "ACGTN", "IIII!")


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    """The four lines of a record."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def identity_score(a: Column, b: Column) -> Column:
    """100 * (1 - edit distance / the longer length): this library's own definition of a match score."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 100.0 * (1 - F.levenshtein(a, b) / longest.cast("double")))
