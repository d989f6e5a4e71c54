"""Rank tests and false-discovery control."""

from __future__ import annotations

from functools import reduce
from math import erfc, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..sources.scratch import settled
from . import running


#: The most distinct values whose running counts are sent to all tasks.
PLACES = 1 << 21


@F.pandas_udf(DoubleType())
def erfc_udf(x: pd.Series) -> pd.Series:
    """Complementary error function, by Arrow batches."""
    return x.map(erfc, na_action="ignore")


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1, ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def tie_term(df: DataFrame, value: str) -> DataFrame:
    """One row, ``ties``: the sum of t ** 3 - t over all values' numbers of rows, added up exactly in 38 digits."""
    t = F.col("t").cast("decimal(38,0)")
    return df.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(t * t * t - t).cast("double").alias("ties"))


def mann_whitney(df: DataFrame, group: str, value: str, controls: DataFrame, only: str | None = None) -> DataFrame:
    """Each group against each control group, or, by the column ``only``, its rows against the control group named there: u, cles, rbc, z (tie- and continuity-corrected) and p.

    ``controls`` has the same columns.  For a control group its values and all
    groups' values stand in one order, dealt in ranges, so the numbers of lesser
    and equal controls come from one running sum, whatever the groups' number.
    The ties' sum is the controls' own plus a correction at the group's values.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("x"), *([F.col(only).alias("c")] if only else [])).agg(F.count("*").alias("n"))
    y = controls.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("c"), F.col(value).alias("x")).agg(F.count("*").alias("m"))
    triple = lambda t: t.cast("double") * t * t - t
    y = settled(y, "controls")
    names = y.groupBy(F.col("c").alias("_c")).agg(F.sum("m").cast("double").alias("n2"), F.sum(triple(F.col("m"))).alias("own"))
    groups = F.broadcast(names.select(F.col("_c").alias("c")))
    a = (x.join(groups, "c") if only else x.crossJoin(groups)).select("c", "x", "g", "n", F.lit(0).cast("long").alias("m"), F.lit(True).alias("asks"))
    b = y.select("c", "x", F.lit(None).cast(x.schema["g"].dataType).alias("g"), F.lit(0).cast("long").alias("n"), "m", F.lit(False).alias("asks"))
    rows = running.carried(running.ranged(a.unionByName(b), "c", "x"), ["c"], {"before": (F.sum("m"), F.sum)})
    here = Window.partitionBy("c", running.RANGE)
    equal = F.sum("m").over(Window.partitionBy("c", running.RANGE, "x"))
    rows = rows.withColumn("equal", equal).withColumn("below", F.sum("m").over(here.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)) - F.col("equal") + F.coalesce("before", F.lit(0)))
    out = rows.where("asks").groupBy("g", "c").agg(
        F.sum("n").cast("double").alias("n1"), F.sum(F.col("n") * (F.col("below") + F.col("equal") / 2.0)).alias("u"), F.sum(triple(F.col("n") + F.col("equal")) - triple(F.col("equal"))).alias("more")
    ).join(F.broadcast(names), F.col("c").eqNullSafe(F.col("_c"))).drop("_c")
    return _statistics(out, "g", "c")


def _statistics(out: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and u, cles, rbc, z and p, from n1, n2, u and the ties' sum, own + more."""
    n1, n2, u = F.col("n1"), F.col("n2"), F.col("u")
    n, full = n1 + n2, n1 * n2
    sigma = F.sqrt(full / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("own") + F.col("more"), n * (n - 1)), F.lit(0.0))))
    least = F.least(u, full - u)
    # The continuity correction doesn't turn the sign: p is 1 at most.
    z = F.when((sigma > 0) & (n > 1), F.greatest(F.abs(least - full / 2) - 0.5, F.lit(0.0)) / sigma).otherwise(0.0)
    return out.select(*keep, "u", F.try_divide(u, full).alias("cles"), (2 * F.try_divide(u, full) - 1).alias("rbc"), z.alias("z")).withColumn("p", erfc_udf(F.col("z") / F.sqrt(F.lit(2.0))))


def mann_whitney_within(df: DataFrame, by: str, group: list[str], value: str, control: str) -> DataFrame:
    """Each group's rows in ``by`` against all rows there that ``control`` marks: by, group, rows, mean (of known values), and as ``mann_whitney``; null statistics where there is nothing to compare.

    The running counts of controls are made over distinct values only and joined
    to the rows, so rows are dealt once, by group: of up to PLACES values the
    counts are sent to the tasks, beyond, rows are dealt by value too.
    """
    known = df.where(F.col(value).isNotNull() & F.col(by).isNotNull())
    values = known.groupBy(F.col(by).alias("_c"), F.col(value).alias("_x")).agg(F.count_if(control).alias("_m"))
    rows = running.carried(running.ranged(values, "_c", "_x"), ["_c"], {"_before": (F.sum("_m"), F.sum)})
    upto = F.sum("_m").over(Window.partitionBy("_c", running.RANGE).orderBy(running.PLACE).rowsBetween(Window.unboundedPreceding, 0))
    places = settled(rows.select("_c", "_x", (upto - F.col("_m") + F.coalesce("_before", F.lit(0))).alias("_below"), "_m"), "places")
    triple = lambda t: t.cast("double") * t * t - t
    names = places.groupBy("_c").agg(F.sum("_m").cast("double").alias("n2"), F.sum(triple(F.col("_m"))).alias("own")).where("n2 > 0")
    # Rows of a group are together from here on, so counting its values and adding them up need no further exchange.
    counted = df.select(by, *group, F.col(value).alias("_x")).repartition(by, *group).groupBy(by, *group, "_x").agg(F.count("*").alias("_n"))
    found = counted.join(F.broadcast(places) if places.count() <= PLACES else places, (F.col(by) == F.col("_c")) & (counted["_x"] == places["_x"]), "left").drop("_c").drop(places["_x"])
    n, e = F.when(F.col("_x").isNotNull(), F.col("_n")), F.coalesce("_m", F.lit(0))
    sums = found.groupBy(by, *group).agg(
        F.sum("_n").alias("rows"), F.sum(n).cast("double").alias("n1"), F.sum(n * F.col("_x")).alias("sum"), F.sum(n * (F.col("_below") + e / 2.0)).alias("u"), F.sum(triple(n + e) - triple(e)).alias("more")
    )
    sums = sums.withColumn("mean", F.try_divide("sum", "n1")).join(F.broadcast(names), F.col(by) == F.col("_c"), "left").drop("_c")
    tests = ["u", "cles", "rbc", "z", "p"]
    some = F.col("n1").isNotNull() & F.col("n2").isNotNull()
    out = _statistics(sums.withColumn("_some", some), by, *group, "rows", "mean", "_some")
    return out.select(by, *group, "rows", "mean", *(F.when(F.col("_some"), F.col(c)).alias(c) for c in tests))


def bh_adjust(df: DataFrame, p: str, name: str, *by: str) -> DataFrame:
    """Benjamini-Hochberg: the least of p * n / rank over all ranks from a row's on; nulls stay null.

    Ranks and minima run over ranges of the order, so one large set of tests isn't sorted in one task.
    """
    # Written once: sampling the ranges, dealing the rows and the nulls would each work the tests out again.
    df = settled(df, "tests")
    # Of equal p the last rank counts for all, so their order is free: a hash keeps a frequent one from being a range of its own.
    known = df.where(F.col(p).isNotNull()).withColumn("_tie", F.xxhash64(*df.columns))
    rows = running.ranged(known, *by, p, "_tie").drop("_tie")
    rows = running.carried(rows, [*by], {"_before": (F.count("*"), F.sum)}, whole={"_n": (F.count("*"), F.sum)})
    part = Window.partitionBy(*by, running.RANGE)
    rank = F.row_number().over(part.orderBy(running.PLACE)) + F.coalesce("_before", F.lit(0))
    rows = rows.withColumn("_r", rank).withColumn("_q", F.col(p) * F.col("_n") / F.col("_r"))
    rows = running.carried(rows, [*by], {"_later": (F.min("_q"), F.min)}, last_first=True)
    here = F.min("_q").over(part.orderBy(F.desc(running.PLACE)).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn(name, F.least(F.lit(1.0), here, F.col("_later"))).select(*df.columns, name)
    return rows.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def against_controls(df: DataFrame, controls: DataFrame, group: str, outcomes: list[str]) -> DataFrame:
    """Per group and outcome: medians of p, cles and rbc over the control groups, p adjusted within the outcome, and its -log10."""
    out = None
    for o in outcomes:
        t = mann_whitney(df, group, o, controls).groupBy("g").agg(*(F.median(c).alias(c) for c in ("p", "cles", "rbc")))
        t = t.select(F.col("g").alias(group), F.lit(o).alias("outcome"), "rbc", "cles", F.col("p").alias("p_value"))
        out = t if out is None else out.unionByName(t)
    return bh_adjust(out, "p_value", "p_adj", "outcome").withColumn("minus_log10_p_adj", -F.log10("p_adj"))


def pearson_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """r, its t statistic and n."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = both.agg(F.corr(a, b).alias("r"), F.count("*").alias("n"))
    return r.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))


def log10_t_tail(t, df):
    """log10 of the two-sided tail of Student's t, by the incomplete beta function's continued fraction; numbers or arrays."""
    t, df = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(df, dtype=float))
    shape, t, df = t.shape, np.atleast_1d(t), np.atleast_1d(df)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0) & np.isfinite(df)
    square = t[ok] * t[ok]
    x, rest = df[ok] / (df[ok] + square), square / (df[ok] + square)
    a, b = df[ok] / 2, np.full(len(x), 0.5)
    gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log(rest)
    turned = x >= (a + 1) / (a + b + 2)
    f = _fraction(np.where(turned, b, a), np.where(turned, a, b), np.where(turned, rest, x))
    with np.errstate(divide="ignore", invalid="ignore"):
        body = np.log10(np.maximum(1 - np.exp(front) * f / b, 1e-300))
        out[ok] = np.where(turned, body, (front + np.log(f / a)) / np.log(10))
    out[np.isinf(t) & (df > 0)] = -np.inf
    return out.reshape(shape) if shape else float(out[0])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz), all places at once."""
    tiny = 1e-300
    some = lambda v: np.where(v == 0, tiny, v)
    c, d = np.ones(len(x)), 1 / some(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / some(1 + k * d), 1 + k / some(c)
            out = out * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return out


@F.pandas_udf(DoubleType())
def log10_t_tail_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    """log10_t_tail by Arrow batches; null for missing values and degrees of freedom of 0 or less."""
    return pd.Series(log10_t_tail(t.to_numpy(float), df.to_numpy(float)))


#: log10 of the least normal positive double.
LEAST = -307.6526555685888


def p_bound(log10_p: Column) -> Column:
    """The exponent of the least power of ten over p, or over the least positive double."""
    return (F.floor(F.greatest(log10_p, F.lit(LEAST))) + 1).cast("int")


__all__ = ["against_controls", "average_rank", "bh_adjust", "erfc_udf", "log10_t_tail", "log10_t_tail_udf", "mann_whitney", "mann_whitney_within", "p_bound", "pearson_test", "tie_term"]
