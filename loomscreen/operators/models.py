"""Regressions of a screen.

Everything that grows with the rows is an aggregate (sums of products, counts
by cell); only these small sums come to the driver, where numpy solves for the
coefficients.  Predictions are plain column expressions.
"""

from __future__ import annotations

import warnings
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled
from ..spec import ScreenSpec
from .matrix import joint_value, mean_of, single_effects
from .screen import with_scalars

#: Pairs of guides up to which the robust surface is fitted on the driver (four numbers each).
MOST_LOCAL = 200_000


def _products(df: DataFrame, x: list[Column], y: Column) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X (with an intercept), X'y, y'y and n in one pass."""
    cols = [F.lit(1.0), *x, y]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    ok = y.isNotNull()
    for c in x:
        ok = ok & c.isNotNull()
    row = df.where(ok).agg(*(F.coalesce(F.sum((cols[i] * cols[j]).cast("double")), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs)).first()
    full = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        full[i, j] = full[j, i] = row[f"s{i}_{j}"]
    return full[:-1, :-1], full[:-1, -1], full[-1, -1], round(full[0, 0])


def ols(df: DataFrame, x: list[Column], y: Column) -> dict:
    """Least squares with an intercept: coef, intercept, r2.  Collinear columns (full sets of dummies) share their effect."""
    xx, xy, yy, n = _products(df, x, y)
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    beta = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (xy / scale) / scale
    rest = yy - 2 * beta @ xy + beta @ xx @ beta
    total = yy - xy[0] ** 2 / max(n, 1)
    return {"intercept": float(beta[0]), "coef": beta[1:], "r2": float(1 - rest / total) if total > 0 else float("nan"), "n": n}


def powers(x: Column, degree: int) -> list[Column]:
    return [F.pow(x, F.lit(float(k))) for k in range(1, degree + 1)]


def linear(fit: dict, x: list[Column]) -> Column:
    out = F.lit(fit["intercept"])
    for c, b in zip(x, fit["coef"], strict=True):
        out = out + F.lit(float(b)) * c
    return out


def regress_reporter(df: DataFrame, spec: ScreenSpec, dummies: list[str], degree: int = 1, control_only: bool = True, name: str = "log2_reporter_resid") -> tuple[DataFrame, dict]:
    """Residual of the log2 reporter on powers of the log2 identity and the sample dummies, fitted on controls."""
    x = [*powers(F.col(f"log2_{spec.identity}"), degree), *(F.col(c).cast("double") for c in dummies)]
    y = F.col(f"log2_{spec.reporter}")
    fit = ols(df.where("control") if control_only else df, x, y)
    return df.withColumn(name, y - linear(fit, x)), fit


def poisson_cells(counts: pd.DataFrame, columns: list[str], alpha: float = 1.0) -> np.ndarray:
    """Coefficients (intercept first) of an L2-penalised Poisson model from cell sums n and y.

    Minimises the mean of mu - y log mu plus alpha / 2 times the squares of all
    coefficients but the intercept, by Newton's method.
    """
    x = np.column_stack([np.ones(len(counts)), counts[columns].to_numpy(float)])
    n, y = counts["n"].to_numpy(float), counts["y"].to_numpy(float)
    total = n.sum()
    penalty = np.r_[0, np.full(len(columns), alpha)]
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(y.sum() / total, 1e-12))
    value = lambda b: (n @ np.exp(x @ b) - y @ (x @ b)) / total + 0.5 * penalty @ b**2
    for _ in range(200):
        mu = n * np.exp(x @ beta)
        grad = x.T @ (mu - y) / total + penalty * beta
        step = np.linalg.solve((x.T * mu) @ x / total + np.diag(penalty) + 1e-12 * np.eye(len(beta)), grad)
        size = 1.0
        while value(beta - size * step) > value(beta) + 1e-15 and size > 1e-8:
            size /= 2
        beta = beta - size * step
        if np.abs(grad).max() < 1e-12:
            break
    return beta


def regress_identity_poisson(df: DataFrame, spec: ScreenSpec, dummies: list[str], alpha: float = 1.0, pseudocount: float = 1.0, name: str = "identity_resid") -> DataFrame:
    """Residual of the identity count on the sample dummies (fitted on controls), rescaled to the counts' range, and its log2."""
    y = F.col(spec.identity).cast("double")
    cells = df.where("control").groupBy(*dummies).agg(F.count(spec.identity).alias("n"), F.sum(y).alias("y")).toPandas()
    beta = poisson_cells(cells, dummies, alpha)
    eta = F.lit(float(beta[0]))
    for c, b in zip(dummies, beta[1:], strict=True):
        eta = eta + F.lit(float(b)) * F.col(c)
    out = df.withColumn(name, y - F.exp(eta))
    out = with_scalars(out, F.min(name).alias("_a"), F.max(name).alias("_b"), F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    scaled = F.try_divide(F.col(name) - F.col("_a"), F.col("_b") - F.col("_a")) * (F.col("_hi") - F.col("_lo")) + F.col("_lo")
    return out.withColumns({f"{name}_rescaled": scaled, f"log2_{name}_rescaled": F.log2(scaled + pseudocount)}).drop("_a", "_b", "_lo", "_hi")


def huber_concomitant(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, alpha: float = 1e-4) -> np.ndarray:
    """Coefficients (no intercept) of Huber regression with a scale estimated along, by alternating weighted least squares."""
    n, k = x.shape
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    sigma = max(np.std(y - x @ beta), 1e-12)
    for _ in range(2000):
        r = y - x @ beta
        inside = np.abs(r) <= epsilon * sigma
        # d/dsigma of n sigma + sum inside r^2 / sigma + sum outside (2 eps |r| - eps^2 sigma) is 0.
        free = n - epsilon**2 * (~inside).sum()
        new_sigma = max(np.sqrt((r[inside] ** 2).sum() / free), 1e-12) if free > 0 else sigma
        w = np.where(np.abs(r) <= epsilon * new_sigma, 1 / new_sigma, epsilon / np.maximum(np.abs(r), 1e-300))
        new = np.linalg.solve((x.T * w) @ x + alpha * np.eye(k), x.T @ (w * y))
        moved = np.abs(new - beta).max() + abs(new_sigma - sigma)
        beta, sigma = new, new_sigma
        if moved < 1e-12 * (1 + np.abs(beta).max()):
            break
    return beta


def huber_by_sums(rows: DataFrame, x: list[str], y: str, epsilon: float = 1.35, alpha: float = 1e-4, most: int = 500) -> np.ndarray:
    """The coefficients of ``huber_concomitant`` from one aggregate over the rows a round: weighted sums of products, and what the scale needs.

    Warns if they still move after ``most`` rounds.  The rows are read once a
    round: settle them first.
    """
    k = len(x)
    cells = [(a, b) for a in range(k) for b in range(a, k)]

    def sums(beta: np.ndarray, sigma: float | None) -> dict:
        r = F.col(y) - sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        near = F.lit(True) if sigma is None else F.abs(r) <= epsilon * sigma
        w = F.lit(1.0) if sigma is None else F.when(near, 1 / sigma).otherwise(epsilon / F.greatest(F.abs(r), F.lit(1e-300)))
        products = [F.sum(w * F.col(x[a]) * F.col(x[b])).alias(f"p{a}_{b}") for a, b in cells] + [F.sum(w * F.col(c) * F.col(y)).alias(f"q{a}") for a, c in enumerate(x)]
        return rows.agg(*products, F.sum(r).alias("r"), F.sum(r * r).alias("rr"), F.sum(F.when(near, r * r)).alias("inside"), F.count_if(~near).alias("out"), F.count("*").alias("n")).first().asDict()

    def solved(s: dict, penalty: float) -> np.ndarray:
        m = np.zeros((k, k))
        for a, b in cells:
            m[a, b] = m[b, a] = s[f"p{a}_{b}"]
        q = np.array([s[f"q{a}"] for a in range(k)])
        return np.linalg.lstsq(m + penalty * np.eye(k), q, rcond=None)[0]

    s = sums(np.zeros(k), None)
    if not s["n"]:
        return np.zeros(k)
    beta = solved(s, 0.0)
    s = sums(beta, None)
    sigma = max((s["rr"] / s["n"] - (s["r"] / s["n"]) ** 2) ** 0.5 if s["rr"] * s["n"] > s["r"] ** 2 else 0.0, 1e-12)
    for _ in range(most):
        s = sums(beta, sigma)
        free = s["n"] - epsilon**2 * s["out"]
        new, new_sigma = solved(s, alpha), max(((s["inside"] or 0.0) / free) ** 0.5, 1e-12) if free > 0 else sigma
        moved = np.abs(new - beta).max() + abs(new_sigma - sigma)
        beta, sigma = new, new_sigma
        if moved < 1e-11 * (1 + np.abs(beta).max()):
            return beta
    warnings.warn(f"the robust fit still moves by {moved:.1e} after {most} rounds", stacklevel=2)
    return beta


def joint_surface(pairs: DataFrame, effects: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Interactions: pairs (i, j, v) minus the fitted a (x1^2 + x2^2) + b (x1 + x2) + c x1 x2, and (a, b, c).

    The fit takes the upper triangle with the diagonal.  Up to MOST_LOCAL of its
    rows come to the driver; more are fitted by sums over the table.
    """
    left, right = (effects.select(F.col("guide").alias(k), F.col("x").alias(f"x{k}")) for k in ("i", "j"))
    rows = pairs.join(left, "i").join(right, "j")
    a, b = F.col("xi"), F.col("xj")
    terms = [(a * a + b * b).alias("t0"), (a + b).alias("t1"), (a * b).alias("t2")]
    data = settled(rows.where("i <= j and v is not null and xi is not null and xj is not null").select("i", "j", *terms, "v"), "surface")
    if data.count() > MOST_LOCAL:
        fit = huber_by_sums(data, ["t0", "t1", "t2"], "v")
    else:
        local = data.toPandas().sort_values(["i", "j"])
        fit = huber_concomitant(local[["t0", "t1", "t2"]].to_numpy(float), local["v"].to_numpy(float)) if len(local) else np.zeros(3)
    return rows.select("i", "j", (F.col("v") - joint_value(F.col("xi"), F.col("xj"), *map(float, fit))).alias("v")), fit


def huber_loss(r: Column, delta: float) -> Column:
    """Half the square up to ``delta``, linear beyond."""
    a = F.abs(r)
    return F.when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))


def _huber(r: np.ndarray, delta: float) -> float:
    a = np.abs(r)
    return float(np.where(a <= delta, 0.5 * r * r, delta * (a - 0.5 * delta)).sum())


def monotone_quadratic(x: np.ndarray, y: np.ndarray, delta: float = 1.35, alpha: float = 1e-4) -> tuple[float, float]:
    """(a, b) of y = a x^2 + b x under Huber loss and a small penalty, with a slope >= 0 over the range of x.

    The constraint is two linear inequalities (the slope at both ends), so the
    problem is convex: the best of the unconstrained fit, the fits along either
    bound, and the corner.
    """
    basis = np.column_stack([x * x, x])

    def value(p: np.ndarray) -> float:
        return _huber(y - basis @ p, delta) + alpha * float(p @ p)

    def fit(directions: np.ndarray) -> np.ndarray:
        z, t = basis @ directions, np.zeros(directions.shape[1])
        for _ in range(500):
            r = y - z @ t
            w = np.minimum(1.0, delta / np.maximum(np.abs(r), 1e-300))
            new = np.linalg.solve((z.T * w) @ z + 2 * alpha * directions.T @ directions, z.T @ (w * y))
            if np.abs(new - t).max() < 1e-12:
                break
            t = new
        return directions @ t

    ends = np.array([[2 * x.min(), 1.0], [2 * x.max(), 1.0]])
    tries = [np.zeros(2), fit(np.eye(2))]
    # Along a bound 2 a e + b = 0.
    tries += [fit(np.array([[1.0], [-e[0]]])) for e in ends]
    best = min((p for p in tries if (ends @ p >= -1e-9).all()), key=value)
    return float(best[0]), float(best[1])


def per_gene(pairs: DataFrame, effects: DataFrame, least: int = 6) -> DataFrame:
    """Interactions by one monotone quadratic a query guide: (query, target, v); queries with fewer partners are left out.

    A group is one guide's row of the matrix, so its size is the number of guides.
    """
    q, t = effects.select(F.col("guide").alias("i"), F.col("x").alias("s")), effects.select(F.col("guide").alias("j"), F.col("x").alias("x"))
    rows = pairs.where("v is not null").join(q, "i").join(t, "j").select("i", "j", "v", "s", "x")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pdf.iloc[:0][["i", "j"]].assign(v=0.0)
        x, y = pdf["x"].to_numpy(float), (pdf["v"] - pdf["s"]).to_numpy(float)
        a, b = monotone_quadratic(x, y)
        return pdf[["i", "j"]].assign(v=y - a * x * x - b * x)

    kind = pairs.schema["i"].dataType.simpleString()
    return rows.groupBy("i").applyInPandas(solve, f"i {kind}, j {kind}, v double")


def symmetric_interactions(delta: DataFrame) -> DataFrame:
    """Mean of both directions, or the one there is."""
    other = delta.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return delta.join(other, ["i", "j"], "full_outer").select("i", "j", mean_of(F.col("v"), F.col("w")).alias("v"))


def interactions(pairs: DataFrame, singles: DataFrame, method: str = "joint") -> DataFrame:
    """Genetic interactions of guide pairs by ``joint`` or ``per_gene``, with z."""
    ways = {"joint": lambda e: joint_surface(pairs, e)[0], "per_gene": lambda e: symmetric_interactions(per_gene(pairs, e))}
    if method not in ways:
        raise ValueError(f"no such method: {method}; there are {', '.join(ways)}")
    m = settled(ways[method](single_effects(singles)), "interactions")
    return with_scalars(m, F.stddev_pop("v").alias("_s")).withColumn("z", F.try_divide("v", "_s")).drop("_s")
