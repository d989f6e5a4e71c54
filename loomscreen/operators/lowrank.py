"""Split of a matrix with holes into a low-rank and a sparse part (square-root principal component pursuit)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def shrink_singular(x: np.ndarray, t: float) -> tuple[np.ndarray, float]:
    """Soft threshold of the singular values, and the sum of what is left of them."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    s = np.maximum(s - t, 0)
    return (u * s) @ v, float(s.sum())


def shrink(x: np.ndarray, t: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0)


def within_norm(x: np.ndarray, most: float) -> np.ndarray:
    """The nearest matrix whose Frobenius norm is ``most`` at most."""
    n = np.linalg.norm(x)
    return x * (most / n) if n > most else x


def shrink_norm(x: np.ndarray, t: float) -> np.ndarray:
    """What is left of the matrix beyond a Frobenius norm of ``t``."""
    return x - within_norm(x, t)


#: Iterations between looks at the duality gap, and between new weights of the two steps.
LOOK, WEIGH = 10, 100


def split(d: np.ndarray, lam: float | None = None, mu: float | None = None, most: int = 5000, tol: float = 1e-8) -> dict:
    """L + S close to the observed cells of d (NaN: missing).

    Minimises the nuclear norm of L, plus lam times the absolute sum of S, plus
    mu times the Frobenius norm of the misfit M over observed cells; S is 0
    elsewhere.  As mu |M| is the largest <Y, M> over |Y| <= mu, this is a saddle
    point, solved by the primal-dual hybrid gradient method: Y follows the
    extrapolated misfit, L and S follow -Y.  A scaled Y with a spectral norm of
    1 and cells of lam at most bounds the optimum from below by -<Y, d>, so the
    gap certifies the result: ``converged`` means that the value is within
    ``tol`` of the least one, in proportion.  lam and mu default to 1 / sqrt(rows)
    and sqrt(columns / 2).
    """
    lam = 1 / np.sqrt(d.shape[0]) if lam is None else lam
    mu = np.sqrt(d.shape[1] / 2) if mu is None else mu
    seen = np.isfinite(d)
    d = np.where(seen, d, 0.0)
    low, sparse, y = np.zeros_like(d), np.zeros_like(d), np.zeros_like(d)
    ahead, mark = -d, (low, sparse, y)
    size = np.linalg.norm(d)
    # The product of both steps is under 1 / 2, the inverse square of the norm of (L, S) -> L + S.
    step, weight = 0.7, mu / size if size > 0 else 1.0
    value = gap = 0.0
    it = 0
    for it in range(1, most + 1):
        y = within_norm(y + step * weight * ahead, mu)
        before = low + sparse
        low, nuclear = shrink_singular(low - step / weight * y, step / weight)
        sparse = np.where(seen, shrink(sparse - step / weight * y, lam * step / weight), 0.0)
        ahead = np.where(seen, 2 * (low + sparse) - before - d, 0.0)
        if it % LOOK == 0 or it == most:
            value = nuclear + lam * np.abs(sparse).sum() + mu * np.linalg.norm(np.where(seen, low + sparse - d, 0.0))
            scale = max(1.0, np.linalg.norm(y, 2), np.abs(y).max(initial=0.0) / lam)
            gap = value + float((y * d).sum()) / scale
            if gap <= tol * max(1.0, value):
                break
        if it % WEIGH == 0:
            moved, pulled = np.hypot(np.linalg.norm(low - mark[0]), np.linalg.norm(sparse - mark[1])), np.linalg.norm(y - mark[2])
            if min(moved, pulled) > 1e-12:
                weight = float(np.sqrt(weight * pulled / moved))
            mark = (low, sparse, y)
    return {"L": low, "S": sparse, "iterations": it, "converged": bool(gap <= tol * max(1.0, value)), "value": float(value), "gap": float(gap)}


def split_matrices(cells: DataFrame, by: str, **settings) -> DataFrame:
    """``low`` and ``sparse`` of every cell of every matrix (columns by, i, j, v), and whether the matrix's split ``converged``; a task takes one matrix, of at most some thousand labels."""
    kind = {f.name: f.dataType.simpleString() for f in cells.schema.fields}

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="i", columns="j", values="v")
        out = split(wide.to_numpy(float), **settings)
        i, j = np.indices(wide.shape)
        return pd.DataFrame({by: key[0], "i": wide.index.to_numpy()[i.ravel()], "j": wide.columns.to_numpy()[j.ravel()], "low": out["L"].ravel(), "sparse": out["S"].ravel(), "converged": out["converged"]})

    return cells.select(by, "i", "j", "v").groupBy(by).applyInPandas(solve, f"{by} {kind[by]}, i {kind['i']}, j {kind['j']}, low double, sparse double, converged boolean")
