"""Reproducible samples without replacement: a hash of the keys, so the same rows whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime modulus, and odd multipliers for the first, second ... key.
MODULUS = 2_147_483_647
MULTIPLIERS = (48_271, 16_807, 69_621, 39_373, 30_269)


def hashed(keys: list[str], seed: int) -> Column:
    """A hash of up to five integer keys."""
    if len(keys) > len(MULTIPLIERS):
        raise ValueError(f"at most {len(MULTIPLIERS)} keys can be hashed, not {len(keys)}")
    out = F.lit(seed).cast("long")
    for k, m in zip(keys, MULTIPLIERS[: len(keys)], strict=True):
        out = out + F.col(k) * F.lit(m)
    return out % F.lit(MODULUS)


def exactly(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows, those of the least hashes (ties by key)."""
    return df.orderBy(hashed(keys, seed), *keys).limit(n)


def fraction(df: DataFrame, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """About that share of the rows; no shuffle."""
    return df.where(hashed(keys, seed) < F.lit(MODULUS * share))


def halves(df: DataFrame, keys: list[str], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A half chosen by hash, and its complement."""
    h = hashed(keys, seed)
    return df.where(h < MODULUS // 2), df.where(h >= MODULUS // 2)
