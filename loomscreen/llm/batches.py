"""Helpers for Arrow batches of texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of rows that Spark sends to a worker at once.
BATCH_BYTES = "2m"
#: Bytes of text that a worker handles at once; a longer text is handled alone.
PART_BYTES = 1 << 20


def tidied(run: Callable) -> Callable:
    """``run``, after which a worker gives its free memory back: workers outlive tasks, and the next one may need little."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def arrow(run: Callable, schema: str | StructType, size: str = BATCH_BYTES) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: mapInArrow in batches of bounded bytes, whatever the rows' length."""

    def apply(df: DataFrame) -> DataFrame:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
        return df.mapInArrow(tidied(run), schema)

    return apply


def texts(batches: Iterator[pa.RecordBatch], column: int, most: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches of about ``most`` bytes of text, with the UTF-8 bytes of each."""
    for batch in batches:
        column_of = batch.column(column).cast(pa.large_binary())
        at, total = 0, 0
        for i, n in enumerate(pc.binary_length(column_of).to_pylist()):
            n = n or 0
            if total and total + n > most:
                yield batch.slice(at, i - at), column_of.slice(at, i - at).to_pylist()
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at), column_of.slice(at).to_pylist()


def uniform(*cols: Column) -> Column:
    """A hash of the columns between 0 and 1."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def stratified(df: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, all if there are fewer; never over 1.5 times as many in all.

    The choice is by a hash of ``key``, so it doesn't depend on the partitions.
    """
    counts = {r[0]: r[1] for r in df.where(df[label].isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return df.limit(0)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n))))
    u = uniform(F.col(key), F.lit(7))
    return df.where(u < F.coalesce(share[F.col(label)], F.lit(0.0))).orderBy(u, key).limit(per_label * len(counts) * 3 // 2)


def spread(lengths: np.ndarray) -> np.ndarray:
    """Offsets of parts of these lengths: one more entry than parts."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
