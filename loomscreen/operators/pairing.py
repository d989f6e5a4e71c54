"""All pairs of two tables in groups of bounded size, for steps that compare them in tasks' arrays."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that number the parts of both sides.
LEFT, RIGHT = "_left_part", "_right_part"
#: Tasks for each full group's number of pairs, so that groups seldom meet in a task; and the most tasks.
SPREAD, MOST_TASKS = 4, 20_000


def compared(left: DataFrame, right: DataFrame, by: list[str], left_rows: int, right_rows: int, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``compare`` of every part of ``left`` with every part of ``right`` that has the same ``by``.

    Rows of one ``by`` are dealt by a hash to parts of about so many rows, and a
    part is sent to each part of the other side, so neither a frequent ``by`` nor
    a large table makes a large group.  Both tables are read twice, and their
    rows should be distinct: equal ones fall into one part.
    """
    of = lambda df, n: df.groupBy(*by).agg(F.count("*").alias(n))
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = of(left, "_l").join(of(right, "_r"), by) if by else of(left, "_l").crossJoin(of(right, "_r"))
    full = (sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0) / (left_rows * right_rows)
    tasks = min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(SPREAD * full)), MOST_TASKS)
    sizes = sizes.where("_l > 0 and _r > 0").select(*by, parts("_l", left_rows).alias("_l"), parts("_r", right_rows).alias("_r"))
    keys = [*by, LEFT, RIGHT]

    def dealt(df: DataFrame, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        part = F.expr(f"cast(pmod(xxhash64({', '.join(f'`{c}`' for c in df.columns)}), {own}) as int)")
        rows = df.join(sizes, by) if by else df.crossJoin(F.broadcast(sizes))
        rows = rows.select(*df.columns, part.alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))
        return rows.repartition(tasks, *keys).groupBy(*keys)

    pairs = dealt(left, "_l", LEFT, "_r", RIGHT).cogroup(dealt(right, "_r", RIGHT, "_l", LEFT))
    return pairs.applyInPandas(compare, schema)
