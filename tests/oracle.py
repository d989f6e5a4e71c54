"""Compare queries with their DuckDB oracles."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(x):
    if x is None or isinstance(x, (str, bool, int)):
        return x
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(c, sql):
    found = c.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


def ours(df):
    return rows_of(df.columns, df.collect())


def same(a, b):
    """Equal names and rows; numbers may differ in a last rounded digit."""
    if a == b:
        return ""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} of {len(a[1])} rows differ: {bad[:2]}"
