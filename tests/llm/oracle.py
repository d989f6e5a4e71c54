"""Compare a query with its DuckDB oracle."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, sf_dir: str) -> list[tuple]:
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        found = c.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return [sorted(names), sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)]


def ours(df) -> list[tuple]:
    names = sorted(df.columns)
    return [names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)]
