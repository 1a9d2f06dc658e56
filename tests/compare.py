"""Runs a query and its SQL over the same tables and compares the rows."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def both(spark, query, sql: str, sf_dir: str) -> tuple[list, list]:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    return ours, sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
