"""Query results next to DuckDB's."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def same(df, con, sql: str) -> None:
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert names == sorted(columns)
    wanted = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert found == wanted
