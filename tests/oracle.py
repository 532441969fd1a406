"""Runs a query and its SQL twin and compares their rows as multisets."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [rel.columns.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    have = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert have == want
