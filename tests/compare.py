"""Results of both engines in one comparable form."""

import decimal
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(sql, data=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(repr([plain(r[k]) for k in at]) for r in got.fetchall())
