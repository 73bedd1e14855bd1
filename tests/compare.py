"""Holds a query's rows against its SQL, as the driver does."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return v


def ordered(rows, names):
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in by) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    found = connect(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    got, expected = ordered(df.collect(), df.columns), ordered(found.fetchall(), names)
    assert len(got) == len(expected), (len(got), len(expected), got[:2], expected[:2])
    for a, b in zip(got, expected, strict=True):
        assert a == b, f"\n{a}\n{b}"
    return len(got)
