"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "None" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return repr(float(v) + 0.0) if isinstance(v, int) else str(v)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def both(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    out = connect(sf_dir).sql(sql)
    names = list(out.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return got, sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())
