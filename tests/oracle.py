"""Compares a Spark result with DuckDB's result of the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.12g}")
    return x


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle_rows(con, sql):
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    names = sorted(cols)
    at = [cols.index(n) for n in names]
    return names, sorted((tuple(_cell(r[i]) for i in at) for r in got.fetchall()), key=repr)
