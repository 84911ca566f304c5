"""Spark's and DuckDB's answers to a query, as sorted rows with columns by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([plain(row[i]) for i in order] for row in r.fetchall())


def sparked(df):
    names = sorted(df.columns)
    return names, sorted([plain(row[n]) for n in names] for row in df.collect())
