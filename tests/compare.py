"""Rows of a query against rows of its SQL, as multisets."""

import math
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con, sql):
    """Columns or rows that differ, at most a few; empty if all is the same."""
    got = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(df.columns), sorted(names))]
    a, b = rows(df.columns, got), rows(names, cur.fetchall())
    return [("only here", x) for x in list((a - b).items())[:3]] + [("only there", x) for x in list((b - a).items())[:3]]
