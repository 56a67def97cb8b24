"""Compares queries with their SQL: rows as multisets, columns by name, doubles within a small tolerance."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet' if_dir)".replace("' if_dir", "'") if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    assert glob.glob(f"{sf_dir}/*")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}".replace("-0.00000", "0.00000")
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def difference(spark, con, sf_dir, query, sql):
    """None if they agree, else what differs."""
    got = query(spark, sf_dir)
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    for x, y in zip(a, b):
        if x != y and not all(p == q or _near(p, q) for p, q in zip(x, y)):
            return f"{x} and {y}"
    return None


def _near(p, q):
    try:
        return abs(float(p) - float(q)) <= 2e-5 * max(1, abs(float(p)))
    except ValueError:
        return False
