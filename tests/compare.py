"""Rows of a Spark query and of its SQL, in one order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(tuple(repr(clean(r[k])) for k in order) for r in data)


def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def same(df, db, sql):
    found = db.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    a, b = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert a == b, ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3], len(a), len(b))
