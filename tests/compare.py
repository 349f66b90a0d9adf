"""Run registered queries next to their SQL twins and compare all rows."""

import math
import os
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (int, bool)) or x is None:
        return str(x)
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, db, query, sql, sf_dir):
    began = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    other = rows_of(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} / {names}", took
    if mine != other:
        here, there = set(mine), set(other)
        a, b = [x for x in mine if x not in there][:2], [x for x in other if x not in here][:2]
        return f"{len(mine)} / {len(other)} rows; {sorted(names)} mine {a} other {b}", took
    return "", took
