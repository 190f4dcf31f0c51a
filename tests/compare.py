"""Rows of a Spark query and of its SQL in DuckDB on the same tables, in one comparable form."""

import datetime
import decimal
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def form(v):
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def both(spark, query, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    df = query(spark, sf_dir)
    order = sorted(names)
    assert sorted(df.columns) == order, (df.columns, names)
    want = Counter(tuple(form(row[names.index(c)]) for c in order) for row in cursor.fetchall())
    got = Counter(tuple(form(row[c]) for c in order) for row in df.collect())
    return got, want
