"""Runs a query and its oracle SQL and compares the rows, without regard to order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, float):
        return f"{v:.6g}" if abs(v) > 1e-12 else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return str(v)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*names).collect())
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())
