"""Compare a query's rows with those of its SQL in another engine."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows_of_sql(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def same(df, sql, folder):
    names, want = rows_of_sql(sql, folder)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(plain(r[n]) for n in sorted(names)) for r in df.collect()]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [tuple(plain(r[i]) for i in order) for r in want]
    assert sorted(got) == sorted(want)
