import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TINY = "/root/testdata/sf0.001"


def oracle(sql, sf=TINY, **frames):
    """Rows of SQL over the test tables, with frames in place of some."""
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        elif os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return rows(dict(zip(names, r, strict=True)) for r in cur.fetchall())


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return round(x, 9) + 0.0
    return x if isinstance(x, (int, str)) else str(x)


def rows(dicts):
    return sorted((tuple((k, plain(v)) for k, v in sorted(d.items())) for d in dicts), key=repr)


def of(df):
    return rows(r.asDict() for r in df.collect())


def write(spark, folder, **tables):
    """Tables as an sf_dir."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
