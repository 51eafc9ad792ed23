"""Compare a Spark query with its SQL in DuckDB, as multisets of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"[{','.join(map(_plain, v))}]" if isinstance(v, list | tuple) else str(v)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def check(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted("|".join(_plain(r[c]) for c in cols) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted("|".join(_plain(r[i]) for i in at) for r in result.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
