"""Rows of a Spark query and of its SQL, in a form that can be compared."""

import duckdb

from quire.session import TABLES


def _cell(v):
    if v is None:
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=str)


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    names = sorted(columns)
    return names, sorted((tuple(_cell(dict(zip(columns, r))[n]) for n in names) for r in got.fetchall()), key=str)
