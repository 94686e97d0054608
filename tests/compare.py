"""Rows of a Spark query against rows of its SQL in DuckDB."""

import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{sf_dir}/{f}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def rows_in_sql(con, sql):
    result = con.sql(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    return columns, sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
