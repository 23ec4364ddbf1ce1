"""Comparison of Spark results with DuckDB results."""

import datetime
import decimal

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(repr(tuple(plain(r[n]) for n in names)) for r in table.to_pylist())


def against_sql(df, sql, folder):
    con = duckdb.connect()
    import os

    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    assert rows(df.toArrow()) == rows(con.sql(sql).to_arrow_table())
