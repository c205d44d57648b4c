"""Compare a query's rows with DuckDB's, without regard to their order."""

import math
import os

import duckdb


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(normal(x) for x in v.values())
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def expected(sql, path):
    con = duckdb.connect()
    for f in os.listdir(path):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}/{f}'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(found.columns), sorted((tuple(normal(row[i]) for i in order) for row in found.fetchall()), key=repr)


def actual(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(normal(x) for x in row) for row in df.select(*columns).collect()), key=repr)
