"""Run a registered query and its SQL oracle side by side and compare the rows as multisets."""

from __future__ import annotations

import collections
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """Floats are compared to the last bit."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(r[i]) for i in order) for r in data), sorted(columns)


def differences(spark, con, query, sql, sf_dir):
    """(text, Spark rows): an empty text means equal columns, types and rows."""
    df = query(spark, sf_dir)
    got, got_columns = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    types = {c[0]: str(c[1]) for c in cursor.description}
    want, want_columns = rows(names, cursor.fetchall())
    total = sum(got.values())
    if got_columns != want_columns:
        return f"columns {got_columns} / {want_columns}", total
    alike = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(n, t, types[n]) for n, t in df.dtypes if alike.get(t) != types[n]]
    if got != want:
        only_spark, only_sql = got - want, want - got
        return (f"rows {total} / {sum(want.values())}; only Spark {sum(only_spark.values())}: {str(list(only_spark)[:2])[:600]}; "
                f"only SQL {sum(only_sql.values())}: {str(list(only_sql)[:2])[:600]}"), total
    return (f"types {odd}" if odd else ""), total
