"""Compares a query's rows with its SQL's, column by column, in any order."""

from __future__ import annotations

import glob
import os

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(table) -> list:
    import decimal
    import math

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else (int(v) if v == int(v) else round(v, 9))
        return int(v) if isinstance(v, decimal.Decimal) and v == int(v) else v

    names = sorted(table.column_names)
    return names, sorted((tuple(map(plain, r)) for r in zip(*(table.column(n).to_pylist() for n in names), strict=True)), key=repr)


def differ(spark_df, sql: str, sf_dir: str) -> str:
    import pyarrow as pa

    got = spark_df.toArrow()
    want = connection(sf_dir).execute(sql).to_arrow_table()
    assert isinstance(want, pa.Table)
    (a, x), (b, y) = rows(got), rows(want)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        only = [r for r in x if r not in set(y)][:3], [r for r in y if r not in set(x)][:3]
        return f"{len(x)} and {len(y)} rows; only here {only[0]}; only in SQL {only[1]}"[:900]
    return ""
