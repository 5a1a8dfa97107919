"""A Spark result against DuckDB's on the same tables, rows in any order."""

import os

import duckdb
import numpy as np
import pandas as pd


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return format(float(v), ".9g") if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(_text(v) for v in row) for row in df.itertuples(index=False, name=None))


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con.sql(sql).df()


def same(spark_df, sql, sf_dir):
    got, want = spark_df.toPandas(), oracle(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
