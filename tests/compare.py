"""Comparing a Spark result with a DuckDB result, as sets of rows with columns by name."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = path + "/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _text(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, (list, np.ndarray)):
        return str([_text(x) for x in v])
    if isinstance(v, (float, np.floating, int, np.integer, bool, np.bool_)):
        v = float(v)
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    names = sorted(df.columns)
    for c in names:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
    return sorted(tuple(_text(v) for v in r) for r in df[names].itertuples(index=False))


def same(spark_df, sql: str, folder: str) -> None:
    got, want = spark_df.toPandas(), connect(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
