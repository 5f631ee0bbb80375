"""Compare a Spark result with DuckDB's, whatever the order of rows and columns."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def value(v):
    if v is None or pd.isna(v):
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(value, r))) for r in frame.astype(object).itertuples(index=False))
