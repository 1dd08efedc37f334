"""Compare a query with its SQL in DuckDB, as sets of rows."""

import datetime
import glob
import os

import duckdb
import numpy as np
import pandas as pd


def canon(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(canon(x) for x in v)
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating)):
        return None if v != v else float(v)
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(frame, cols):
    return sorted((tuple(canon(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=repr)


def connect(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(df, sql, sf_dir):
    a, b = df.toPandas(), connect(sf_dir).execute(sql).fetch_df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert rows(a, cols) == rows(b, cols)
