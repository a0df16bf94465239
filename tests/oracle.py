"""Compare a query's rows with those of its SQL in DuckDB."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(v):
        if isinstance(v, (float, np.floating)):
            return None if np.isnan(v) else round(float(v), 5) + 0.0
        if isinstance(v, (np.integer, np.bool_)):
            return v.item()
        return None if v is None or v is pd.NaT or v is pd.NA else v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(value(v) for v in row) for row in frame.itertuples(index=False)), key=repr)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    got, want = df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, (int, float)) and abs(p - q) < 2e-5 for p, q in zip(x, y, strict=True)), (x, y)
