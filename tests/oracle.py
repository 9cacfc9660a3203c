"""Compare a query with its SQL twin the way the driver does: sorted columns, order-insensitive rows."""

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _sorted(p: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(p.columns):
        if pd.api.types.is_numeric_dtype(p[c]) and not pd.api.types.is_bool_dtype(p[c]):
            out[c] = p[c].astype(float).fillna(-1e300) + 0.0
        else:
            out[c] = p[c].astype(object).map(lambda v: "~" if v is None or v is pd.NA or v != v else str(v))
    return pd.DataFrame(out).sort_values(sorted(p.columns), kind="stable").reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame, tol: float = 2e-6) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = _sorted(got), _sorted(want)
    for c in a.columns:
        if a[c].dtype == object:
            assert (a[c] == b[c]).all(), c
        else:
            assert np.allclose(a[c], b[c], rtol=0, atol=tol), c
