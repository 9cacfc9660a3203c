"""Column expressions over vectors held as ``array<double>``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf


def as_double(vec) -> Column:
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def vector_literal(values) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v))


def squared_euclidean(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; a zero vector is at distance 1 from everything."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine}


def has_bad_entry(vec: Column) -> Column:
    """True when an element is null, NaN or infinite."""
    return F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def stack_vectors(series: Sequence) -> np.ndarray:
    """Rows of an Arrow-backed list column as a float64 matrix."""
    rows = list(series)
    if not rows:
        return np.empty((0, 0))
    if all(isinstance(r, np.ndarray) for r in rows) and len({len(r) for r in rows}) == 1:
        return np.concatenate(rows).astype(np.float64, copy=False).reshape(len(rows), len(rows[0]))
    return np.vstack([np.asarray(r, dtype=np.float64) for r in rows])


def map_vectors(df: DataFrame, vec: str, out: str, fn) -> DataFrame:
    """Replace a vector column by ``fn(matrix) -> matrix`` batch-wise; every other column passes through."""
    @pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.ascontiguousarray(fn(stack_vectors(v)))))

    return df.withColumn(out, apply(as_double(vec)))
