"""Projections over features, predictions and result lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .metrics import BINARY, MULTICLASS


def select_features(df: DataFrame, target: str, keys: Sequence[str] = (),
                    feature_columns: Sequence[str] | None = None) -> DataFrame:
    """Keys plus the named features, or every column but the target."""
    wanted = feature_columns or [c for c in df.columns if c != target and c not in keys]
    return df.select(*keys, *wanted)


def constant_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with at most one distinct non-missing value, found in one pass over min and max."""
    aggs = [F.min(c).eqNullSafe(F.max(c)).alias(c) for c in cols]
    flags = df.agg(*aggs).first().asDict()
    return [c for c in cols if flags[c]]


def drop_constant_columns(df: DataFrame, kinds: Mapping[str, bool]) -> tuple[DataFrame, dict[str, bool]]:
    """Drop constant feature columns; ``kinds`` (column -> is categorical) stays aligned."""
    gone = set(constant_columns(df, list(kinds)))
    return df.drop(*gone), {c: k for c, k in kinds.items() if c not in gone}


def column_spread(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, column, is_constant)``: the same test as a table, for many datasets in one pass."""
    wide = df.groupBy(*by).agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "is_constant")


def rename_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    if not mapping:
        return df
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.try_element_at(table, F.col(col)), F.col(col)))


def order_result_columns(df: DataFrame) -> DataFrame:
    """Columns whose name does not start with ``algorithm`` come first."""
    return df.select(*[c for c in df.columns if not c.startswith("algorithm")],
                     *[c for c in df.columns if c.startswith("algorithm")])


def positive_probability(proba: str = "proba") -> Column:
    return F.element_at(F.col(proba), 2)


def edge_label(value: str, edges: Sequence[float]) -> Column:
    """``<e0``, ``[e0,e1)``, …, ``>=en`` by half-open bins; a missing value stays missing."""
    x = F.col(value)
    out = F.when(x < edges[0], F.lit(f"<{edges[0]}"))
    for lo, hi in zip(edges, edges[1:]):
        out = out.when((x >= lo) & (x < hi), F.lit(f"[{lo},{hi})"))
    return out.when(x >= edges[-1], F.lit(f">={edges[-1]}"))


def classification_type(num_classes: str = "num_classes") -> Column:
    return F.when(F.col(num_classes) > 2, F.lit(MULTICLASS)).otherwise(F.lit(BINARY))


def flatten_params(df: DataFrame, keys: Sequence[str], params: str = "params", prefix: str = "algorithm_") -> DataFrame:
    """Known keys of a parameter map as columns; a run that lacks a key holds null there."""
    return df.select(*[c for c in df.columns if c != params],
                     *[F.try_element_at(F.col(params), F.lit(k)).alias(f"{prefix}{k}") for k in keys])
