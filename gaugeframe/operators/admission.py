"""Filters: which datasets, models, rows and result lines take part."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import as_double, has_bad_entry
from .metrics import BINARY, MULTICLASS, REGRESSION


def size_reasons(max_samples: int, max_features: int, samples: str = "num_samples",
                 features: str = "num_features") -> Column:
    """Every reason to skip a dataset, joined by `` | ``; empty when it is admitted. The bound itself is admitted."""
    n, d = F.col(samples), F.col(features)
    return F.concat_ws(
        " | ",
        F.when(n > max_samples, F.format_string(f"too many samples: %d > {max_samples}", n)),
        F.when(d > max_features, F.format_string(f"too many features: %d > {max_features}", d)),
    )


def admit_datasets(profile: DataFrame, max_samples: int, max_features: int, *, skip_missing: bool = False,
                   deny: Sequence | None = None, allow: Sequence | None = None,
                   dataset: str = "dataset") -> DataFrame:
    """The profile with a ``reason`` column; admitted datasets have an empty one."""
    reasons = [F.nullif(size_reasons(max_samples, max_features), F.lit(""))]
    if skip_missing:
        reasons.append(F.when(F.col("missing_values") > 0, F.lit("has missing values")))
    if deny is not None:
        reasons.append(F.when(F.col(dataset).isin(list(deny)), F.lit("excluded by name")))
    if allow is not None:
        reasons.append(F.when(~F.col(dataset).isin(list(allow)), F.lit("not in the subset")))
    return profile.withColumn("reason", F.concat_ws(" | ", *reasons))


def split_admitted(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


def model_fits(max_samples: str | Column, max_features: str | Column, samples: str = "num_samples",
               features: str = "num_features") -> Column:
    """A model takes a dataset up to and including its bounds; a missing bound does not limit."""
    top_n = F.col(max_samples) if isinstance(max_samples, str) else max_samples
    top_d = F.col(max_features) if isinstance(max_features, str) else max_features
    return F.coalesce(F.col(samples) <= top_n, F.lit(True)) & F.coalesce(F.col(features) <= top_d, F.lit(True))


def keep_listed(df: DataFrame, col: str, allowed: DataFrame | Sequence) -> DataFrame:
    if isinstance(allowed, DataFrame):
        return df.join(allowed, col, "left_semi")
    return df.filter(F.col(col).isin(list(allowed)))


def drop_listed(df: DataFrame, col: str, denied: DataFrame | Sequence) -> DataFrame:
    if isinstance(denied, DataFrame):
        return df.join(denied, col, "left_anti")
    return df.filter(~F.col(col).isin(list(denied)))


def embedding_report(df: DataFrame, vec: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows, smallest and largest length, rows with a null, NaN or infinite entry, and the verdict."""
    e = as_double(vec)
    res = df.groupBy(*by).agg(
        F.count("*").alias("num_rows"),
        F.min(F.size(e)).alias("min_dim"),
        F.max(F.size(e)).alias("max_dim"),
        F.count_if(F.coalesce(has_bad_entry(e), F.lit(True))).alias("bad_rows"),
    )
    return res.withColumn("valid", (F.col("min_dim") == F.col("max_dim")) & (F.col("bad_rows") == 0))


def require_valid_embeddings(df: DataFrame, vec: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """``df`` unchanged, or an error that names the first invalid groups. An empty frame is accepted."""
    bad = embedding_report(df, vec, by).filter("not valid").limit(5).collect()
    if bad:
        raise ValueError(f"invalid embeddings: {[r.asDict() for r in bad]}")
    return df


def split_by_task(results: DataFrame, task: str = "task") -> dict[str, DataFrame]:
    return {t: results.filter(F.col(task) == t) for t in (BINARY, MULTICLASS, REGRESSION)}


def equals_or_missing(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Keep rows whose parameter equals the wanted value or is missing; skipped unless all columns exist."""
    if not all(c in df.columns for c in wanted):
        return df
    for c, v in wanted.items():
        df = df.filter((F.col(c) == v) | F.col(c).isNull())
    return df


def require_finite(df: DataFrame, vec: str = "features", label: str | None = None) -> DataFrame:
    """``df`` unchanged, or an error when an input vector or label is missing, NaN or infinite."""
    bad = has_bad_entry(as_double(vec))
    checks = [F.count_if(F.coalesce(bad, F.lit(True))).alias("x")]
    if label:
        y = F.col(label).cast("double")
        checks.append(F.count_if(y.isNull() | F.isnan(y)).alias("y"))
    got = df.agg(*checks).first()
    if got["x"]:
        raise ValueError(f"{got['x']} rows hold NaN or infinite values in {vec}")
    if label and got["y"]:
        raise ValueError(f"{got['y']} rows hold no valid {label}")
    return df
