"""Sphere embedding of mixed tables.

Each categorical value is a point on the unit sphere, each numeric column an arc of a great circle; a row is the mean
of its columns' vectors. Points are derived from (seed, column, category), so there is no dictionary to ship, an
unseen category needs no state, and every run and partitioning gives the same vectors. The fitted state is the value
range of each numeric column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.hashing import gauss_column, unit_point
from ..staging import stage
from .aggregates import column_ranges

_CACHED_POINTS = 50_000


def great_circle(dim: int, seed, col: str) -> tuple[np.ndarray, np.ndarray]:
    """A column's point and its orthogonal direction: coordinates swapped pairwise, an odd last one left at zero."""
    point = unit_point(dim, seed, col, "axis")
    turn = np.zeros(dim)
    even = dim // 2 * 2
    turn[0:even:2], turn[1:even:2] = point[1:even:2], -point[0:even:2]
    size = math.sqrt(float((turn * turn).sum()))
    return point, turn / size if size else turn


def category_points(values: DataFrame, col: str, dim: int, seed=42, column_name: str | None = None,
                    out: str = "point") -> DataFrame:
    """``(col, point)`` for every distinct present category."""
    raw = values.select(col).filter(F.col(col).isNotNull()).distinct().withColumn(
        "_raw", gauss_column(dim, seed, column_name or col, F.col(col)))
    size = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("_size", size).select(col, F.transform("_raw", lambda x: x / F.col("_size")).alias(out))


def arc_angle(col: str, low, high) -> Column:
    """Position on the arc, from 0.1 pi at the train minimum to 0.9 pi at its maximum; not clipped outside."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.lit(math.pi) * (F.lit(0.8) * F.try_divide(F.col(col).cast("double") - lo, hi - lo) + F.lit(0.1))


def numeric_vector(col: str, dim: int, low, high, seed=42) -> Column:
    """A numeric column's vector as a JVM expression; missing values and constant columns give zeros."""
    point, turn = great_circle(dim, seed, col)
    a = arc_angle(col, low, high)
    parts = [F.sin(a) * F.lit(float(p)) + F.cos(a) * F.lit(float(t)) for p, t in zip(point, turn)]
    return F.when(a.isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(F.array(*parts))


@dataclass(frozen=True)
class SphereModel:
    """Fitted sphere embedding: value ranges per numeric column, names of the categorical ones.

    A model fitted per dataset holds its ranges as a staged table, one row per dataset, which joins the rows.
    """

    dim: int
    columns: tuple[str, ...]
    categorical: tuple[str, ...]
    ranges: dict = field(hash=False)
    seed: int = 42
    by: str | None = None
    spans: DataFrame | None = field(default=None, hash=False, compare=False)

    def _to_unit(self, df: DataFrame) -> DataFrame:
        """Numeric columns as places in their dataset's range, which is all the vectors depend on."""
        out = df.join(self.spans, self.by, "left")
        for c in self.columns:
            if c not in self.categorical:
                low, high = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
                out = out.withColumn(c, F.try_divide(F.col(c).cast("double") - low, high - low)).drop(f"_lo_{c}", f"_hi_{c}")
        return out

    def transform(self, df: DataFrame, out: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
        """Add the row embedding; ``keep`` limits the other columns that are carried along.

        One Arrow pass; without ``by`` no shuffle. Rows of a dataset the model has not seen have no numeric part.
        """
        lacking = [c for c in self.columns if c not in df.columns]
        if lacking:
            raise ValueError(f"fitted columns missing from the data: {', '.join(lacking)}")
        kept = [c for c in (df.columns if keep is None else keep) if c != out]
        numeric = [c for c in self.columns if c not in self.categorical]
        dim, seed, cat, ranges = self.dim, self.seed, [c for c in self.columns if c in self.categorical], self.ranges
        if self.spans is not None:
            ranges = {c: (0.0, 1.0) for c in numeric}
            originals = {c: f"_own_{c}" for c in numeric if c in kept}
            df = self._to_unit(df.withColumns({new: F.col(c) for c, new in originals.items()}))
        else:
            originals = {}
        axes = {c: great_circle(dim, seed, c) for c in numeric}
        width = len(self.columns)

        def embed(nums: np.ndarray, cats: list[pd.Series], points: dict) -> np.ndarray:
            total = np.zeros((len(nums), dim))
            for j, c in enumerate(numeric):
                lo, hi = ranges[c]
                with np.errstate(invalid="ignore", divide="ignore"):
                    a = math.pi * (0.8 * ((nums[:, j] - lo) / (np.float64(hi) - lo)) + 0.1)
                ok = np.isfinite(a)
                point, turn = axes[c]
                total[ok] += np.sin(a[ok])[:, None] * point + np.cos(a[ok])[:, None] * turn
            for c, values in zip(cat, cats):
                codes, found = pd.factorize(values)
                if len(found):
                    if len(points) > _CACHED_POINTS:
                        points.clear()
                    for v in found:
                        if (c, v) not in points:
                            points[(c, v)] = unit_point(dim, seed, c, v)
                    table = np.vstack([points[(c, v)] for v in found] + [np.zeros(dim)])
                    total += table[codes]
            return total / width

        points: dict = {}

        @pandas_udf("array<double>")
        def run(rows: pd.DataFrame) -> pd.Series:
            nums = np.column_stack([rows[f"n{j}"].to_numpy(dtype=float) for j in range(len(numeric))]) \
                if numeric else np.empty((len(rows), 0))
            return pd.Series(list(embed(nums, [rows[f"c{j}"] for j in range(len(cat))], points)))

        packed = [F.col(c).cast("double").alias(f"n{j}") for j, c in enumerate(numeric)]
        packed += [F.col(c).cast("string").alias(f"c{j}") for j, c in enumerate(cat)]
        return df.select(*[F.col(originals.get(c, c)).alias(c) for c in kept], run(F.struct(*packed)).alias(out))


def fit_sphere(df: DataFrame, columns: Sequence[str], categorical: Sequence[str] = (), dim: int = 64,
               seed: int = 42, by: str | None = None) -> SphereModel:
    """Value ranges of the numeric columns from one aggregation; per dataset when ``by`` is given."""
    numeric = [c for c in columns if c not in categorical]
    if by and numeric:
        spans = df.groupBy(by).agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in numeric
                                     for n, f in (("lo", F.min), ("hi", F.max))])
        return SphereModel(dim, tuple(columns), tuple(categorical), {}, seed, by, stage(spans, "spans"))
    ranges = {}
    if numeric:
        for r in column_ranges(df, numeric, []).collect():  # a row per column
            ranges[r["column"]] = tuple(np.nan if v is None else v for v in (r["min_value"], r["max_value"]))
    return SphereModel(dim, tuple(columns), tuple(categorical), ranges, seed)


def sphere_by_join(df: DataFrame, columns: Sequence[str], categorical: Sequence[str], by: str, dim: int = 64,
                   seed: int = 42, fit_on: DataFrame | None = None, out: str = "embedding") -> DataFrame:
    """Fit per dataset on ``fit_on``, or on all rows, and embed ``df``."""
    return fit_sphere(df if fit_on is None else fit_on, columns, categorical, dim, seed, by).transform(df, out)
