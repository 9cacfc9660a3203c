"""Scaling and normalisation, fitted on train rows and applied to any rows.

Every fit is a bounded set of numbers per column, gathered by aggregation; every apply is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.hashing import gauss
from ..staging import stage
from .ranks import ONE_TASK_ROWS, exact_quantiles, quantile_arrays

NORMAL_IQR = 1.3489795003921634  # fixed value: inter-quartile range of the standard normal
WIDEST_SPAN = 2048.0  # exponents beyond it overflow doubles for all but constant columns
PROB_FLOOR = 1e-7  # fixed value: probabilities closer to 0 or 1 are clipped before the normal inverse


class _Affine:
    cols: tuple[str, ...]

    def expr(self, col: str) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expr(c) for c in self.cols})


@dataclass(frozen=True)
class Standard(_Affine):
    cols: tuple[str, ...]
    mean: dict
    scale: dict

    def expr(self, col):
        return (F.col(col).cast("double") - F.lit(self.mean[col])) / F.lit(self.scale[col])


def fit_standard(df: DataFrame, cols: Sequence[str]) -> Standard:
    """Mean and population deviation; a constant column is only centred."""
    aggs = [f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols)
            for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    got = df.agg(*aggs).first()
    return Standard(tuple(cols), {c: got[f"m{i}"] or 0.0 for i, c in enumerate(cols)},
                    {c: got[f"s{i}"] or 1.0 for i, c in enumerate(cols)})


def standardise_by_group(df: DataFrame, cols: Sequence[str], by: Sequence[str],
                         fit_on: DataFrame | None = None) -> DataFrame:
    """Standard scaling with per-dataset parameters.

    The parameter table is staged, so its real size decides between a broadcast and a shuffled join."""
    if not cols:
        return df
    source = df if fit_on is None else fit_on
    params = source.groupBy(*by).agg(*[x for c in cols for x in (
        F.avg(F.col(c).cast("double")).alias(f"_m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}"))])
    out = df.join(stage(params, "scale"), list(by))
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)))
    return out.drop(*[f"_{k}_{c}" for c in cols for k in "ms"])


def yeo_johnson(x: Column, lam: float | Column) -> Column:
    """The power transform for an exponent."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    two = F.lit(2.0) - lam
    right = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise(F.try_divide(F.pow(x + 1.0, lam) - 1.0, lam))
    left = F.when(F.abs(two) < 1e-12, -F.log1p(-x)).otherwise(-F.try_divide(F.pow(1.0 - x, two) - 1.0, two))
    return F.when(x >= 0, right).otherwise(left)


@dataclass(frozen=True)
class Power(_Affine):
    cols: tuple[str, ...]
    lam: dict
    mean: dict
    scale: dict

    def expr(self, col):
        y = yeo_johnson(F.col(col).cast("double"), self.lam[col])
        return (y - F.lit(self.mean[col])) / F.lit(self.scale[col])


def _yeo_johnson_logs(logs: np.ndarray, up: np.ndarray | bool, lam: float) -> np.ndarray:
    """Transform from ``logs`` = ln(1 + |x|), which every exponent shares."""
    def side(z, power):
        return z if abs(power) < 1e-12 else np.expm1(power * z) / power

    if up is True or up is False:
        return side(logs, lam) if up else -side(logs, 2.0 - lam)
    return np.where(up, side(logs, lam), -side(logs, 2.0 - lam))


def _yeo_johnson_values(x: np.ndarray, lam: float) -> np.ndarray:
    return _yeo_johnson_logs(np.log1p(np.abs(x)), x >= 0, lam)


def _power_moments(df: DataFrame, grid: dict, centre: dict) -> dict:
    """(column, grid index) -> (n, log-Jacobian sum, mean, variance) of the transformed values, in one pass.

    A task sums its own batches around a common centre and emits one row per column and exponent.
    """
    cols = list(grid)

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for i, c in enumerate(cols):
                x = pdf[f"x{i}"].to_numpy(dtype=float)
                x = x[np.isfinite(x)]
                if not len(x):
                    continue
                logs, up = np.log1p(np.abs(x)), x >= 0
                high, low = logs[up], logs[~up]
                jac = float(high.sum() - low.sum())
                for g, lam in enumerate(grid[c]):
                    base = _yeo_johnson_values(np.array([centre[c]]), float(lam))[0]
                    y = np.concatenate([_yeo_johnson_logs(high, True, float(lam)), _yeo_johnson_logs(low, False, float(lam))]) - base
                    add = np.array([len(x), jac, y.sum(), (y * y).sum()])
                    sums[(c, g)] = sums[(c, g)] + add if (c, g) in sums else add
        yield pd.DataFrame([(c, g, *v) for (c, g), v in sums.items()], columns=["column", "g", "n", "j", "s1", "s2"])

    slim = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    rows = slim.mapInPandas(run, "column string, g int, n double, j double, s1 double, s2 double")
    out = {}
    for r in rows.groupBy("column", "g").agg(*[F.sum(z).alias(z) for z in ("n", "j", "s1", "s2")]).collect():
        base = _yeo_johnson_values(np.array([centre[r["column"]]]), float(grid[r["column"]][r["g"]]))[0]
        shift = r["s1"] / r["n"]
        out[(r["column"], r["g"])] = (r["n"], r["j"], base + shift, max(0.0, r["s2"] / r["n"] - shift * shift))
    return out


def fit_power(df: DataFrame, cols: Sequence[str], low: float = -4.0, high: float = 4.0, points: int = 17,
              passes: int = 4) -> Power:
    """Yeo-Johnson exponent by maximum profile likelihood, then standardisation.

    A pass scores a grid of exponents for all columns and zooms in on the best cell; with the defaults the exponent is
    located to about 0.001. While the best exponent is the first or last of its grid, the span moves there and doubles
    instead; it ends where the transform overflows, which scores no better.
    """
    cols = list(cols)
    df = stage(df.select(*cols), "power")  # read once per pass
    got = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centre = {c: got[i] or 0.0 for i, c in enumerate(cols)}
    span = {c: (low, high) for c in cols}
    left = {c: passes for c in cols}
    while any(left.values()):
        grid = {c: np.linspace(*span[c], points) for c in cols}
        found = _power_moments(df, grid, centre)
        for c in cols:
            rows = [found[(c, g)] for g in range(points) if (c, g) in found]
            if not rows or not any(r[3] > 0 for r in rows):
                span[c], left[c] = (1.0, 1.0), 0
            if not left[c]:
                continue
            with np.errstate(divide="ignore"):
                fit = np.array([-0.5 * n * np.log(var) + (grid[c][g] - 1.0) * j for g, (n, j, _, var) in enumerate(rows)])
            best = int(np.argmax(np.where(np.isfinite(fit), fit, -np.inf)))
            step, size = grid[c][1] - grid[c][0], span[c][1] - span[c][0]
            if left[c] == passes and best in (0, points - 1) and size < WIDEST_SPAN:
                span[c] = (span[c][0] - size, span[c][1]) if best == 0 else (span[c][0], span[c][1] + size)
                continue
            span[c] = (grid[c][best] - step, grid[c][best] + step)
            left[c] -= 1
    lam = {c: float(sum(span[c]) / 2) for c in cols}
    last = _power_moments(df, {c: [v] for c, v in lam.items()}, centre)
    return Power(tuple(cols), lam, {c: last[(c, 0)][2] if (c, 0) in last else 0.0 for c in cols},
                 {c: (last[(c, 0)][3] ** 0.5 if (c, 0) in last else 0.0) or 1.0 for c in cols})


# fixed values: coefficients of the published algorithm AS 241 for the normal quantile, highest power first
_CENTRE = ((2.50908092873012267e3, 3.34305755835881281e4, 6.72657709270087009e4, 4.59219539315498715e4,
            1.37316937655094611e4, 1.97159095030655144e3, 1.33141667891784377e2, 3.38713287279636661),
           (5.22649527885285457e3, 2.87290857357219427e4, 3.93078958000927106e4, 2.12137943015865959e4,
            5.39419602142475111e3, 6.87187007492057908e2, 4.23133307016009113e1, 1.0))
_MIDDLE = ((7.74545014278341408e-4, 2.27238449892691845e-2, 2.41780725177450612e-1, 1.27045825245236838,
            3.64784832476320460, 5.76949722146069141, 4.63033784615654530, 1.42343711074968358),
           (1.05075007164441684e-9, 5.47593808499534495e-4, 1.51986665636164572e-2, 1.48103976427480075e-1,
            6.89767334985100005e-1, 1.67638483018380385, 2.05319162663775882, 1.0))
_TAIL = ((2.01033439929228813e-7, 2.71155556874348758e-5, 1.24266094738807844e-3, 2.65321895265761230e-2,
          2.96560571828504891e-1, 1.78482653991729133, 5.46378491116411437, 6.65790464350110378),
         (2.04426310338993979e-15, 1.42151175831644589e-7, 1.84631831751005468e-5, 7.86869131145613259e-4,
          1.48753612908506149e-2, 1.36929880922735805e-1, 5.99832206555887938e-1, 1.0))


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution function, over whole arrays."""
    p = np.clip(p, PROB_FLOOR, 1.0 - PROB_FLOOR)
    q = p - 0.5
    ratio = lambda c, r: np.polyval(c[0], r) / np.polyval(c[1], r)
    far = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    outer = np.sign(q) * np.where(far <= 5.0, ratio(_MIDDLE, far - 1.6), ratio(_TAIL, far - 5.0))
    return np.where(np.abs(q) <= 0.425, q * ratio(_CENTRE, 0.180625 - q * q), outer)


@dataclass(frozen=True)
class QuantileNormal(_Affine):
    cols: tuple[str, ...]
    landmarks: dict

    def expr(self, col):
        marks = np.asarray(self.landmarks[col], dtype=float)
        share = np.linspace(0.0, 1.0, len(marks))

        @pandas_udf("double")
        def to_normal(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            ok = ~np.isnan(v)
            up = np.interp(v[ok], marks, share)
            down = -np.interp(-v[ok], -marks[::-1], -share[::-1])
            out = np.full(len(v), np.nan)
            p = 0.5 * (up + down)
            p = np.where(v[ok] <= marks[0], 0.0, np.where(v[ok] >= marks[-1], 1.0, p))
            out[ok] = normal_quantile(p)
            return pd.Series(out)

        return F.nanvl(to_normal(F.col(col).cast("double")), F.lit(None).cast("double"))


def fit_quantile_normal(df: DataFrame, cols: Sequence[str], landmarks: int = 1000,
                        one_task_rows: int = ONE_TASK_ROWS) -> QuantileNormal:
    """Exact empirical quantiles at evenly spaced probabilities; the transform interpolates between them."""
    landmarks = int(max(2, min(landmarks, df.count())))
    probs = [float(p) for p in np.linspace(0.0, 1.0, landmarks)]
    got = {r["column"]: r["q"] for r in quantile_arrays(df, cols, probs, one_task_rows=one_task_rows).collect()}
    return QuantileNormal(tuple(cols), {c: tuple(np.maximum.accumulate(got[c])) for c in cols})


@dataclass(frozen=True)
class Chain(_Affine):
    steps: tuple

    def apply(self, df):
        for s in self.steps:
            df = s.apply(df)
        return df


def fit_smoothed_quantile(df: DataFrame, cols: Sequence[str], row_id: str, seed: int = 42, noise: float = 1e-3,
                          landmarks: int = 1000) -> Chain:
    """Quantile map fitted on values jittered by keyed noise, which spreads heavy ties; then standard scaling."""
    spread = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
                    F.count("*").alias("n")).first()
    jittered = df.select(*[(F.col(c).cast("double") + gauss(seed, F.col(row_id), c) *
                            F.lit(noise / max(spread[f"s{i}"] or 0.0, noise))).alias(c) for i, c in enumerate(cols)])
    marks = max(min(spread["n"] // 30, landmarks), 10)
    first = fit_quantile_normal(jittered, cols, marks)
    return Chain((first, fit_standard(first.apply(df), cols)))


@dataclass(frozen=True)
class Robust(_Affine):
    cols: tuple[str, ...]
    median: dict
    scale: dict

    def expr(self, col):
        return (F.col(col).cast("double") - F.lit(self.median[col])) / F.lit(self.scale[col])


def fit_robust(df: DataFrame, cols: Sequence[str], one_task_rows: int = ONE_TASK_ROWS) -> Robust:
    """Median and inter-quartile range in units of the normal's; exact quantiles."""
    rows = {r["column"]: r for r in exact_quantiles(df, cols, (0.25, 0.5, 0.75), one_task_rows=one_task_rows).collect()}
    iqr = {c: rows[c]["q2"] - rows[c]["q0"] for c in cols}
    return Robust(tuple(cols), {c: rows[c]["q1"] for c in cols}, {c: (iqr[c] / NORMAL_IQR) or 1.0 for c in cols})


@dataclass(frozen=True)
class Clip(_Affine):
    cols: tuple[str, ...]
    low: dict
    high: dict

    def expr(self, col):
        return F.greatest(F.least(F.col(col).cast("double"), F.lit(self.high[col])), F.lit(self.low[col]))


def fit_clip(df: DataFrame, cols: Sequence[str]) -> Clip:
    got = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols)
                   for n, f in (("l", F.min), ("h", F.max))]).first()
    return Clip(tuple(cols), {c: got[f"l{i}"] for i, c in enumerate(cols)}, {c: got[f"h{i}"] for i, c in enumerate(cols)})


def fit_outlier_scaling(df: DataFrame, cols: Sequence[str], method: str = "power", row_id: str | None = None,
                        seed: int = 42, clip: bool = False) -> Chain:
    """Standard scaling, then the chosen normaliser; with ``clip`` rows outside the train range are pulled in first."""
    first = fit_standard(df, cols)
    scaled = first.apply(df)
    steps: list = [first]
    if clip:
        steps.append(fit_clip(scaled, cols))
    if method == "power":
        steps.append(fit_power(scaled, cols))
    elif method == "quantile":
        steps.append(fit_quantile_normal(scaled, cols))
    elif method == "quantile_rtdl":
        if row_id is None:
            raise ValueError("quantile_rtdl needs a row_id column to key its noise")
        steps.append(fit_smoothed_quantile(scaled, cols, row_id, seed))
    elif method == "robust":
        steps.append(fit_robust(scaled, cols))
    elif method != "none":
        raise ValueError(f"no such normaliser: {method}")
    return Chain(tuple(steps))
