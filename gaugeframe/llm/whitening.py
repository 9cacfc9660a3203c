"""Whitened leading components of vectors, their eigenvalues found by slicing the spectrum.

The covariance is summed on Spark. How many eigenvalues of a symmetric matrix exceed a number is told by the signs of the
pivots of an LDL' factorisation of the matrix less that number times the identity (Sylvester's law of inertia). Halving
intervals by such counts isolates each leading eigenvalue; Rayleigh quotient iteration then converges on it cubically, and two
counts beside the result certify that it is the one of that number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import stage
from .grids import common_width, matrix, on_grid, summed

SCALE, COMPONENTS = 256, 4
LIMIT = 1 << 31  # grid integers beyond this count as this
_PIVOT = (1 + math.sqrt(17)) / 8  # fixed value: bounds the growth of symmetric pivoting
EPS = float(np.finfo(float).eps)


def negative_count(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix: negative pivots of its LDL' with one- and two-rowed pivots."""
    a, n, k, found = a.copy(), len(a), 0, 0
    while k < n:
        below = np.abs(a[k + 1:, k])
        r = k + 1 + int(below.argmax()) if len(below) else k
        most, here, two = (below.max() if len(below) else 0.0), abs(a[k, k]), False
        if here < _PIVOT * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            wide = row.max()
            if here * wide < _PIVOT * most * most:
                two = abs(a[r, r]) < _PIVOT * wide
                to = k + 1 if two else k
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if two:
            block, rest = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            found += 1  # a two-rowed pivot is indefinite
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            pivot, rest = a[k, k], a[k + 1:, k].copy()
            found += bool(pivot < 0)
            if pivot:
                a[k + 1:, k + 1:] -= np.outer(rest, rest / pivot)
            k += 1
    return found


class Spectrum:
    """Leading eigenpairs of a symmetric positive semidefinite matrix."""

    def __init__(self, a: np.ndarray):
        self.a = (a + a.T) / 2
        self.size = float(np.abs(self.a).sum(axis=1).max()) if len(a) else 0.0  # no eigenvalue is greater
        self.noise = 4 * EPS * self.size * max(1, len(a))
        self.counts: dict[float, int] = {}

    def above(self, cut: float) -> int:
        """How many eigenvalues exceed ``cut``."""
        if cut not in self.counts:
            self.counts[cut] = len(self.a) - negative_count(self.a - cut * np.eye(len(self.a)))
        return self.counts[cut]

    def bracket(self, number: int, low: float, high: float) -> tuple[float, float]:
        """A half of an interval that holds eigenvalue ``number``."""
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= number else (low, middle)

    def certified(self, number: int, value: float) -> bool:
        """Whether eigenvalue ``number``, counted from the greatest, is ``value`` up to rounding."""
        return self.above(value - 2 * self.noise) >= number > self.above(value + 2 * self.noise)

    def _refine(self, low: float, high: float, known: list[np.ndarray], start: np.ndarray) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from the middle of the interval, apart from the vectors already known."""
        n, shift, v = len(self.a), (low + high) / 2, start
        best = (math.inf, shift, v)
        for turn in range(40):
            try:
                w = np.linalg.solve(self.a - shift * np.eye(n), v)
            except np.linalg.LinAlgError:
                w = np.linalg.solve(self.a - (shift + self.noise * (1 + turn / 7)) * np.eye(n), v)
            w /= np.abs(w).max()
            for _ in range(2):
                for u in known:
                    w = w - (u @ w) * u
            v = w / np.linalg.norm(w)
            value = float(v @ self.a @ v)
            left = float(np.linalg.norm(self.a @ v - value * v))
            if left < best[0]:
                best = (left, value, v)
            elif turn > 4:
                break
            if left <= EPS * self.size:
                break
            if low <= value <= high and turn:
                shift = value
        return best[1], best[2]

    def leading(self, many: int) -> list[tuple[float, np.ndarray]]:
        """The ``many`` greatest eigenvalues with unit eigenvectors; zero ones, up to rounding, are left out."""
        found: list[tuple[float, np.ndarray]] = []
        draw = np.random.default_rng(0)
        for number in range(1, min(many, len(self.a)) + 1 if self.size else 1):
            low, high = self.noise, self.size * (1 + 4 * EPS) + self.noise
            if self.above(low) < number:
                break
            low = max([low, *[c for c, n in self.counts.items() if n >= number]])
            high = min([high, *[c for c, n in self.counts.items() if n < number and c > low]])
            start = draw.standard_normal(len(self.a))
            while True:
                alone = self.above(low) == number and self.above(high) == number - 1
                tight = high - low <= self.noise
                if tight or (alone and high - low <= 0.05 * (abs(low) + abs(high))):
                    value, vector = self._refine(low, high, [v for _, v in found], start)
                    if tight or (low - self.noise <= value <= high + self.noise and self.certified(number, value)):
                        break
                low, high = self.bracket(number, low, high)
            vector = vector * (1.0 if vector[np.abs(vector).argmax()] > 0 else -1.0)
            found.append((value, vector))
        return found


def fit_spectrum(points: DataFrame, components: int = COMPONENTS) -> dict | None:
    """Count, sums, eigenvalues, eigenvectors and the shares of the trace, of staged distinct grid rows ``(x)``; None without rows.

    Also ``identity_error``: the largest entry by which the covariance of the whitened rows differs from the identity.
    """
    exact = summed(points, lambda c: np.concatenate([[len(c[0])], matrix(c[0]).sum(axis=0)]), np.int64)
    if exact is None:
        return None
    n, sums = int(exact[0]), exact[1:]
    mean, width = sums / n, len(sums)

    def products(columns):
        y = matrix(columns[0]) - mean
        return (y.T @ y).ravel()

    cov = summed(points, products).reshape(width, width) / n
    pairs = Spectrum(cov).leading(components)
    values, axes = np.array([e for e, _ in pairs]), np.array([v for _, v in pairs]).reshape(len(pairs), width).T
    worst = 0.0
    if len(pairs):
        turn = axes / np.sqrt(values)
        centre = summed(points, lambda c: ((matrix(c[0]) - mean) @ turn).sum(axis=0)) / n

        def spread(columns):
            z = (matrix(columns[0]) - mean) @ turn - centre
            return (z.T @ z).ravel()

        worst = float(np.abs(summed(points, spread).reshape(len(pairs), -1) / n - np.eye(len(pairs))).max())
    return {"n": n, "sums": sums, "values": values, "axes": axes, "shares": values / np.trace(cov) if len(pairs) else values,
            "identity_error": worst}


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum over the dimensions of ``(n * x - sums) ** 2``; None where it does not fit a long."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        apart = n * x - sums
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - sums.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def whiten(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)``: a row per vector and leading component.

    Vectors that are null, empty or hold null or non-finite components are left out, as are those of another length than most (of
    equally frequent lengths the greatest counts). Equal grid vectors count once in the fit; every row is whitened, repeated
    keys and rows too. Components without variance (all from the number of distinct vectors on) have no rows, so one
    distinct vector gives none. Equal eigenvalues get orthogonal vectors of their common space. Other columns are ignored.
    """
    rows = stage(on_grid(vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vec}`").alias("vec")), "vec", ["key"], SCALE, LIMIT), "grid")
    rows = rows.filter(F.size("x") == common_width(rows))
    fit = fit_spectrum(stage(rows.select("x").distinct(), "fit-list"), components)
    shape = T.StructType([rows.schema["key"], *[T.StructField(name, kind) for name, kind in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))]])
    kind = to_arrow_type(shape["key"].dataType)

    def work(batches):
        many = len(fit["values"]) if fit else 0
        for batch in batches if many else []:
            x = matrix(batch.column(1))
            z = (x - fit["sums"] / fit["n"]) @ fit["axes"] / np.sqrt(fit["values"])
            each = np.repeat(np.arange(len(x)), many)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(kind).take(pa.array(each)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), fit["n"])), pa.array(deviations(x, fit["n"], fit["sums"]), pa.int64()).take(pa.array(each)),
                pa.array(z.ravel()), pa.array(np.tile(fit["shares"], len(x))), pa.array(np.full(len(each), fit["identity_error"]))],
                names=shape.names)

    return rows.select("key", "x").mapInArrow(work, shape).withColumnRenamed("key", key)
