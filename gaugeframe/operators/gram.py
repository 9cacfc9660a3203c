"""Spectrum of a tall matrix of row vectors through its d x d Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.hashing import gauss_matrix
from ..functions.vectors import as_double, map_vectors, stack_vectors
from ..staging import stage
from .knn import _group_iter
from .many_models import _summed

_HELD_BYTES = 256 * 1024 * 1024
_FAN_IN = 16
WIDEST = 8192  # values of a vector whose whole Gram matrix one task adds up
TILE_BYTES = 32 << 20


def gram_matrices(df: DataFrame, vec: str = "embedding", by: Sequence[str] = (), max_dim: int = 8192) -> DataFrame:
    """``(*by, n, dim, gram)``: row count and packed sum of outer products per group.

    Every task sums its own rows; the partial matrices are then added in two bounded steps, so a group of any size is
    spread over all tasks and no task holds more than a few matrices at a time. ``max_dim`` is the caller's bound on one
    such matrix (8 bytes times its square); longer vectors are an error.
    """
    by = list(by)
    schema = T.StructType([df.schema[c] for c in by] + [
        T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("dim", T.IntegerType()), T.StructField("gram", T.BinaryType())])

    def adder(read, final_bucket):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tag = TaskContext.get().partitionId() % _FAN_IN if final_bucket else 0
            held: dict = {}
            size = 0

            def flush():
                rows = [dict(zip(by, key), bucket=tag, n=n, dim=len(g), gram=g.tobytes()) for key, (n, g) in held.items()]
                held.clear()
                return pd.DataFrame(rows, columns=schema.names)

            for pdf in batches:
                for key, part in _group_iter(pdf, by):
                    n, g = read(part)
                    if g.shape[0] > max_dim:
                        raise ValueError(f"vectors of {g.shape[0]} values exceed max_dim={max_dim}")
                    if key in held:
                        held[key] = (held[key][0] + n, held[key][1] + g)
                    else:
                        held[key] = (n, g)
                        size += g.nbytes
                    if size > _HELD_BYTES:
                        yield flush()
                        size = 0
            if held:
                yield flush()
        return run

    def from_rows(part):
        m = stack_vectors(part["_v"])
        return len(m), m.T @ m

    def from_partials(part):
        d = int(part["dim"].iloc[0])
        total = np.zeros((d, d))
        for g in part["gram"]:
            total += np.frombuffer(g, dtype=np.float64).reshape(d, d)
        return int(part["n"].sum()), total

    rows = df.select(*by, as_double(vec).alias("_v"))
    partial = rows.mapInPandas(adder(from_rows, True), schema)
    merged = partial.repartition(*by, "bucket").mapInPandas(adder(from_partials, False), schema)
    whole = merged.repartition(*by) if by else merged.repartition(1)
    return whole.mapInPandas(adder(from_partials, False), schema).drop("bucket")


def wide_singular_values(rows: DataFrame, vec: str, tile_bytes: int = TILE_BYTES, seed: int = 42) -> tuple[int, int, np.ndarray]:
    """Number of staged rows, their length and their min(n, d) singular values, without a d x d matrix.

    The space the rows span is found a tile of random directions at a time: a pass multiplies the tile with the Gram matrix, row by
    row, what it adds to the space so far is made orthonormal, and a second pass gives the Gram matrix in the new
    coordinates. That ends when the coordinates hold the whole trace; all further values are zero. Every sum is one tile of d x
    ``tile_bytes / 8 d`` numbers, and there are as many tiles as the rank of the rows asks for.
    """
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    n, d = facts["n"], facts["d"]
    total = float(_summed(rows, lambda pdf: np.array([(stack_vectors(pdf[vec]) ** 2).sum()]))[0])
    most, width = min(n, d), max(1, min(min(n, d), tile_bytes // (8 * d)))
    basis, inside = np.zeros((d, 0)), np.zeros((0, 0))
    context = rows.sparkSession.sparkContext

    def times_gram(tile: np.ndarray) -> np.ndarray:
        sent = context.broadcast(tile)

        def read(pdf):
            x = stack_vectors(pdf[vec])
            return (x.T @ (x @ sent.value)).ravel()

        out = _summed(rows, read).reshape(tile.shape)
        sent.unpersist()
        return out

    while basis.shape[1] < most and total - np.trace(inside) > 1e-13 * total:
        new = times_gram(gauss_matrix(d, min(width, most - basis.shape[1]), "range", seed, basis.shape[1]))
        size = np.linalg.norm(new)
        for _ in range(2):
            new -= basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        q = q[:, np.abs(np.diag(r)) > 1e-14 * max(size, 1e-300)]
        q -= basis @ (basis.T @ q)
        q, _ = np.linalg.qr(q)
        if not q.shape[1]:
            break
        image = times_gram(q)
        cross, own = basis.T @ image, q.T @ image
        inside = np.block([[inside, cross], [cross.T, own]])
        basis = np.hstack([basis, q])
    lam = np.linalg.eigvalsh((inside + inside.T) / 2)[::-1] if len(inside) else np.zeros(0)
    sigma = np.zeros(most)
    sigma[: len(lam)] = np.sqrt(np.maximum(lam, 0.0))
    return n, d, sigma


def singular_values(df: DataFrame, vec: str = "embedding", by: Sequence[str] = (), widest: int = WIDEST) -> DataFrame:
    """``(*by, n, dim, sigma)``: the min(n, d) singular values of the uncentred matrix, largest first.

    Vectors longer than ``widest`` go through :func:`wide_singular_values`, one group after the other.
    """
    by = list(by)
    if (df.agg(F.max(F.size(vec))).first()[0] or 0) > widest:
        rows, out = stage(df.select(*by, as_double(vec).alias("_v")), "wide-vectors"), []
        for key in rows.select(*by).distinct().collect() if by else [()]:
            part = reduce(lambda part, c: part.filter(F.col(c[0]).eqNullSafe(F.lit(c[1]))), zip(by, key), rows)
            n, d, sigma = wide_singular_values(part, "_v")
            out.append((*key, n, d, sigma.tolist()))
        fields = [T.StructField("n", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("sigma", T.ArrayType(T.DoubleType()))]
        return df.sparkSession.createDataFrame(out, T.StructType([df.schema[c] for c in by] + fields))
    grams = gram_matrices(df, vec, by)
    schema = T.StructType([df.schema[c] for c in by] + [
        T.StructField("n", T.LongType()), T.StructField("dim", T.IntegerType()),
        T.StructField("sigma", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                d = int(row["dim"])
                lam = np.linalg.eigvalsh(np.frombuffer(row["gram"], dtype=np.float64).reshape(d, d))[::-1]
                out.append({**{c: row[c] for c in by}, "n": row["n"], "dim": d,
                            "sigma": np.sqrt(np.maximum(lam, 0.0))[:min(int(row["n"]), d)]})
            yield pd.DataFrame(out, columns=schema.names)

    return grams.mapInPandas(run, schema)


def rank_me(df: DataFrame, vec: str = "embedding", by: Sequence[str] = (), epsilon: float = 1e-7) -> DataFrame:
    """Smooth rank: exp of the entropy of the normalised singular values, epsilon added after the division."""
    spectrum = singular_values(df, vec, by)
    total = F.aggregate("sigma", F.lit(0.0), lambda a, s: a + s)
    p = F.transform("sigma", lambda s: s / F.col("_total") + F.lit(epsilon))
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.ln(x))
    return spectrum.withColumn("_total", total).select(*by, F.exp(entropy).alias("rank_me"))


def alpha_req(df: DataFrame, vec: str = "embedding", by: Sequence[str] = (), epsilon: float = 1e-7) -> DataFrame:
    """Decay of the eigenspectrum: minus the slope of ln(eigenvalue) on ln(rank); an error below two eigenvalues."""
    lam = F.filter(F.transform("sigma", lambda s: s * s / F.col("n")), lambda x: x > epsilon)
    values = singular_values(df, vec, by).select(*by, F.posexplode_outer(lam).alias("i", "lam"))
    fit = values.groupBy(*by).agg(F.count("lam").alias("_k"), F.regr_slope(F.ln("lam"), F.ln(F.col("i") + 1)).alias("_s"))
    message = F.lit("alpha-ReQ needs two eigenvalues above epsilon")
    return fit.select(*by, F.when(F.col("_k") < 2, F.raise_error(message).cast("double"))
                      .otherwise(-F.col("_s")).alias("alpha_req"))


class ColumnPredictors:
    """Linear prediction of every column from all others, from one pass over the rows.

    The ridge precision matrix P holds all d regressions at once: column j is predicted with weights -P[j,k]/P[j,j].
    """

    def __init__(self, df: DataFrame, vec: str = "features", ridge: float = 1e-6):
        self.vec = vec
        one = df.select(F.concat(as_double(vec), F.array(F.lit(1.0))).alias("_x"))
        row = gram_matrices(one, "_x").first()
        d, n = row["dim"] - 1, row["n"]
        g = np.frombuffer(row["gram"], dtype=np.float64).reshape(d + 1, d + 1)
        self.mean = g[d, :d] / n
        cov = g[:d, :d] / n - np.outer(self.mean, self.mean)
        p = np.linalg.inv(cov + ridge * np.eye(d) * max(1e-12, np.trace(cov) / d))
        self.weights = -p / np.diag(p)[:, None]
        np.fill_diagonal(self.weights, 0.0)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        mean, w = self.mean, self.weights
        return map_vectors(df, self.vec, out, lambda m: mean + (m - mean) @ w.T)

    def views(self, df: DataFrame, how: str = "mean", out: str = "embedding") -> DataFrame:
        """Each target column's view is the contribution of every other column to its prediction; views are averaged
        or laid end to end."""
        mean, w = self.mean, self.weights
        if how == "mean":
            share = w.mean(axis=0)
            return map_vectors(df, self.vec, out, lambda m: (m - mean) * share)
        if how == "concat":
            return map_vectors(df, self.vec, out, lambda m: ((m - mean)[:, None, :] * w[None]).reshape(len(m), -1))
        raise NotImplementedError(f"views are joined by mean or concat, not {how}")
