"""Seeded pseudo-random columns that depend on keys only, never on partitioning or task order."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

TWO32 = 4294967296.0


def _as_text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def key_text(*parts) -> Column:
    """Key parts joined by ``|``; plain Python values are literals, missing values become empty text."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit("|"))
        pieces.append(F.coalesce(_as_text(part), F.lit("")))
    return F.concat(*pieces)


def uniform(*parts) -> Column:
    """Uniform in (0, 1): the first 32 bits of the key's md5, centred in their cell."""
    head = F.conv(F.substring(F.md5(key_text(*parts)), 1, 8), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(TWO32)


def bucket(n: int, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.floor(uniform(*parts) * F.lit(float(n))).cast("int")


def gauss(*parts) -> Column:
    """Standard normal by Box-Muller over two keyed uniforms."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform("a", *parts))) * F.cos(F.lit(2.0 * math.pi) * uniform("b", *parts))


def uniform_py(*parts) -> float:
    """The same draw as :func:`uniform`, for driver-side or in-task constants."""
    digest = hashlib.md5("|".join("" if p is None else str(p) for p in parts).encode()).hexdigest()
    return (int(digest[:8], 16) + 0.5) / TWO32


def gauss_py(*parts) -> float:
    return math.sqrt(-2.0 * math.log(uniform_py("a", *parts))) * math.cos(2.0 * math.pi * uniform_py("b", *parts))


def gauss_matrix(rows: int, cols: int, *parts) -> np.ndarray:
    """A seeded normal matrix; equal on every task that builds it."""
    seed = int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:16], 16)
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((rows, cols))


def unit_point(dim: int, *parts) -> np.ndarray:
    """Deterministic point on the unit sphere of ``dim`` dimensions for a key."""
    raw = np.array([gauss_py(*parts, i) for i in range(dim)])
    return raw / math.sqrt(float((raw * raw).sum()))


def gauss_column(dim: int, *parts) -> Column:
    """JVM twin of the raw draw behind :func:`unit_point`: an array of keyed normals."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: gauss(*parts, i))
