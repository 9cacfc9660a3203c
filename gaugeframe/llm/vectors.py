"""Embedding near-dedup: exact cosine links by a subspace pigeonhole join.

For unit vectors ``cosine >= t`` means a squared distance of at most ``2 - 2t``. The vectors are rotated (signs and a Walsh-Hadamard
transform, so every task rotates a vector to the same bits) and cut into blocks of ``block_dim`` values; in at least one
block a linked pair is within the block's share of that budget. Each block is a range join: its first few values place a
vector in a cell of a grid as wide as the block's reach is across, and the vector also visits the later cells its reach touches. A
pair counts in the first block within budget only, and only if the cosine of the original values in double precision is
high enough.

Equal vectors are one node. Tasks return a node's number of links and one link to its local component, never pairs. A cell
of more than ``slice_rows`` vectors is cut into slices that meet pairwise in units of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..staging import stage
from .common import broadcast_if_small, join_groups, components, local_roots

SLACK = 1e-6


def clean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v)``: little-endian doubles, or floats as they are; null for null, empty, zero or non-finite vectors."""
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind = np.dtype("<f4") if single else np.dtype("<f8")

    def work(batches):
        for batch in batches:
            out = []
            for row in batch.column(1):
                values = None
                if row.is_valid and len(row.values) and not row.values.null_count:
                    values = row.values.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)
                    if not np.isfinite(values).all() or not values.any():
                        values = None
                out.append(None if values is None else values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    shape = T.StructType([T.StructField("id", vectors.schema[key].dataType), T.StructField("v", T.BinaryType())])
    column = F.col(vector) if single else F.col(vector).cast("array<double>")
    return vectors.select(F.col(key).alias("id"), column.alias("x")).mapInArrow(work, shape)


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision, whatever their magnitude."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def rotate(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Random signs and the normalised Walsh-Hadamard transform of each row, padded with zeros to ``size`` values."""
    signs = np.random.default_rng(seed).integers(0, 2, size) * 2.0 - 1.0
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    out *= signs
    step = 1
    while step < size:
        pairs = out.reshape(len(x), -1, 2, step)
        out = np.concatenate([(pairs[:, :, :1] + pairs[:, :, 1:]), (pairs[:, :, :1] - pairs[:, :, 1:])], axis=2).reshape(len(x), size)
        step *= 2
    return out / math.sqrt(size)


class Grid:
    """Blocks, budgets and cells for vectors of up to ``dims`` values."""

    def __init__(self, dims: int, threshold: float, block_dim: int, cell_dims: int, seed: int):
        self.size = 1 << max(0, dims - 1).bit_length()
        self.block = min(block_dim, self.size)
        self.blocks = self.size // self.block
        self.budget = (2 - 2 * threshold) / self.blocks + SLACK
        self.reach = math.sqrt(self.budget) + SLACK
        self.width = 2 * self.reach
        self.cell_dims = min(cell_dims, self.block)
        self.threshold, self.seed = threshold, seed

    def rotated(self, raw: np.ndarray) -> np.ndarray:
        return rotate(unit(raw), self.size, self.seed)

    def visits(self, points: np.ndarray):
        """``(row, cell, home)``: each row's own cell in a block and the later cells within reach of it."""
        at = points[:, : self.cell_dims]
        own = np.floor(at / self.width).astype(np.int32)
        rows, cells, far = np.arange(len(at)), own.copy(), np.zeros(len(at))
        for d in range(self.cell_dims):
            more = [(rows, cells, far)]
            for step in (-1, 1):
                edge = (own[rows, d] + (step > 0)) * self.width
                gap = far + (at[rows, d] - edge) ** 2
                near = gap <= self.reach**2
                moved = cells[near].copy()
                moved[:, d] += step
                more.append((rows[near], moved, gap[near]))
            rows, cells, far = (np.concatenate(x) for x in zip(*more))
        differ = cells != own[rows]
        home = ~differ.any(1)
        first = differ.argmax(1)
        later = cells[np.arange(len(cells)), first] > own[rows, first]
        keep = home | later
        return rows[keep], cells[keep], home[keep]


def _deal(grid: Grid, kind: str):
    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lengths = np.array([len(v.as_buffer()) for v in part.column(2)])
                for length in np.unique(lengths):
                    rows = part.take(pa.array(np.flatnonzero(lengths == length)))
                    raw = np.frombuffer(b"".join(rows.column(2).to_pylist()), kind).reshape(rows.num_rows, -1)
                    rotated = grid.rotated(raw).reshape(len(raw), grid.blocks, grid.block)
                    for b in range(grid.blocks):
                        who, cells, home = grid.visits(rotated[:, b])
                        keys = np.hstack([np.full((len(cells), 1), length, "<i4"), np.full((len(cells), 1), b, "<i4"), cells.astype("<i4")])
                        taken = rows.take(pa.array(who))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(np.full(len(who), b), pa.int32()), pa.array(home),
                             *taken.columns], names=["cell", "block", "home", "node", "copies", "v"])

    return work


def close_pairs(a: np.ndarray, b: np.ndarray, budget: float, reach: float, dim: int, tile: int = 1 << 22):
    """Positions ``(in a, in b)`` of rows within ``budget``, about: strips along one value after another, then a matrix product."""
    found = []
    stack = [(np.arange(len(a)), np.arange(len(b)), dim)]
    while stack:
        i, j, d = stack.pop()
        if not len(i) or not len(j):
            continue
        if len(i) * len(j) <= tile or d >= a.shape[1]:
            step = max(1, tile // len(j))
            other = b[j].astype(np.float32)
            norm = np.einsum("ij,ij->i", other, other)
            for at in range(0, len(i), step):
                own = a[i[at: at + step]].astype(np.float32)
                far = np.einsum("ij,ij->i", own, own)[:, None] + norm - 2 * (own @ other.T)
                x, y = np.nonzero(far <= budget + 1e-5)
                found.append((i[at + x], j[y]))
            continue
        strip = np.floor(a[i, d] / (2 * reach)).astype(np.int64)
        for s in np.unique(strip):
            lo, hi = s * 2 * reach - reach, (s + 1) * 2 * reach + reach
            stack.append((i[strip == s], j[(b[j, d] >= lo) & (b[j, d] <= hi)], d + 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _join_unit(grid: Grid, kind: str):
    """A unit's vectors ``(block, home, side, node, copies, v)`` to ``(node, links, root)``.

    A unit ``(cell, a, a)`` is a slice that meets itself, ``(cell, a, b)`` two slices, told apart by ``side``.
    """

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        alone = key[1].as_py() == key[2].as_py()
        home, side = (table.column(k).to_numpy(zero_copy_only=False) for k in ("home", "side"))
        node, copies = (table.column(k).to_numpy() for k in ("node", "copies"))
        raw = np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(table.num_rows, -1)
        b = table.column("block")[0].as_py()
        points = grid.rotated(raw).reshape(len(raw), grid.blocks, grid.block)
        here = points[:, b]
        pairs = []
        sides = [(home & (side == 0), side == 1), (home & (side == 1), ~home & (side == 0))] if not alone else [(home, np.ones(len(home), bool))]
        for left, right in sides:
            left, right = np.flatnonzero(left), np.flatnonzero(right)
            i, j = close_pairs(here[left], here[right], grid.budget, grid.reach, grid.cell_dims)
            i, j = left[i], right[j]
            once = (i < j) | (~home[j] & (i != j)) if alone else np.ones(len(i), bool)
            pairs.append((i[once], j[once]))
        i, j = (np.concatenate(x) for x in zip(*pairs))
        links, kept_i, kept_j = np.zeros(len(raw), np.int64), [], []
        x = unit(raw)
        for at in range(0, len(i), 1 << 14):
            p, q = i[at: at + (1 << 14)], j[at: at + (1 << 14)]
            like = np.einsum("ij,ij->i", x[p], x[q]) >= grid.threshold
            p, q = p[like], q[like]
            gap = (points[p] - points[q]) ** 2
            total = gap[:, :, 0]
            for d in range(1, grid.block):
                total = total + gap[:, :, d]
            inside = total <= grid.budget
            mine = inside.argmax(1) == b
            p, q = p[mine & inside.any(1)], q[mine & inside.any(1)]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            kept_i.append(p)
            kept_j.append(q)
        if kept_i:
            root = local_roots(len(raw), np.concatenate(kept_i), np.concatenate(kept_j))
        else:
            root = np.arange(len(raw))
        told = np.flatnonzero(links)
        return pa.table({"node": node[told], "links": links[told], "root": node[root[told]]})

    return work


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, block_dim: int = 16,
                    cell_rows: int = 8192, slice_rows: int = 32768, seed: int = 11) -> DataFrame:
    """``(key, n_links, component_id, kept)`` per row.

    ``n_links`` counts other rows linked directly, ``component_id`` is the smallest key reachable, ``kept`` tells whether it
    is the row's own. Null, empty, zero and non-finite vectors, and such of different lengths, are not linked. Rows with a null
    key count as links but name no component; unlinked, their component is null. A repeated key is a row each time. Other
    columns are ignored; an empty table gives an empty result. ``cell_rows`` only sets how fine the grid is.
    """
    spark = vectors.sparkSession
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = stage(clean_vectors(vectors, key, vector), "vectors")
    nodes = stage(rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
                  .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    many, longest = nodes.agg(F.count(F.lit(1)), F.max(F.length("v"))).first()
    shape = "node long, links long, root long"
    if many:
        cell_dims = max(2, math.ceil(math.log2(many / cell_rows) / 1.12))
        grid = Grid(longest // np.dtype(kind).itemsize, threshold, block_dim, cell_dims, seed)
        dealt = nodes.select("node", "copies", "v").mapInArrow(
            _deal(grid, kind), "cell binary, block int, home boolean, node long, copies long, v binary")
        # counts are taken from the narrow columns; the deal itself is cheap to repeat and too wide to write
        hot = stage(dealt.groupBy("cell").count().filter(F.col("count") > slice_rows).select(
            "cell", F.ceil(F.col("count") / slice_rows).cast("int").alias("slices")), "hot-cells")
        dealt = dealt.join(broadcast_if_small(hot, 128), "cell", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        dealt = dealt.withColumn("side", (F.col("own") > F.col("other")).cast("int"))
        units = dealt.groupBy("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
        found = stage(units.applyInArrow(_join_unit(grid, kind), shape), "vector-links")
    else:
        found = spark.createDataFrame([], shape)
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    merged = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "first", "copies", "v").join(total, "node", "left").join(merged, "node", "left")
    named = stage(named.select("v", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                               F.coalesce("component", "node").alias("component")), "named-vectors")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_groups(named, smallest, "component", "component_id").select("v", "n_links", "component_id")
    out = rows.join(named, "v", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
