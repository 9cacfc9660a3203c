"""Every row against every point of a table, in blocks: chunks of rows meet blocks of points in numpy and reduce at once.

The table may have any number of points: it is never collected, and no row carries an entry per point. A block of points is one
cell; a small table is broadcast, a larger one is copied to as many salts as keep the cores busy, so few blocks are no
hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import as_double
from ..staging import stage

BLOCK_POINTS, CHUNK_ROWS = 4096, 2048
BROADCAST_BYTES = 16 << 20


def point_blocks(points: DataFrame, key: str, vec: str, extra: Sequence[str] = (), block_points: int = BLOCK_POINTS) -> DataFrame:
    """Staged ``(block, keys, <extra>, flat)`` of points ``(key, vec, <extra>)``: arrays by ascending key, vectors end to end."""
    points = stage(points.select(F.col(key).alias("key"), as_double(vec).alias("vec"), *extra), "points")
    many = max(1, -(-points.count() // block_points))
    item = F.struct("key", *extra, "vec")
    packed = points.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(many)).cast("int")).groupBy("block").agg(
        F.array_sort(F.collect_list(item)).alias("items"))
    return stage(packed.select("block", F.col("items.key").alias("keys"), *[F.col(f"items.{c}").alias(c) for c in extra],
                               F.flatten("items.vec").alias("flat")), "point-blocks")


def _chunks(extra: Sequence[str]):
    """Batches of ``(key, <extra>, vec)`` to rows ``(chunk, keys, <extra>, flat)``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *[one(part.column(k)) for k in range(1 + len(extra))],
                                                  one(part.column(1 + len(extra)).flatten())], names=["chunk", "keys", *extra, "flat"])
                chunk += 1
    return work


def _met(chunks: DataFrame, blocks: DataFrame, many: int, values: int, chunk: str) -> DataFrame:
    """Every chunk beside every of the ``many`` blocks, which hold ``values`` numbers."""
    chunks = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, many) - 1))))
    if values * 8 <= BROADCAST_BYTES:
        return chunks.join(F.broadcast(blocks), "block")
    salts = 2 * chunks.sparkSession.sparkContext.defaultParallelism
    blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return chunks.withColumn("salt", F.pmod(F.xxhash64(chunk), F.lit(salts)).cast("int")).join(blocks, ["block", "salt"])


def against_blocks(rows: DataFrame, key: str, vec: str, blocks: DataFrame, compare: Callable, schema: str, extra: Sequence[str] = (),
                   block_extra: Sequence[str] = ()) -> DataFrame:
    """``compare(chunk, block)`` of every chunk of ``rows(key, vec, <extra>)`` with every block; it returns a record batch of ``schema``.

    Chunk and block are dictionaries of numpy arrays: ``keys``, ``points`` (a matrix) and the extra columns.
    """
    slim = rows.select(F.col(key).alias("key"), *extra, as_double(vec).alias("vec"))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    shape = ", ".join(["chunk long", f"keys array<{kinds['key']}>", *[f"{c} array<{kinds[c]}>" for c in extra], "flat array<double>"])
    chunks = slim.mapInArrow(_chunks(extra), shape)
    facts = blocks.agg(F.count("*").alias("n"), F.sum(F.size("flat")).alias("values")).first()
    theirs = blocks.select("block", F.col("keys").alias("block_keys"), *[F.col(c).alias(f"block_{c}") for c in block_extra],
                           F.col("flat").alias("block_flat"))
    met = _met(chunks, theirs, facts["n"], facts["values"] or 0, "chunk")
    names = ["keys", *extra, "flat", "block_keys", *[f"block_{c}" for c in block_extra], "block_flat"]

    def matrices(batch: pa.RecordBatch, row: int, side: Sequence[str], keys: str, flat: str) -> dict:
        column = lambda c: batch.column(c)[row].values
        out = {c.removeprefix("block_"): column(c).to_numpy(zero_copy_only=False) for c in side}
        out["keys"] = column(keys).to_numpy(zero_copy_only=False)
        out["points"] = column(flat).to_numpy(zero_copy_only=False).reshape(len(out["keys"]), -1)
        return out

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield compare(matrices(batch, row, extra, "keys", "flat"),
                              matrices(batch, row, [f"block_{c}" for c in block_extra], "block_keys", "block_flat"))

    return met.select(*names).mapInArrow(work, schema)


def squared_distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of slices of ``a`` to all of ``b``, from the differences themselves."""
    step = max(1, 4_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        part = a[at: at + step, None, :] - b[None]
        yield slice(at, at + len(part)), np.einsum("ijk,ijk->ij", part, part)


def pair_distances(rows: DataFrame, row_id: str, vec: str, blocks: DataFrame, out: str = "distance", cluster: str = "cluster") -> DataFrame:
    """``(row_id, cluster, distance)`` of every row and point."""
    row_kind = rows.schema[row_id].dataType.simpleString()
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def compare(chunk, block):
        far = np.concatenate([np.sqrt(d) for _, d in squared_distances(chunk["points"], block["points"])])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(chunk["keys"], len(block["keys"]))),
                                           pa.array(np.tile(block["keys"], len(chunk["keys"]))), pa.array(far.ravel())], names=[row_id, cluster, out])

    return against_blocks(rows, row_id, vec, blocks, compare, f"`{row_id}` {row_kind}, `{cluster}` {kind}, `{out}` double")


def distance_summary(df: DataFrame, vec: str, blocks: DataFrame, names: Sequence[str] = ("least", "weighted", "deviation")) -> DataFrame:
    """``df`` with three columns ``names`` of a row's distances to all points: the least, their sum by ``weight`` and their population
    deviation.

    Whole rows travel with their chunk, as bytes, and meet the blocks once; a block gives four numbers a row. Only with more
    than one block are chunks shuffled, to add those numbers up. The columns of ``df`` are of any types.
    """
    kinds = to_arrow_schema(df.schema)
    taken = {c.lower() for c in df.columns}
    name = next(f"_vec{i}" for i in range(len(taken) + 1) if f"_vec{i}" not in taken)

    def pack(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                rows = pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(part.columns, kinds.types)], schema=kinds)
                flat = part.column(len(kinds)).flatten()
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([rows.serialize().to_pybytes()], pa.binary()),
                                                  pa.array([part.num_rows], pa.int32()),
                                                  pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["chunk", "rows", "many", "flat"])
                chunk += 1

    def compare(batches):
        for batch in batches:
            for chunk, rows, many, flat, block, weight, points in zip(*batch.columns):
                x = flat.values.to_numpy(zero_copy_only=False).reshape(many.as_py(), -1)
                y, w = points.values.to_numpy(zero_copy_only=False).reshape(-1, x.shape[1]), weight.values.to_numpy(zero_copy_only=False)
                parts = []
                for _, d in squared_distances(x, y):
                    far = np.sqrt(d)
                    mean = far.mean(axis=1)
                    parts.append(np.column_stack([far.min(axis=1), far @ w, mean, ((far - mean[:, None]) ** 2).sum(axis=1)]))
                yield pa.RecordBatch.from_pydict({
                    "chunk": [chunk.as_py()], "rows": pa.array([rows.as_py() if block.as_py() == 0 else None], pa.binary()),
                    "n": [float(len(y))], "sums": [np.concatenate(parts).tobytes()]})

    def unpack(batches):
        for batch in batches:
            for rows, found in zip(*batch.columns):
                n, sums = (found.values.field(k) for k in range(2))
                n = n.to_numpy()[:, None]
                least, weighted, mean, apart = np.stack([np.frombuffer(v.as_buffer()).reshape(-1, 4) for v in sums]).transpose(2, 0, 1)
                middle = (n * mean).sum(0) / n.sum()
                spread = np.sqrt((apart + n * (mean - middle) ** 2).sum(0) / n.sum())
                whole = pa.ipc.read_record_batch(pa.BufferReader(rows.as_buffer()), kinds)
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(least.min(0)), pa.array(weighted.sum(0)), pa.array(spread)],
                                                 names=[*kinds.names, *names])

    chunks = df.select(*[F.col(f"`{c}`") for c in df.columns], as_double(F.col(f"`{vec}`")).alias(name)).mapInArrow(
        pack, "chunk long, rows binary, many int, flat array<double>")
    theirs = blocks.select("block", "weight", F.col("flat").alias("points"))
    facts = blocks.agg(F.count("*").alias("n"), F.sum(F.size("flat")).alias("values")).first()
    met = _met(chunks, theirs, facts["n"], facts["values"] or 0, "chunk").select("chunk", "rows", "many", "flat", "block", "weight", "points")
    sums = met.mapInArrow(compare, "chunk long, rows binary, n double, sums binary")
    each = F.struct("n", "sums")
    if facts["n"] > 1:
        sums = sums.groupBy("chunk").agg(F.max("rows").alias("rows"), F.collect_list(each).alias("found"))
    else:
        sums = sums.withColumn("found", F.array(each))
    shape = T.StructType([*df.schema, *[T.StructField(c, T.DoubleType()) for c in names]])
    return sums.select("rows", "found").mapInArrow(unpack, shape)
