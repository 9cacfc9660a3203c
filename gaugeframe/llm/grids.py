"""Vectors on an integer grid, and bounded sums over all of them, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FAN_IN = 16


def on_grid(vectors: DataFrame, vec: str, carry: Sequence[str], scale: int, limit: int) -> DataFrame:
    """``(*carry, x array<long>)``: ``floor(scale * component)`` of every vector without null or non-finite components.

    Null and empty vectors are left out. Components beyond ``limit`` count as ``limit`` (or minus it), so that sums of squares
    stay within a long.
    """
    value = F.transform(F.col(f"`{vec}`"), lambda c: c.cast("double"))
    rows = vectors.select(*[F.col(f"`{c}`") for c in carry], value.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = rows.filter(F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(finite, F.lit(False)))
    bounded = lambda c: F.floor(F.greatest(F.lit(float(-limit)), F.least(F.lit(float(limit)), c * F.lit(float(scale)))))
    return rows.withColumn("x", F.transform("x", bounded))


def common_width(rows: DataFrame, vec: str = "x") -> int:
    """The length most vectors have, of equally frequent ones the greatest; zero without rows."""
    top = rows.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, dtype=np.int64) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def summed(rows: DataFrame, read: Callable[[list[pa.Array]], np.ndarray], dtype=np.float64) -> np.ndarray | None:
    """Sum of ``read(columns)`` over all batches of ``rows``, None without rows.

    Each task adds up its own batches; the sums of the tasks meet in ``FAN_IN`` and then in one place.
    """
    from pyspark import TaskContext

    def first(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = read(batch.columns)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([TaskContext.get().partitionId() % FAN_IN], pa.int32()),
                                              "total": [np.asarray(total, dtype).tobytes()]})

    def again(batches):
        total = None
        for batch in batches:
            for part in batch.column(1):
                part = np.frombuffer(part.as_buffer(), dtype)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([0], pa.int32()), "total": [total.tobytes()]})

    shape = "bucket int, total binary"
    sums = rows.mapInArrow(first, shape).repartition(FAN_IN, "bucket").mapInArrow(again, shape).collect()
    return sum(np.frombuffer(r["total"], dtype) for r in sums) if sums else None
