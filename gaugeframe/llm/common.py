"""Helpers the operators of this package share: checked broadcasts, components, byte-level text arrays."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from ..staging import stage

#: A side of a join is broadcast only if its measured rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20


#: Bytes of rows sent to a Python worker at once; Spark's default of 64 MB is much for long texts on small executors.
ARROW_BATCH = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and, unless the session sets them otherwise, make batches to Python workers smaller."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b"):
        spark.conf.set(key, f"{ARROW_BATCH}b")


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system; workers live long and would keep the peak of every operator they ever ran."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def thrifty(batches):
    """The batches, with what the last one used given back before the next."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``count * row_bytes`` fits the limit, else as it is (a shuffled join then).

    ``df`` should read a staged table: its rows are counted first.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def drop_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not among ``ids`` (one column ``key``); rows with a null key stay."""
    return rows.join(broadcast_if_small(ids.filter(F.col(key).isNotNull()), 64), key, "left_anti").select(
        *[F.col(f"`{c}`") for c in rows.columns])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, value: str, hot_rows: int = 1024) -> DataFrame:
    """``rows`` of a staged table with the ``value`` of their group; every row has a group in ``groups(key, value, n)``.

    ``n`` counts a group's rows. Those of more than ``hot_rows`` are few, and their values are broadcast: no task gathers the rows of a
    large group. If even they outgrow a broadcast, the join is an ordinary one against a table of its own, whose skew Spark
    splits.
    """
    groups = stage(groups, "groups")
    hot = stage(groups.filter(F.col("n") > hot_rows).select(key, value), "hot-groups")
    many = hot.count()
    if not many or many * 32 > BROADCAST_BYTES:
        return rows.join(groups.select(key, value), key)
    large = F.broadcast(hot)
    return rows.join(large, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        groups.filter(F.col("n") <= hot_rows).select(key, value), key))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row ``(node, component)`` per linked node, the smallest node names it.

    Alternates large-star and small-star rounds, which only move edges towards smaller nodes, until nothing changes.
    Every round is a written table; no component or adjacency list is gathered anywhere, nor the links of a hub. Links to itself
    are ignored.
    """
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(
                F.min("component").alias("component"))
        seen = mark
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = (join_groups(both, least, "u", "m").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_groups(large, least, "u", "m").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "small-star")


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over the pairs ``(i, j)``."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


# ---- text as byte arrays -------------------------------------------------------------------------------------------

ROOT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(ROOT), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
KIND = np.full(256, OTHER, np.uint8)
KIND[:33] = SPACE
KIND[127] = SPACE
KIND[128:] = LETTER
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column laid end to end and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(offs) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = 1 << 19):
    """Ranges of whole rows of about ``limit`` bytes; a longer row is a range of its own."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length() if n else 0)
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, ROOT), np.full(size, INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def runs(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = KIND):
    """Maximal runs of bytes of one kind that end with their row: start, end, kind and row of each, white space left out."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint8), none
    k = kind[data]
    edge = np.ones(len(data), bool)
    edge[1:] = k[1:] != k[:-1]
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(data))
    keep = k[start] != SPACE
    start, end = start[keep], end[keep]
    return start, end, k[start], np.searchsorted(offs, start, "right") - 1
