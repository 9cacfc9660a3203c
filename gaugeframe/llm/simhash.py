"""SimHash near-dedup with BK-trees.

Fingerprints are made in the tasks that read the texts. Equal fingerprints are one node from then on. Two 64-bit values
within ``radius`` bits agree in at least two of ``radius + 2`` bit blocks, so every pair of blocks deals the distinct
fingerprints into shards, and any linked pair meets in one of them. In each shard a BK-tree (children keyed by their
Hamming distance to the parent) is searched for every member, following only edges within the radius. The forest grows
with the corpus, so it is not sent to every executor: each shard's tree goes to the tasks that hold the shard's probes, and
a shard of more than ``shard_rows`` members is cut into slices whose trees each meet every later slice. Tasks emit at most
one link per member (a spanning forest of what they found), never all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .common import broadcast_if_small, join_groups, components, local_roots, thrifty

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of a text: lower-cased A-Z, ASCII white space, majority of the bits of the shingles' XXH64."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = ends[min(words, len(parts)) - 1:].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(first, last)], np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at: at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``(key, fp)`` per row; ``fp`` holds the 64 bits as a signed long. Null and empty texts have fingerprint zero."""
    kind = docs.schema[key].dataType

    def work(batches):
        for batch in thrifty(batches):
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    from pyspark.sql import types as T
    out = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        work, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())]))
    return out.withColumnRenamed("id", key)


# ---- BK-trees ------------------------------------------------------------------------------------------------------


def build_trees(fps: np.ndarray, shard: np.ndarray):
    """One BK-tree per run of equal ``shard``, all grown level by level at once.

    Returns ``(root, order, key)``: the root of every member's tree, the nodes sorted by (parent, distance) and that sort
    key, ``parent * 65 + distance``. The first member of a shard is its root; a member descends the edge of its distance
    to the current node and becomes the child where there is none.
    """
    n = len(fps)
    first = np.ones(n, bool)
    first[1:] = shard[1:] != shard[:-1]
    root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    left = np.flatnonzero(~first)
    at = root[left]
    while len(left):
        d = np.bitwise_count(fps[left] ^ fps[at]).astype(np.int64)
        k = at * (BITS + 1) + d
        by = np.argsort(k, kind="stable")
        left, k, at, d = left[by], k[by], at[by], d[by]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        child = left[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
        parent[left[head]], edge[left[head]] = at[head], d[head]
        left, at = left[~head], child[~head]
    order = np.flatnonzero(parent >= 0)
    key = parent[order] * (BITS + 1) + edge[order]
    by = np.argsort(key, kind="stable")
    return root, order[by], key[by]


def search_trees(fps: np.ndarray, tree, probes: np.ndarray, probe_root: np.ndarray, radius: int, budget: int = 1 << 20):
    """Pairs ``(probe position, node)`` within ``radius``: from each root only edges in ``[d - radius, d + radius]`` are followed."""
    _, order, key = tree
    found = []
    stack = [(np.arange(at, min(at + budget, len(probes))), probe_root[at: at + budget]) for at in range(0, len(probes), budget)]
    while stack:
        who, node = stack.pop()
        if len(who) > budget:
            half = len(who) // 2
            stack += [(who[:half], node[:half]), (who[half:], node[half:])]
            continue
        d = np.bitwise_count(probes[who] ^ fps[node]).astype(np.int64)
        hit = d <= radius
        if hit.any():
            found.append((who[hit], node[hit]))
        lo = np.searchsorted(key, node * (BITS + 1) + np.maximum(d - radius, 0), "left")
        hi = np.searchsorted(key, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
        many = hi - lo
        total = int(many.sum())
        if total:
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
            stack.append((np.repeat(who, many), order[at]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _link_shards(radius: int):
    """Work on batches of shards ``(tree array<long>, probes array<long>)``; no probes: the tree's members probe it."""

    def work(batches):
        for batch in thrifty(batches):
            tree, probes = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column(0), batch.column(1)))
            size = np.diff(tree.offsets.to_numpy())
            fps = tree.flatten().to_numpy().view(np.uint64)
            shard = np.repeat(np.arange(len(size)), size)
            grown = build_trees(fps, shard)
            start = np.concatenate([[0], np.cumsum(size)])
            more = np.diff(probes.offsets.to_numpy())
            other = probes.flatten().to_numpy().view(np.uint64)
            own = np.flatnonzero(np.repeat(more == 0, size))
            values = np.concatenate([fps, other])
            who = np.concatenate([own, len(fps) + np.arange(len(other))])
            i, j = search_trees(fps, grown, values[who], np.concatenate([grown[0][own], np.repeat(start[:-1], more)]), radius)
            root = local_roots(len(values), who[i], j)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[root[moved]].view(np.int64))],
                                             names=["a", "b"])

    return work


def _blocks(fp: Column, parts: int) -> list[Column]:
    cut = [BITS * k // parts for k in range(parts + 1)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(cut)]


def links(fps: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """A spanning set of links ``(a, b)`` between distinct fingerprints ``fps(fp)`` that differ in at most ``radius`` bits."""
    parts = radius + 2
    blocks = _blocks(F.col("fp"), parts)
    keys = [F.concat_ws("|", F.lit(k), a, b) for k, (a, b) in enumerate(itertools.combinations(blocks, 2))]
    dealt = stage(fps.select("fp", F.explode(F.array(*[F.xxhash64(k) for k in keys])).alias("shard")), "shards")
    hot = stage(dealt.groupBy("shard").count().filter(F.col("count") > shard_rows).select(
        "shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("slices")), "hot-shards")
    dealt = dealt.join(broadcast_if_small(hot, 16), "shard", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("slices")).cast("int")
    units = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    units = units.groupBy("shard", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("fp"))).alias("tree"),
        F.collect_list(F.when(F.col("own") > F.col("other"), F.col("fp"))).alias("probes"))
    units = units.filter((F.size("tree") + F.size("probes") > 1) & (F.size("tree") > 0))
    return units.select("tree", "probes").mapInArrow(_link_shards(radius), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4,
                    seed: int = 42, shard_rows: int = 4096) -> DataFrame:
    """``(key, fp, component_id)`` per row: the smallest key reachable over links between fingerprints.

    Rows without words share fingerprint zero and are linked like others. A repeated key gives a row per input row. A row
    with a null key belongs to its component but never names it (null if no row of the component has a key). Columns
    beside ``key`` and ``text`` are ignored. An empty table gives an empty result.
    """
    rows = stage(fingerprints(docs, key, text, words, seed), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    found = components(links(nodes.select("fp"), radius, shard_rows))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stage(named, "named")
    first = named.groupBy("component").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = join_groups(named, first, "component", "component_id").select("fp", "component_id")
    return rows.join(named, "fp").select(key, "fp", "component_id")
