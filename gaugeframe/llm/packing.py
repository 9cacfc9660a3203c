"""Hierarchical residual packing of token pieces into sequences of at most ``size`` tokens.

``tokenize`` cuts every text into pieces of at most ``size`` ids. ``pack`` works on their lengths alone: every task packs
its pieces best-fit (longest first), keeps the bins that are nearly full and hands the others on as items of their used
length. Rounds with fewer tasks repeat that, until one task holds what is left or a round saves nothing. The contents of a
bin move with it, so a piece's place is the sum of the offsets along its chain of bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..staging import stage
from .common import thrifty
from .tokens import encoder

SIZE = 4096
ITEMS = 100_000  # items one task packs at a time


def tokenize(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", size: int = SIZE,
             end_id: int = 1) -> DataFrame:
    """Pieces ``(key, piece, start, length, ids)``; ``ids`` are little-endian unsigned 32-bit.

    A document is its ids and then ``end_id``; null and empty texts are ``end_id`` alone. Only documents of more than
    ``size`` ids are cut. The tokenizer file is read on the driver and sent to the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType)] + [
        T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * size

    def work(batches):
        encode = encoder(spec.value).encode
        for batch in thrifty(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, piece, start, ids = [], [], [], []
                for row, code in enumerate(encode([t or b"" for t in part.column(1).to_pylist()])):
                    code += end
                    for k in range(0, len(code), step):
                        rows.append(row)
                        piece.append(k // step)
                        start.append(k // 4)
                        ids.append(code[k: k + step])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"])

    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(
        work, schema).withColumnRenamed("id", key)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the used length of each bin: longest first, into the fullest bin that has room."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(size + 1)]
    some = 0  # bit k: a bin with k ids free
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fit = some >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            to = free[room].pop()
            if not free[room]:
                some ^= 1 << room
        else:
            room, to = size, len(used)
            used.append(0)
        bins[item], offsets[item] = to, used[to]
        used[to] += need
        room -= need
        if not free[room]:
            some |= 1 << room
        free[room].append(to)
    return bins, offsets, np.array(used, np.int64)


def _pack_round(number: int, size: int, slack: int):
    """Items ``(item, length)`` to ``(item, bin, shift, used, open)``; bins are numbered by round, task and place."""
    from pyspark import TaskContext

    def pack(tables: list[pa.RecordBatch], base: int):
        items = pa.concat_tables([pa.Table.from_batches([t]) for t in tables])
        lengths = items.column(1).to_numpy()
        bins, offsets, used = best_fit(lengths, size)
        return len(used), pa.RecordBatch.from_arrays(
            [items.column(0).combine_chunks(), pa.array(base + bins), pa.array(offsets), pa.array(used[bins]),
             pa.array(used[bins] < size - slack)], names=["item", "bin", "shift", "used", "open"])

    def work(batches):
        base = (number << 56) | (TaskContext.get().partitionId() << 32)
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ITEMS:
                many, out = pack(held, base)
                base, held, rows = base + many, [], 0
                yield out
        if rows:
            yield pack(held, base)[1]

    return work


def place(items: DataFrame, size: int = SIZE, slack: int = 8, items_per_task: int = ITEMS) -> DataFrame:
    """``(item, sequence_id, offset)`` for staged items ``(item long, length long)``, each of 1 to ``size`` ids.

    ``slack`` is how many ids may be left free in a bin that is not handed on.
    """
    shape = "item long, bin long, shift long, used long, open boolean"
    rounds = [stage(items.mapInArrow(_pack_round(1, size, slack), shape), "packed-1")]
    left, last = rounds[-1].filter("open").agg(F.count_distinct("bin")).first()[0], None
    while left > 1 and last != (left, 1):
        tasks = max(1, -(-left // items_per_task))
        if last and last[1] <= tasks and left > 0.98 * last[0]:
            break  # a round with as many tasks saved under a fiftieth
        nth = len(rounds) + 1
        again = rounds[-1].filter("open").select(F.col("bin").alias("item"), F.col("used").alias("length")).distinct()
        rounds.append(stage(again.repartition(tasks, "item").mapInArrow(_pack_round(nth, size, slack), shape), f"packed-{nth}"))
        last = (left, tasks)
        left = rounds[-1].filter("open").agg(F.count_distinct("bin")).first()[0]
    chain = None
    for packed in reversed(rounds[1:]):
        here = packed.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("shift").alias("by"))
        if chain is not None:
            here = here.join(chain.select(F.col("bin").alias("up"), F.col("up").alias("top"), F.col("by").alias("more")), "up", "left")
            here = here.select("bin", F.coalesce("top", "up").alias("up"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
        chain = here
    placed = rounds[0].select("item", "bin", "shift")
    if chain is not None:
        placed = placed.join(chain, "bin", "left")
        return placed.select("item", F.coalesce("up", "bin").alias("sequence_id"),
                             (F.col("shift") + F.coalesce("by", F.lit(0))).alias("offset"))
    return placed.select("item", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", size: int = SIZE,
         end_id: int = 1, slack: int = 8, payload: Column | None = None) -> DataFrame:
    """Every piece of every document with its ids and its place: ``(key, piece, start, length, ids, sequence_id, offset)``.

    ``payload`` is what travels with a piece to its place instead of its ids, a column of ``tokenize``'s (with its own name).
    Null and empty texts are one piece of one id. Rows with a null or repeated key are packed like others, a piece each
    time. Columns beside ``key`` and ``text`` are ignored. An empty table gives an empty result.
    """
    pieces = stage(tokenize(docs, tokenizer_path, key, text, size, end_id).withColumn(
        "item", F.monotonically_increasing_id()), "pieces")
    pieces = pieces.select(key, "piece", "start", "length", F.col("ids") if payload is None else payload, "item")
    whole = pieces.filter(F.col("length") == size).withColumns(
        {"sequence_id": -F.col("item") - 1, "offset": F.lit(0).cast("long")}).drop("item")
    rest = pieces.filter(F.col("length") < size)
    placed = place(rest.select("item", "length"), size, slack)
    return rest.join(placed, "item").drop("item").unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the pieces of each sequence end to end; a sequence has at most ``size`` ids."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
