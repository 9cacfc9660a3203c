"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Words, numbers and runs of marks are terms, dealt to ``BUCKETS`` by hash. Every bucket has a sparse random index vector. A
pass over all documents adds, for each term, the index vectors of its neighbours up to two places away (integer sums, so
their order does not matter). A term's vector is its own index vector beside its context vector of unit length. A document
is the mean vector of its terms, of a mark for each word's letter case and of one for each word that repeats the last.

The network learns from a bounded sample of labelled rows (``max_rows``, the smallest hashes of the key). A quarter of the
sample sets the temperature of the probabilities.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LETTER, LOWER, broadcast_if_small, chunks, flat, give_back, runs, span_hashes, thrifty
from ..staging import stage

BUCKETS, DIM = 1 << 14, 32
MARKS = 4  # the first buckets: lower case, capitalised, upper case, repeated
SLICES = 64


def index_vectors(seed: int = 7) -> np.ndarray:
    """A random +1 and a random -1 per bucket, int8 ``BUCKETS`` x ``DIM``."""
    draw = np.random.default_rng(seed)
    plus = draw.integers(0, DIM, BUCKETS)
    minus = (plus + draw.integers(1, DIM, BUCKETS)) % DIM
    out = np.zeros((BUCKETS, DIM), np.int8)
    out[np.arange(BUCKETS), plus], out[np.arange(BUCKETS), minus] = 1, -1
    return out


def terms(column: pa.Array):
    """Per piece of the column: ``(first row, rows, bucket, row, mark bucket, mark row)`` as arrays; rows count from the first."""
    data, offs = flat(column)
    for a, b in chunks(offs):
        part, at = data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]
        start, end, kind, row = runs(part, at)
        h = span_hashes(LOWER[part], start, end)
        bucket = MARKS + (h % np.uint64(BUCKETS - MARKS)).astype(np.int64)
        word = np.flatnonzero(kind == LETTER)
        upper = (part[start[word]] >= 65) & (part[start[word]] <= 90)
        shout = upper & (end[word] - start[word] > 1) & (part[end[word] - 1] >= 65) & (part[end[word] - 1] <= 90)
        again = word[1:][(h[word[1:]] == h[word[:-1]]) & (row[word[1:]] == row[word[:-1]])]
        mark = np.concatenate([upper.astype(np.int64) + shout, np.full(len(again), 3)])
        yield a, b - a, bucket, row, mark, np.concatenate([row[word], row[again]])


def _context_sums(seed: int):
    def work(batches):
        vectors = index_vectors(seed)
        plus, minus = vectors.argmax(1), vectors.argmin(1)
        total = np.zeros(BUCKETS * DIM, np.int64)
        for batch in thrifty(batches):
            for _, _, bucket, row, *_ in terms(batch.column(0)):
                for step in (1, 2):
                    near = np.flatnonzero(row[step:] == row[:-step])
                    left, right = bucket[near], bucket[near + step]
                    for to, of in ((left, right), (right, left)):
                        total += np.bincount(to * DIM + plus[of], minlength=len(total))
                        total -= np.bincount(to * DIM + minus[of], minlength=len(total))
        parts = total.reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                         names=["slice", "sums"])

    return work


def _add_slices(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(sums, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
                                     names=["slice", "sums"])


def word_vectors(docs: DataFrame, text: str = "text", seed: int = 7) -> np.ndarray:
    """Float32 ``BUCKETS`` x ``2 DIM`` table learned from all rows; its size does not depend on them.

    Every task adds up what it reads; the sums meet in two steps, sixteen tasks a slice of the table and then one.
    """
    shape = "slice int, sums binary"
    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_context_sums(seed), shape)
    sums = sums.withColumn("salt", F.pmod(F.monotonically_increasing_id().bitwiseXOR(F.spark_partition_id()), F.lit(16)))
    sums = sums.repartition("slice", "salt").select("slice", "sums").mapInArrow(_add_slices, shape)
    sums = sums.repartition(SLICES, "slice").mapInArrow(_add_slices, shape)
    context = np.zeros((SLICES, BUCKETS // SLICES * DIM))
    for k, part in sums.collect():
        context[k] += np.frombuffer(part, np.int64)
    context = context.reshape(BUCKETS, DIM)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1.0)
    return np.hstack([index_vectors(seed), context]).astype(np.float32)


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each row's terms and marks; rows without any are zero."""
    out = np.zeros((len(column), vectors.shape[1]))
    many = np.zeros(len(column))
    for first, rows, bucket, row, mark, mark_row in terms(column):
        own = np.zeros((rows, vectors.shape[1]))
        for at in range(0, len(bucket), 1 << 15):
            r = row[at: at + (1 << 15)]
            head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            own[r[head]] += np.add.reduceat(vectors[bucket[at: at + (1 << 15)]], head, axis=0)
        own += np.bincount(mark_row * MARKS + mark, minlength=rows * MARKS).reshape(rows, MARKS) @ vectors[:MARKS]
        out[first: first + rows] = own
        many[first: first + rows] = np.bincount(row, minlength=rows)
    return out / np.maximum(many, 1.0)[:, None]


class Network:
    """Two layers over standardised features; probabilities divided by a temperature before the logistic."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 3):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.temperature = 1.0
        draw = np.random.default_rng(seed)
        order = draw.permutation(len(x))
        held, train = order[: len(x) // 4], order[len(x) // 4:]
        self.weights = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                        draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        moment = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        z, step = self._standard(x), 0
        for _ in range(epochs if len(train) else 0):
            for part in np.array_split(draw.permutation(train), max(1, len(train) // 128)):
                step += 1
                for k, g in enumerate(self._gradients(z[part], y[part])):
                    m = moment[k]
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - 0.003 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        if len(held):
            logits = self._logits(z[held])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 101))
            loss = [np.mean(np.logaddexp(0, -np.where(y[held] == 1, 1, -1) * logits / t)) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def _gradients(self, z: np.ndarray, y: np.ndarray, decay: float = 1e-3):
        w1, b1, w2, b2 = self.weights
        a = np.tanh(z @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(a @ w2 + b2[0], -30, 30))) - y) / len(y)
        back = np.outer(d, w2) * (1 - a * a)
        return z.T @ back + decay * w1, back.sum(0), a.T @ d + decay * w2, np.array([d.sum()])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(self._standard(x)) / self.temperature, -30, 30)))


class QualityModel:
    """Word vectors and network; ``score`` is a Column of a text Column, between 0 and 1, never null."""

    def __init__(self, spark, vectors: np.ndarray, network: Network | None, prior: float):
        self.shared = spark.sparkContext.broadcast((vectors, network, prior))

    def score(self, text):
        shared = self.shared

        @F.arrow_udf("double")
        def quality_score(column: pa.Array) -> pa.Array:
            vectors, network, prior = shared.value
            if network is None:
                return pa.array(np.full(len(column), prior))
            out = pa.array(network.predict(pool(column, vectors)))
            give_back()
            return out

        return quality_score(text.cast("string"))


def held_out(key: str):
    """Rows kept from learning: CRC-32 of the key as text is a multiple of five. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        max_rows: int = 20_000, seed: int = 7) -> QualityModel:
    """Learn from labelled rows outside the held-out fifth.

    Null keys, null labels and labels other than 0 and 1 are not learned from; of a key's repeated labels the largest
    counts. With one class or none there is no network: every score is the smoothed share of label 1.
    """
    vectors = word_vectors(docs, text, seed)
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter("k is not null and y in (0, 1)")
    known = known.filter(~held_out("k")).groupBy("k").agg(F.max("y").alias("y"))
    known = stage(known.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(max_rows), "labelled")
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(
        broadcast_if_small(known, 32), "k")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def work(batches):
        for batch in batches:
            x = pool(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in x], pa.binary())],
                                             names=["k", "y", "x"])

    from pyspark.sql import types as T
    shape = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("y", labels.schema[label].dataType),
                          T.StructField("x", T.BinaryType())])
    sample = rows.select("k", "y", "text").mapInArrow(work, shape).limit(2 * max_rows).toPandas()
    sample = pd.DataFrame(sample).sort_values(["k", "x"], kind="stable")
    y = sample["y"].to_numpy(float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    network = None
    if len(set(y)) == 2:
        network = Network(np.stack([np.frombuffer(v) for v in sample["x"]]), y)
    return QualityModel(docs.sparkSession, vectors, network, float(prior))


def scores(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(key, held_out, score, predicted)`` per row. Null and empty texts get the score of a document without terms."""
    return docs.select(F.col(key), held_out(key).alias("held_out"), model.score(F.col(text)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows whose score reaches the threshold, all columns as they are."""
    name = "quality_score"
    while name in map(str.lower, docs.columns):
        name = f"_{name}"
    return docs.withColumn(name, model.score(F.col(text))).filter(F.col(name) >= threshold).drop(name)
