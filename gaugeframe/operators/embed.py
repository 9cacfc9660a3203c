"""Embedding operators besides the sphere: views, targets, clusters, reductions, table vectoriser."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import IDF, PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions.hashing import gauss, gauss_matrix, uniform
from ..functions.vectors import as_double, map_vectors
from ..staging import stage
from .agglomerate import ward_labels
from .aggregates import centroids, vector_mean
from .blockwise import distance_summary, point_blocks, squared_distances
from .encoding import NUMERIC, epoch_seconds
from .joins import relabel
from .knn import knn_join
from .ranks import exact_quantiles

# ---- views -----------------------------------------------------------------------------------------------------


def aggregate_views(views: DataFrame, how: str, keys: Sequence[str] = ("row_id",), view: str = "view",
                    vec: str = "embedding") -> DataFrame:
    """Combine a row's views: ``mean``, ``first_element`` (lowest view) or ``concat`` (in view order)."""
    keys = list(keys)
    if how == "mean":
        return views.groupBy(*keys).agg(vector_mean(vec).alias(vec))
    if how == "first_element":
        return views.groupBy(*keys).agg(F.min_by(as_double(vec), view).alias(vec))
    if how == "concat":
        ordered = F.array_sort(F.collect_list(F.struct(F.col(view).alias("v"), as_double(vec).alias("e"))))
        return views.groupBy(*keys).agg(F.flatten(F.transform(ordered, lambda s: s["e"])).alias(vec))
    raise NotImplementedError(f"views are combined by mean, first_element or concat, not {how}")


# ---- auxiliary targets -----------------------------------------------------------------------------------------

DISCRETE = ("integers", "binomial", "poisson", "geometric")


def constant_target() -> Column:
    return F.lit(0.0)


def random_target(distribution: str, row_id: str, target: int = 0, seed: int = 42, *, low: int = 0, high: int = 10,
                  n: int = 10, p: float = 0.5, lam: float = 1.0) -> Column:
    """Keyed draw from a named distribution by inverse CDF; the same value on any partitioning."""
    u = uniform(seed, "target", target, F.col(row_id))
    if distribution == "standard_normal":
        return gauss(seed, "target", target, F.col(row_id))
    if distribution == "integers":
        return (F.lit(low) + F.floor(u * (high - low))).cast("double")
    if distribution == "geometric":
        return (F.floor(F.ln(u) / F.lit(math.log(1.0 - p))) + 1).cast("double")
    if distribution in ("binomial", "poisson"):
        if distribution == "binomial":
            mass = [math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)]
        else:
            mass = [math.exp(-lam + k * math.log(lam) - math.lgamma(k + 1)) for k in range(int(lam + 12 * math.sqrt(lam) + 30))]
        steps = F.lit([float(c) for c in np.cumsum(mass)[:-1]])
        # the draw is bound once, so it is not hashed again for every step
        return F.transform(F.array(u), lambda v: F.size(F.filter(steps, lambda c: v >= c)).cast("double"))[0]
    raise ValueError(f"no distribution '{distribution}'")


def random_targets(df: DataFrame, row_id: str, num_targets: int = 1, distribution: str = "standard_normal",
                   seed: int = 42, **kw) -> DataFrame:
    return df.withColumn("targets", F.array(*[random_target(distribution, row_id, t, seed, **kw)
                                              for t in range(num_targets)]))


# ---- clusters --------------------------------------------------------------------------------------------------


def fit_clusters(df: DataFrame, vec: str = "embedding", k: int = 10, seed: int = 42, bisecting: bool = False,
                 far_share: float = 0.0, out: str = "cluster") -> DataFrame:
    """Cluster label per row by (bisecting) k-means; with ``far_share`` the farthest rows of all become noise, -1."""
    vectors = df.withColumn("_vec", array_to_vector(as_double(vec)))
    estimator = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed, featuresCol="_vec", predictionCol=out)
    model = estimator.fit(vectors)
    labelled = model.transform(vectors).drop("_vec")
    if far_share <= 0:
        return labelled
    centres = np.array(model.clusterCenters())

    def farness(m: np.ndarray) -> np.ndarray:
        return np.concatenate([np.sqrt(d.min(axis=1, keepdims=True)) for _, d in squared_distances(m, centres)] or [np.zeros((0, 1))])

    measured = map_vectors(labelled, vec, "_far", farness).withColumn("_far", F.col("_far")[0])
    edge = exact_quantiles(measured, ["_far"], (1.0 - far_share,)).first()["q0"]
    return measured.withColumn(out, F.when(F.col("_far") > edge, F.lit(-1)).otherwise(F.col(out))).drop("_far")


def assign_clusters(train: DataFrame, new: DataFrame, row_id: str, vec: str, cluster: str = "cluster",
                    k: int = 15) -> DataFrame:
    """``(q, cluster)`` for new rows: distance-weighted vote of the ``k`` nearest train rows."""
    near = knn_join(new, train, k, query_id=row_id, query_vec=vec, train_id=row_id, train_vec=vec)
    labels = train.select(F.col(row_id).alias("t"), F.col(cluster).alias("label"))
    votes = near.join(labels, "t").groupBy("q", "label").agg(
        F.count_if(F.col("distance") == 0).alias("zero"), F.sum(F.try_divide(F.lit(1.0), F.col("distance"))).alias("w"))
    best = F.max_by("label", F.struct("zero", F.coalesce("w", F.lit(0.0)), -F.col("label")))
    return votes.groupBy("q").agg(best.alias(cluster))


def merge_clusters(df: DataFrame, vec: str = "embedding", cluster: str = "cluster", max_clusters: int = 10, out: str = "merged") -> DataFrame:
    """Relabel so that at most ``max_clusters`` remain, merging centroids by Ward's criterion; noise stays -1.

    Any number of centroids is merged by rounds of joins on the cluster; none of them comes to the driver.
    """
    table = stage(centroids(df, vec, cluster).select(F.col(cluster).cast("long").alias("_c"), "centroid"), "centroids")
    if table.count() <= max_clusters:
        return df.withColumn(out, F.col(cluster))
    labels = ward_labels(table, "_c", "centroid", max_clusters, out).select(F.col("_c").cast("int").alias(cluster), out)
    return relabel(df.withColumn(cluster, F.col(cluster).cast("int")), labels, cluster, out)


def cluster_distance_targets(train: DataFrame, df: DataFrame, metrics: Sequence[str] = ("min",),
                             vec: str = "embedding", cluster: str = "cluster", out: str = "targets") -> DataFrame:
    """Targets from the distances of a row to the train centroids: minus the smallest, minus the size-weighted mean,
    population deviation; the chosen ones as one vector in that order."""
    names = [next(f"_{n}{i}" for i in range(len(df.columns) + 1) if f"_{n}{i}" not in df.columns) for n in ("least", "weighted", "deviation")]
    parts = {"min": -F.col(names[0]), "mean": -F.col(names[1]), "std": F.col(names[2])}
    unknown = [m for m in metrics if m not in parts]
    if unknown:
        raise ValueError(f"unknown distance metrics {unknown}")
    blocks = point_blocks(centroids(train, vec, cluster).select(F.col(cluster).alias("_c"), "centroid", "weight"), "_c", "centroid", ["weight"])
    return distance_summary(df, vec, blocks, names).select(*df.columns, F.array(*[parts[m] for m in ("min", "mean", "std") if m in metrics]).alias(out))


# ---- pooled collections ----------------------------------------------------------------------------------------


def pool_embeddings(parts: Sequence[DataFrame], vec: str = "embedding", label: str = "label") -> DataFrame:
    """Stack embeddings of several datasets; the label is the dataset's position."""
    from .admission import require_valid_embeddings
    pooled = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                    [p.withColumn(label, F.lit(i)) for i, p in enumerate(parts)])
    return require_valid_embeddings(pooled, vec)


# ---- reductions ------------------------------------------------------------------------------------------------


def reduce_pca(df: DataFrame, vec: str = "embedding", k: int = 2, out: str = "reduced") -> DataFrame:
    """Principal component scores of the centred vectors; the largest loading of each component is positive."""
    data = df.select(array_to_vector(as_double(vec)).alias("_vec"))
    pc = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(data).pc.toArray()
    pc = pc * np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(k)])
    mean = np.array(df.agg(vector_mean(vec)).first()[0])
    return map_vectors(df, vec, out, lambda m: (m - mean) @ pc)


def fourier_map(dim: int, features: int, gamma: float, seed: int = 42):
    """Random Fourier features whose inner products approximate exp(-gamma |x - y|^2)."""
    w = gauss_matrix(dim, features, "fourier", seed) * math.sqrt(2.0 * gamma)
    b = np.random.Generator(np.random.PCG64(seed + 1)).uniform(0.0, 2.0 * math.pi, features)
    scale = math.sqrt(2.0 / features)
    return lambda m: scale * np.cos(m @ w + b)


def reduce_kernel_pca(df: DataFrame, vec: str = "embedding", k: int = 2, gamma: float | None = None,
                      features: int = 256, seed: int = 42, out: str = "reduced") -> DataFrame:
    """RBF-kernel components through random Fourier features; ``gamma`` defaults to 1 / dimension."""
    dim = df.agg(F.max(F.size(vec))).first()[0]
    mapped = map_vectors(df, vec, "_fourier", fourier_map(dim, features, gamma or 1.0 / dim, seed))
    return reduce_pca(mapped, "_fourier", k, out).drop("_fourier")


# ---- table vectoriser ------------------------------------------------------------------------------------------

LOW_CARDINALITY = 40  # fixed value: text columns up to this many values are one-hot encoded
TEXT_COMPONENTS = 30  # fixed value: components kept from a high-cardinality text column


TRIGRAM_CHARS, TRIGRAM_ROWS = 1 << 20, 1000  # texts counted at once: characters and rows
TRIGRAM_TABLE = 1 << 22  # alphabets with up to so many possible trigrams are counted through a table


def with_trigrams(df: DataFrame, col: str, out: str, size: int) -> DataFrame:
    """Sparse counts of the lower-cased text's character trigrams, hashed into ``size`` slots; the whole text counts. The slots are
    those of Spark ML's ``NGram`` and ``HashingTF``, without an object per character and trigram."""
    @F.arrow_udf(VectorUDT())
    def counted(texts: pa.Array) -> pa.Array:
        parts = [_trigram_counts(some, size) for some in _runs(texts.to_pylist())]
        many, slots, counts = (np.concatenate(c) for c in zip(*parts))
        starts = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        n = len(texts)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), pa.ListArray.from_arrays(starts, pa.array(slots.astype(np.int32))),
             pa.ListArray.from_arrays(starts, pa.array(counts.astype(float)))], names=["type", "size", "indices", "values"])

    return df.withColumn(out, counted(F.make_valid_utf8(F.lower(F.coalesce(F.col(col).cast("string"), F.lit(""))))))


def _runs(texts: list[str]) -> list[list[str]]:
    """Texts in their order, in runs of bounded length; a longer text is a run of its own."""
    runs, held, chars = [], [], 0
    for text in texts:
        if held and (len(held) >= TRIGRAM_ROWS or chars + len(text) > TRIGRAM_CHARS):
            runs.append(held)
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    return runs + [held]


def _trigram_counts(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many slots each text fills; and of all texts one after the other, the slots in ascending order and their counts."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    points, total = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), np.zeros(len(texts) * size, dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), length)
    for at in range(0, len(points) - 2, TRIGRAM_CHARS):  # a long text goes through in pieces that share two characters
        chars, own = points[at: at + TRIGRAM_CHARS + 2], row[at: at + TRIGRAM_CHARS + 2]
        alphabet = np.unique(chars)
        code = np.zeros(int(alphabet[-1]) + 1, dtype=np.int64)
        code[alphabet] = np.arange(len(alphabet))
        code = code[chars]
        whole = own[:-2] == own[2:]
        grams, many = ((code[:-2] * len(alphabet) + code[1:-1]) * len(alphabet) + code[2:])[whole], len(alphabet) ** 3
        if many <= TRIGRAM_TABLE:
            found, slot_of = np.flatnonzero(np.bincount(grams, minlength=many)), np.zeros(many, dtype=np.int64)
            slot_of[found] = _trigram_slots(alphabet, found, size)
            slot = slot_of[grams]
        else:
            found, place = np.unique(grams, return_inverse=True)
            slot = _trigram_slots(alphabet, found, size)[place]
        total += np.bincount(own[:-2][whole] * size + slot, minlength=len(total))
    filled = np.flatnonzero(total)
    return np.bincount(filled // size, minlength=len(texts)), filled % size, total[filled]


def _trigram_slots(alphabet: np.ndarray, grams: np.ndarray, size: int) -> np.ndarray:
    """Slots of trigrams given by places in the alphabet: Murmur3 of their characters in UTF-8, a space between, seed 42."""
    n = len(alphabet)
    words = [f"{chr(a)} {chr(b)} {chr(c)}".encode() for a, b, c in zip(*(alphabet[i].tolist() for i in (grams // (n * n), grams // n % n, grams % n)))]
    length = np.array([len(w) for w in words], dtype=np.uint32)
    turned = lambda v, by: v << np.uint32(by) | v >> np.uint32(32 - by)
    h = np.full(len(words), 42, dtype=np.uint32)
    for k, block in enumerate(np.frombuffer(b"".join(w.ljust(16, b"\0") for w in words), dtype="<u4").reshape(-1, 4).T):
        mixed = h ^ turned(block * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = np.where(length >= 4 * k + 4, turned(mixed, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(length > 4 * k, mixed, h))
    h ^= length
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return (h ^ h >> np.uint32(16)).view(np.int32).astype(np.int64) % size


def _trigram_shares(texts: pd.Series, size: int) -> np.ndarray:
    """Shares of the lower-cased texts' character trigrams in ``size`` slots, a row per text; all texts in one go."""
    texts = texts.str.lower()
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = texts.str.len().to_numpy(dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), length)
    mixed = (chars[:-2] * np.uint64(0x9E3779B1) + chars[1:-1]) * np.uint64(0x85EBCA77) + chars[2:]
    mixed ^= mixed >> np.uint64(29)
    whole = row[:-2] == row[2:]
    slot = row[:-2][whole] * size + (mixed[whole] % np.uint64(size)).astype(np.int64)
    counts = np.bincount(slot, minlength=len(texts) * size).reshape(len(texts), size)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def hashed_table_vectors(df: DataFrame, columns: Sequence[str], components: int = TEXT_COMPONENTS, hash_size: int = 1024,
                         seed: int = 42, out: str = "embedding") -> DataFrame:
    """Vectors of mixed tables without fitted state: numbers pass, dates unfold, and every text column becomes ``components``
    random projections of its trigram shares. A row's vector depends on the row alone, so nothing can leak between
    datasets, folds or train and test rows."""
    prepared = TableVectorizer(columns)._prepared(df)
    made = [c for c in prepared.columns if c not in df.columns]
    text = [c for c in made if c.startswith("_t_")]
    project = gauss_matrix(hash_size, components, "trigrams", seed) / math.sqrt(components)

    @pandas_udf("array<double>")
    def projected(texts: pd.Series) -> pd.Series:
        parts = [_trigram_shares(texts.iloc[at:at + 1000], hash_size) @ project for at in range(0, len(texts), 1000)]
        return pd.Series([row for part in parts for row in part])

    prepared = prepared.withColumns({f"{c}_v": projected(F.col(c)) for c in text})
    numbers = [F.col(c) for c in made if c not in text]
    parts = ([F.array(*numbers)] if numbers else []) + [F.col(f"{c}_v") for c in text]
    return prepared.select(*df.columns, F.concat(*parts).alias(out))


class TableVectorizer:
    """Type-dispatched vectors: numbers pass, dates unfold, few-valued text is one-hot, other text becomes the leading
    components of its character-trigram weights."""

    def __init__(self, columns: Sequence[str], low_cardinality: int = LOW_CARDINALITY, hash_size: int = 1024,
                 components: int = TEXT_COMPONENTS):
        self.columns, self.low, self.hash_size, self.components = list(columns), low_cardinality, hash_size, components
        self.model: PipelineModel | None = None
        self.hashed: list[str] = []

    def _prepared(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c in self.columns:
            dtype = df.schema[c].dataType
            if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                for part, f in (("year", F.year), ("month", F.month), ("day", F.day), ("hour", F.hour)):
                    cols[f"_d_{c}_{part}"] = F.coalesce(f(F.col(c)).cast("double"), F.lit(0.0))
                cols[f"_d_{c}_total"] = F.coalesce(epoch_seconds(c, dtype), F.lit(0.0))
            elif isinstance(dtype, NUMERIC):
                cols[f"_n_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            else:
                cols[f"_t_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return df.withColumns(cols)

    def _with_counts(self, ready: DataFrame) -> DataFrame:
        for c in self.hashed:
            ready = with_trigrams(ready, c, f"{c}_h", self.hash_size).drop(c)
        return ready

    def _many_valued(self, ready: DataFrame, text: list[str]) -> list[str]:
        """Text columns with more than ``low`` values. As many hashes are as many values at least, so texts move only where those are few."""
        def over(columns, of):
            n = ready.agg(*[F.count_distinct(of(c)).alias(c) for c in columns]).first() if columns else {}
            return {c for c in columns if n[c] > self.low}

        many = over(text, F.xxhash64)
        many |= over([c for c in text if c not in many], F.col)
        return [c for c in text if c in many]

    def fit(self, df: DataFrame) -> TableVectorizer:
        ready = self._prepared(df)
        made = [c for c in ready.columns if c not in df.columns]
        text = [c for c in made if c.startswith("_t_")]
        self.hashed = self._many_valued(ready, text)
        stages, parts = [], [c for c in made if not c.startswith("_t_")]
        for c in text:
            if c in self.hashed:
                stages += [IDF(inputCol=f"{c}_h", outputCol=f"{c}_w"),
                           PCA(k=min(self.components, self.hash_size), inputCol=f"{c}_w", outputCol=f"{c}_v")]
            else:
                stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep", stringOrderType="alphabetAsc"),
                           OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v", dropLast=True, handleInvalid="keep")]
            parts.append(f"{c}_v")
        stages.append(VectorAssembler(inputCols=parts, outputCol="_all"))
        fitted_on = self._with_counts(ready)
        if self.hashed:
            fitted_on = stage(fitted_on.select(*[c for c in fitted_on.columns if c in made or c.endswith("_h")]), "trigrams")
        self.model = Pipeline(stages=stages).fit(fitted_on)
        return self

    def transform(self, df: DataFrame, out: str = "embedding") -> DataFrame:
        if self.model is None:
            raise ValueError("Model is not fitted.")
        res = self.model.transform(self._with_counts(self._prepared(df)))
        return res.select(*df.columns, vector_to_array("_all").alias(out))
