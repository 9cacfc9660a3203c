"""Outlier scores: isolation forest and distance to the centre. Higher is more outlying."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions.hashing import uniform, uniform_py
from ..functions.vectors import as_double, stack_vectors
from ..staging import stage
from .embed import fourier_map
from .ranks import exact_quantiles

EULER = 0.5772156649015329  # fixed value: Euler-Mascheroni constant
_TREE = "feature array<int>, threshold array<double>, left array<int>, right array<int>, depth array<double>"


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points; 0 for one, 1 for two."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + EULER) - 2.0 * (m - 1.0) / m, out)


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    """Random splits on varying features until a point is alone or the depth limit is reached."""
    feature, threshold, left, right, depth = [], [], [], [], []

    def node():
        for lst, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (depth, 0.0)):
            lst.append(v)
        return len(feature) - 1

    todo = [(node(), np.arange(len(x)), 0)]
    while todo:
        at, rows, level = todo.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        open_cols = np.flatnonzero(hi > lo)
        if level >= limit or len(rows) <= 1 or not len(open_cols):
            depth[at] = level + float(expected_path(len(rows)))
            continue
        f = int(open_cols[rng.integers(len(open_cols))])
        cut = float(rng.uniform(lo[f], hi[f]))
        goes = x[rows, f] <= cut
        feature[at], threshold[at] = f, cut
        left[at], right[at] = node(), node()
        todo += [(left[at], rows[goes], level + 1), (right[at], rows[~goes], level + 1)]
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "depth": depth}


def tree_samples(df: DataFrame, row_id: str, trees: int, max_samples: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, tree, …row)``: up to ``max_samples`` distinct rows per tree and group.

    A row is a candidate of each tree with the same small chance: the wanted rows and eight standard deviations more, of the
    group's rows. It does not try every tree but draws how many trees to skip until the next one that takes it, so
    most rows of a large table cost one draw and go nowhere. Each tree keeps the candidates with its smallest keyed draws.
    """
    by = list(by)
    sizes = stage(df.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")
    base = df.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, by) if by else df.withColumn("_n", F.lit(sizes.first()[0]))
    margin = float(max_samples + 8 * math.sqrt(max_samples) + 16)
    chance = F.least(F.lit(1.0), F.lit(margin) / F.col("_n"))
    skipped = F.when(chance >= 1, F.lit(0.0)).otherwise(F.floor(F.ln(uniform(seed, "skip", 0, F.col(row_id))) / F.ln(F.lit(1.0) - chance)))
    taken = base.withColumns({"_first": skipped, "_chance": chance, "_id": F.col(row_id).cast("string")}).filter(F.col("_first") < trees).drop("_n")
    kept = [c for c in taken.columns if c not in ("_first", "_chance", "_id")]
    schema = T.StructType([*[taken.schema[c] for c in kept], T.StructField("tree", T.IntegerType()), T.StructField("_u", T.DoubleType())])

    def draw(batches):
        for batch in batches:
            rows, tree, place = [], [], []
            for row, (first, share, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_first", "_chance", "_id")))):
                at, draws = int(first), 0
                while at < trees:
                    rows.append(row)
                    tree.append(at)
                    place.append(uniform_py(seed, "place", at, name))
                    draws += 1
                    at += 1 + (0 if share >= 1 else math.floor(math.log(uniform_py(seed, "skip", draws, name)) / math.log(1.0 - share)))
            taken = batch.select(kept).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tree, pa.int32()), pa.array(place, pa.float64())], names=schema.names)

    w = W.partitionBy(*by, "tree").orderBy("_u", row_id)
    drawn = taken.mapInArrow(draw, schema)
    return drawn.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max_samples).drop("_u")


def fit_forest(df: DataFrame, vec: str = "embedding", row_id: str = "row_id", trees: int = 100, max_samples: int = 256,
               seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """One row per tree: its arrays and the number of rows it was grown on. Trees grow in parallel."""
    by = list(by)
    slim = df.select(*by, row_id, as_double(vec).alias("_v"))
    drawn = tree_samples(slim, row_id, trees, max_samples, seed, by)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.Generator(np.random.PCG64(int(uniform_py(seed, "tree", tree) * 2 ** 32)))
        limit = int(math.ceil(math.log2(max(len(pdf), 2))))
        grown = grow_tree(stack_vectors(pdf["_v"]), rng, limit)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "tree": tree, "rows": len(pdf), **grown}])

    fields = [df.schema[c] for c in by] + [T.StructField("tree", T.IntegerType()), T.StructField("rows", T.IntegerType())]
    schema = T.StructType(fields + list(T._parse_datatype_string(_TREE)))
    return drawn.groupBy(*by, "tree").applyInPandas(grow, schema)


def _forest_scores(forest: list[dict], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            f = t["feature"][at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            here = at[inner]
            goes = x[inner, f[inner]] <= t["threshold"][here]
            at[inner] = np.where(goes, t["left"][here], t["right"][here])
        total += t["depth"][at]
    c = float(expected_path(max(t["rows"] for t in forest)))
    return np.power(2.0, -(total / len(forest)) / c) if c else np.ones(len(x)) * 0.5


def _unpack(rows) -> list[dict]:
    kinds = {"feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "depth": float}
    return [{**{k: np.asarray(r[k], dtype=d) for k, d in kinds.items()}, "rows": r["rows"]} for r in rows]


def isolation_forest(df: DataFrame, vec: str = "embedding", row_id: str = "row_id", trees: int = 100,
                     max_samples: int = 256, contamination: float | None = None, seed: int = 42,
                     by: Sequence[str] = (), out: str = "prediction", slice_rows: int = 100_000) -> DataFrame:
    """``(*by, row_id, prediction)``: 2^(-mean path / c) minus 0.5, or minus the quantile that leaves the given
    contamination above zero.

    A forest is at most ``trees`` x 2 ``max_samples`` nodes. Without ``by`` the one forest is broadcast; with it every
    dataset's rows are cut into slices of about ``slice_rows`` and each slice meets a copy of its dataset's forest, so the
    table is scored in one scan however many datasets it holds.
    """
    by = list(by)
    if contamination is not None and not 0 < contamination <= 0.5:
        raise ValueError(f"contamination {contamination} is not above 0 and at most 0.5")
    model = stage(fit_forest(df, vec, row_id, trees, max_samples, seed, by), "forest")
    slim = df.select(*by, row_id, as_double(vec).alias("_v"))
    schema = T.StructType([df.schema[c] for c in by] + [df.schema[row_id], T.StructField(out, T.DoubleType())])

    if not by:
        shared = df.sparkSession.sparkContext.broadcast(_unpack(model.collect()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = pdf[[row_id]].copy()
                got[out] = _forest_scores(shared.value, stack_vectors(pdf["_v"])) - 0.5
                yield got

        scored = slim.mapInPandas(run, schema)
    else:
        def meet(rows: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
            got = rows[[*by, row_id]].copy()
            if len(rows):
                got[out] = _forest_scores(_unpack(forest.to_dict("records")), stack_vectors(rows["_v"])) - 0.5
            return got.reindex(columns=[*by, row_id, out])

        slices = stage(df.groupBy(*by).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("_slices")), "forest-slices")
        rows = slim.join(slices, by).withColumn("_slice", F.pmod(F.xxhash64(row_id), F.col("_slices")).cast("int")).drop("_slices")
        copies = model.join(slices, by).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
        scored = rows.groupBy(*by, "_slice").cogroup(copies.groupBy(*by, "_slice")).applyInPandas(meet, schema)
    if contamination is None:
        return scored
    scored = stage(scored, "forest-scores")
    edge = exact_quantiles(scored, [out], (1.0 - contamination,), by).drop("column")
    if not by:
        return scored.withColumn(out, F.col(out) - F.lit(edge.first()["q0"]))
    return scored.join(edge, by).withColumn(out, F.col(out) - F.col("q0")).drop("q0")


def _fourier_distance(rows: DataFrame, by: list[str], row_id: str, features: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """Squared distance of every row's features to their mean. The features never leave a worker: the first pass returns a sum per
    batch and group, the second one number per row."""
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                code = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(pdf), dtype=np.int64)
                first = np.unique(code, return_index=True)[1]
                total, mapped = [], features(stack_vectors(pdf["_z"]))
                for c in range(len(first)):
                    total.append(mapped[code == c].sum(axis=0) if len(first) > 1 else mapped.sum(axis=0))
                yield pdf.iloc[first][by].reset_index(drop=True).assign(_sum=total, _n=np.bincount(code).astype(float))

    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField("_sum", T.ArrayType(T.DoubleType())), T.StructField("_n", T.DoubleType())])
    centre = rows.select(*by, "_z").mapInPandas(sums, schema).groupBy(*by).agg(
        vector_to_array(Summarizer.sum(array_to_vector("_sum"))).alias("_c"), F.sum("_n").alias("_n"))
    centre = centre.select(*by, F.transform("_c", lambda x: x / F.col("_n")).alias("_c"))
    if by:
        @pandas_udf("double")
        def far(z: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(((features(stack_vectors(z)) - stack_vectors(c)) ** 2).sum(axis=1) if len(z) else [], dtype=float)

        return rows.join(centre, by).select(*by, row_id, far("_z", "_c").alias(out))
    middle = np.array(centre.first()["_c"])

    @pandas_udf("double")
    def gap(z: pd.Series) -> pd.Series:
        return pd.Series(((features(stack_vectors(z)) - middle) ** 2).sum(axis=1) if len(z) else [], dtype=float)

    return rows.select(row_id, gap("_z").alias(out))


def centre_distance(df: DataFrame, vec: str = "embedding", row_id: str = "row_id", contamination: float = 0.1,
                    fourier: int | None = None, gamma: float | None = None, seed: int = 42, by: Sequence[str] = (),
                    out: str = "prediction") -> DataFrame:
    """``(*by, row_id, prediction, is_outlier)``: squared distance of the standardised (optionally Fourier-mapped) row
    to the centre; rows beyond the ``1 - contamination`` quantile are marked."""
    if not 0 <= contamination <= 0.5:
        raise ValueError(f"contamination {contamination} is not between 0 and 0.5")
    by = list(by)
    base = df.select(*by, row_id, as_double(vec).alias("_v"))
    summary = base.groupBy(*by).agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("_v")).alias("s"))
    summary = summary.select(*by, vector_to_array("s.mean").alias("_m"), vector_to_array("s.variance").alias("_var"),
                             F.col("s.count").cast("double").alias("_n"))
    scale = F.transform("_var", lambda v: F.coalesce(
        F.nullif(F.sqrt(v * (F.col("_n") - 1) / F.col("_n")), F.lit(0.0)), F.lit(1.0)))
    summary = summary.withColumn("_s", scale).select(*by, "_m", "_s")
    if by:
        rows = base.join(stage(summary, "centre"), by)
    else:
        s = summary.first()
        rows = base.withColumn("_m", F.lit(list(s["_m"]))).withColumn("_s", F.lit(list(s["_s"])))
    z = F.transform("_v", lambda x, i: (x - F.col("_m")[i]) / F.col("_s")[i])
    if fourier is None:
        scored = rows.select(*by, row_id, F.aggregate(z, F.lit(0.0), lambda a, x: a + x * x).alias(out))
    else:
        rows = rows.select(*by, row_id, z.alias("_z"))
        dim = rows.agg(F.max(F.size("_z"))).first()[0] if by else len(s["_m"])
        scored = _fourier_distance(rows, by, row_id, fourier_map(dim, fourier, gamma or 1.0 / dim, seed), out)
    scored = stage(scored, "centre-scores")
    edge = exact_quantiles(scored, [out], (1.0 - contamination,), by).drop("column")
    if not by:
        return scored.withColumn("is_outlier", (F.col(out) > F.lit(edge.first()["q0"])).cast("int"))
    return scored.join(edge, by).withColumn("is_outlier", (F.col(out) > F.col("q0")).cast("int")).drop("q0")
