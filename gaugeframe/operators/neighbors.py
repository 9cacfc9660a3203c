"""Evaluators built on the k-nearest-neighbour join."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import as_double
from ..staging import stage
from .knn import fold_join, fold_neighbours, knn_join, plain_rows
from .metrics import f1_from_counts

WEIGHTS = ("uniform", "distance")


def _weight_sums(weights: str) -> tuple[Column, Column]:
    """(count of zero distances, weight of the others); a zero distance takes all the weight."""
    if weights not in WEIGHTS:
        raise ValueError(f"unknown weights {weights!r}; one of {WEIGHTS}")
    if weights == "uniform":
        return F.lit(0).cast("bigint"), F.count("*").cast("double")
    return F.count_if(F.col("distance") == 0), F.coalesce(F.sum(F.try_divide(F.lit(1.0), F.col("distance"))), F.lit(0.0))


def vote(near: DataFrame, labels: DataFrame, num_classes: int, weights: str = "uniform",
         by: Sequence[str] = ()) -> DataFrame:
    """``(*by, q, proba, prediction)`` from neighbour rows and ``(*by, t, label)``."""
    by = list(by)
    zero, w = _weight_sums(weights)
    per = near.join(labels, by + ["t"]).groupBy(*by, "q", "label").agg(zero.alias("zero"), w.alias("w"))
    entries = F.map_from_entries(F.collect_list(F.struct("label", F.struct("zero", "w"))))
    got = per.groupBy(*by, "q").agg(entries.alias("e"), F.sum("zero").alias("zeros"), F.sum("w").alias("total"))
    share = lambda c: F.when(F.col("zeros") > 0, F.coalesce(F.try_element_at("e", c)["zero"], F.lit(0)) / F.col("zeros")) \
        .otherwise(F.coalesce(F.try_element_at("e", c)["w"], F.lit(0.0)) / F.col("total"))
    proba = F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), share)
    got = got.select(*by, "q", proba.alias("proba"))
    return got.withColumn("prediction", (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))


def knn_classify(train: DataFrame, test: DataFrame, num_classes: int, k: int = 5, weights: str = "uniform",
                 metric: str = "euclidean", *, row_id: str = "row_id", vec: str = "embedding", label: str = "y",
                 by: Sequence[str] = (), **join) -> DataFrame:
    """Class probabilities of the test rows; labels are codes 0 … num_classes-1."""
    near = knn_join(test, train, k, query_id=row_id, query_vec=vec, train_id=row_id, train_vec=vec, metric=metric,
                    by=by, **join)
    labels = train.select(*by, F.col(row_id).alias("t"), F.col(label).cast("int").alias("label"))
    return vote(near, labels, num_classes, weights, by).withColumnRenamed("q", row_id)


def knn_regress(train: DataFrame, test: DataFrame, k: int = 5, weights: str = "uniform", metric: str = "euclidean", *,
                row_id: str = "row_id", vec: str = "embedding", target: str = "y", by: Sequence[str] = (),
                **join) -> DataFrame:
    """Weighted mean target of the nearest train rows."""
    by = list(by)
    near = knn_join(test, train, k, query_id=row_id, query_vec=vec, train_id=row_id, train_vec=vec, metric=metric,
                    by=by, **join)
    values = train.select(*by, F.col(row_id).alias("t"), F.col(target).cast("double").alias("_y"))
    rows = near.join(values, by + ["t"])
    if weights not in WEIGHTS:
        raise ValueError(f"unknown weights {weights!r}; one of {WEIGHTS}")
    if weights == "uniform":
        pred = F.avg("_y")
    else:
        inv = F.try_divide(F.lit(1.0), F.col("distance"))
        pred = F.when(F.count_if(F.col("distance") == 0) > 0, F.avg(F.when(F.col("distance") == 0, F.col("_y")))) \
            .otherwise(F.sum(inv * F.col("_y")) / F.sum(inv))
    return rows.groupBy(*by, F.col("q").alias(row_id)).agg(pred.alias("prediction"))


def local_outlier_factor(df: DataFrame, k: int = 20, metric: str = "euclidean", *, row_id: str = "row_id",
                         vec: str = "embedding", by: Sequence[str] = (), out: str = "prediction", **join) -> DataFrame:
    """``(*by, row_id, prediction)``: local outlier factor, higher is more outlying.

    The neighbour table is computed once and staged; densities travel to it by key.
    """
    by = list(by)
    near = stage(knn_join(df, df, k, query_id=row_id, query_vec=vec, train_id=row_id, train_vec=vec, metric=metric,
                          by=by, exclude_self=True, **join), "lof-near")
    reach = near.groupBy(*by, "q").agg(F.max("distance").alias("k_distance"))
    far = near.join(reach.withColumnRenamed("q", "t"), by + ["t"])
    density = far.groupBy(*by, "q").agg(
        (F.lit(1.0) / (F.avg(F.greatest("distance", "k_distance")) + F.lit(1e-10))).alias("lrd"))
    density = stage(density, "lof-density")
    around = near.join(density.select(*by, F.col("q").alias("t"), F.col("lrd").alias("lrd_t")), by + ["t"])
    mean = around.groupBy(*by, "q").agg(F.avg("lrd_t").alias("m"))
    return mean.join(density, by + ["q"]).select(*by, F.col("q").alias(row_id), (F.col("m") / F.col("lrd")).alias(out))


def knn_grid(df: DataFrame, num_classes: int, *, ks: Sequence[int] = tuple(range(5, 101, 5)),
             weights: Sequence[str] = WEIGHTS, metrics: Sequence[str] = ("euclidean", "manhattan", "cosine"),
             row_id: str = "row_id", vec: str = "embedding", label: str = "y", fold: str = "fold", folds: int = 5) -> DataFrame:
    """``(metric, weights, k, fold, f1_weighted)`` for a whole neighbour grid.

    One join per metric serves all folds (a row meets those of other folds) and every ``k`` and weighting: each is
    a prefix of the same sorted neighbours. Tasks emit confusion counts only. Where ids are known and differ, a query's neighbours stay with it
    and bring their labels; else labels are joined.
    """
    labels = df.select(F.col(row_id).alias("t"), F.col(label).cast("int").alias("label"))
    truth = df.select(F.col(row_id).alias("q"), F.col(label).cast("int").alias("y"))
    ks, weights = sorted(ks), list(weights)
    schema = "_run int, weights string, k int, y int, prediction int, n bigint"

    def tally(batches):
        for pdf in batches:
            found = []
            for (run, many), part in pdf.groupby(["run", pdf["labels"].map(len)], sort=False):
                at = np.minimum(np.array(ks), many) - 1
                for a in range(0, len(part), 1000):
                    cut = part.iloc[a:a + 1000]
                    lab, dist, y = np.stack(cut["labels"]), np.stack(cut["distances"]), cut["y"].to_numpy()
                    hot = lab[:, :, None] == np.arange(num_classes)
                    with np.errstate(divide="ignore"):
                        near = np.where(dist[:, :1] == 0, (dist == 0).astype(float), 1.0 / np.where(dist == 0, 1.0, dist))
                    for name in weights:
                        w = np.ones_like(dist) if name == "uniform" else near
                        best = np.cumsum(hot * w[:, :, None], axis=1)[:, at].argmax(axis=2)
                        found += [pd.DataFrame({"_run": run, "weights": name, "k": k, "y": y, "prediction": best[:, j]}) for j, k in enumerate(ks)]
            if found:
                table = pd.concat(found)
                yield table.groupby(list(table.columns), as_index=False).size().rename(columns={"size": "n"})

    def scored(rows: DataFrame, metric: str) -> DataFrame:
        counts = rows.mapInPandas(tally, schema).groupBy("_run", "weights", "k", "y", "prediction").agg(F.sum("n").alias("n"))
        return f1_from_counts(counts, ["_run", "weights", "k"]).withColumn("metric", F.lit(metric))

    plain = plain_rows(df.select(F.col(row_id).alias("q"), as_double(vec).alias("qv")), [], "q", "qv") and not truth.filter("y is null").head(1)
    frames = []
    for metric in metrics:
        if plain:
            rows = fold_neighbours(df, ks[-1], row_id=row_id, vec=vec, label=label, fold=fold, folds=folds, metric=metric)
            frames.append(scored(rows, metric))
            continue
        near = fold_join(df, ks[-1], row_id=row_id, vec=vec, fold=fold, folds=folds, metric=metric)
        rows = near.join(labels, "t").groupBy("_run", "q").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "distance", "label"))),
            lambda s: F.struct(s["distance"].alias("distance"), s["label"].alias("label"))).alias("near"))
        rows = rows.join(truth, "q").select(F.col("_run").alias("run"), "y", F.col("near.label").alias("labels"), F.col("near.distance").alias("distances"))
        frames.append(scored(rows, metric))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("metric", "weights", "k", F.col("_run").alias("fold"), "f1_weighted")
