"""Profiles, centroids and report aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.vectors import as_double
from .encoding import NUMERIC, finite_or_null
from .projections import edge_label
from ..staging import stage
from .ranks import exact_quantiles


def outlier_ratio(label: str = "y") -> Column:
    return F.sum(F.col(label).cast("double")) / F.count("*")


def column_ranges(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows ``(*by, column, min_value, max_value)`` over present, finite values, in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.min(finite_or_null(F.col(c).cast("double"))).alias("min_value"),
                      F.max(finite_or_null(F.col(c).cast("double"))).alias("max_value")) for c in cols]
    return df.groupBy(*by).agg(F.array(*parts).alias("s")).select(*by, F.inline("s"))


def profile_datasets(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str],
                     categorical: Sequence[str] = ()) -> DataFrame:
    """One row per dataset: samples, features, missing cells, classes, share of numeric columns, features per sample."""
    numeric = [c for c in features if c not in categorical and isinstance(df.schema[c].dataType, NUMERIC)]

    def absent(c):
        x = F.col(c)
        return x.isNull() | F.isnan(x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x.isNull()

    missing = sum((absent(c).cast("bigint") for c in features), F.lit(0).cast("bigint"))
    return df.groupBy(*by).agg(
        F.count("*").alias("num_samples"),
        F.lit(len(features)).alias("num_features"),
        F.sum(missing).alias("missing_values"),
        F.count_distinct(target).alias("num_classes"),
        F.lit(100.0 * len(numeric) / len(features)).alias("pct_numeric"),
        (F.lit(float(len(features))) / F.count("*")).alias("features_per_sample"),
    )


def best_score(results: DataFrame, by: Sequence[str], metric: str, lower_is_better: bool = False) -> DataFrame:
    return results.groupBy(*by).agg((F.min if lower_is_better else F.max)(metric).alias(metric))


def coverage(results: DataFrame, dataset: str = "dataset_name", model: str = "embedding_model",
             algorithm: str = "algorithm") -> DataFrame:
    """Per dataset: fewest and most distinct algorithms any model was run with, and whether they agree."""
    per_model = results.groupBy(dataset, model).agg(F.count_distinct(algorithm).alias("n"))
    return per_model.groupBy(dataset).agg(
        F.min("n").alias("min_unique_algorithms"), F.max("n").alias("max_unique_algorithms"),
    ).withColumn("equal", F.col("min_unique_algorithms") == F.col("max_unique_algorithms"))


def clean_results(results: DataFrame, dataset: str = "dataset_name") -> tuple[DataFrame, DataFrame]:
    """Result lines of evenly covered datasets, and the rejected dataset names."""
    table = coverage(results, dataset)
    kept = results.join(table.filter("equal").select(dataset), dataset, "left_semi")
    return kept, table.filter("not equal").select(dataset)


def _statistics(df: DataFrame, keys: Sequence[str], metric: str, time_col: str, dataset: str) -> DataFrame:
    keys = list(keys)
    df = stage(df.select(*keys, metric, time_col, dataset), "statistics")  # read by the aggregate and by the quantiles
    stats = df.groupBy(*keys).agg(
        F.avg(metric).alias(f"average_{metric}"), F.stddev_samp(metric).alias(f"std_{metric}"),
        F.min(metric).alias(f"min_{metric}"), F.max(metric).alias(f"max_{metric}"),
        F.avg(time_col).alias("averaged_embedding_compute_time"),
        F.count_distinct(dataset).alias("num_datasets"))
    middle = exact_quantiles(df, [metric], (0.5,), keys).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("q0").alias(f"median_{metric}"))
    same = None
    for k in keys:
        cond = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = cond if same is None else same & cond
    return stats.join(middle, same, "left").drop(*[f"_{k}" for k in keys])


def describe_results(df: DataFrame, metric: str, time_col: str = "time_to_compute_embedding",
                     dataset: str = "dataset_name") -> DataFrame:
    """Statistics of one metric per (model, algorithm), in report order."""
    return _statistics(df, ["embedding_model", "algorithm"], metric, time_col, dataset).orderBy(
        "embedding_model", "algorithm")


def describe_by_outlier_ratio(df: DataFrame, edges: Sequence[float], metric: str,
                              time_col: str = "time_to_compute_embedding", dataset: str = "dataset_name") -> DataFrame:
    binned = df.withColumn("outlier_ratio_bin_based", edge_label("outlier_ratio", edges))
    return _statistics(binned, ["embedding_model", "outlier_ratio_bin_based"], metric, time_col, dataset)


def vector_mean(vec: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(as_double(vec))))


def centroids(df: DataFrame, vec: str = "embedding", cluster: str = "cluster", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, cluster, centroid, n, weight)``; noise (-1) is left out, weight is the share of clustered rows."""
    keys = [*by, cluster]
    table = df.filter(F.col(cluster) != -1).groupBy(*keys).agg(vector_mean(vec).alias("centroid"), F.count("*").alias("n"))
    whole = W.partitionBy(*(by or [F.lit(0)]))
    return table.withColumn("weight", F.col("n") / F.sum("n").over(whole))


def cluster_mode(df: DataFrame, cluster: str = "cluster", max_clusters: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Clusters other than noise, and whether they are few enough to be used as classes."""
    n = F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster)))
    return df.groupBy(*by).agg(n.alias("n_clusters")).withColumn(
        "mode", F.when(F.col("n_clusters") <= max_clusters, F.lit("classification")).otherwise(F.lit("regression")))


def collection_limits(members: DataFrame, profile: DataFrame, on: str, collection: str = "collection") -> DataFrame:
    return members.join(profile, on).groupBy(collection).agg(
        F.max("num_samples").alias("max_samples"), F.max("num_features").alias("max_features"))


def trial_scores(folds: DataFrame, trial: str = "number", score: str = "score") -> DataFrame:
    return folds.groupBy(trial).agg(F.avg(score).alias("value"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The highest value; the earliest trial wins a tie."""
    order = F.struct("value", -F.col("number"))
    return trials.agg(F.max_by("number", order).alias("number"), F.max("value").alias("value"))
