"""Relational joins of the evaluation flow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .admission import model_fits


def work_plan(profile: DataFrame, models: Sequence[Mapping], evaluators: Sequence[Mapping]) -> DataFrame:
    """Dataset x model x evaluator lines that can run.

    ``profile`` has ``task_type, num_samples, num_features``; a model is ``{name, max_samples, max_features}``, an
    evaluator ``{name, task_types}``. Both lists are configuration, so each dataset row simply unfolds them.
    """
    def struct(m):
        return F.struct(F.lit(m["name"]).alias("name"),
                        F.lit(m.get("max_samples")).cast("bigint").alias("max_samples"),
                        F.lit(m.get("max_features")).cast("bigint").alias("max_features"))

    def task(e):
        types = [e["task_types"]] if isinstance(e["task_types"], str) else list(e["task_types"])
        return F.struct(F.lit(e["name"]).alias("name"), F.array(*map(F.lit, types)).alias("task_types"))

    plan = profile.withColumn("_m", F.explode(F.array(*map(struct, models))))
    plan = plan.filter(model_fits(F.col("_m.max_samples"), F.col("_m.max_features")))
    plan = plan.withColumn("_e", F.explode(F.array(*map(task, evaluators))))
    plan = plan.filter(F.array_contains(F.col("_e.task_types"), F.col("task_type")))
    return plan.select("*", F.col("_m.name").alias("embedding_model"), F.col("_e.name").alias("algorithm")).drop("_m", "_e")


def join_truth(predictions: DataFrame, truth: DataFrame, keys: Sequence[str] = ("dataset", "row_id")) -> DataFrame:
    return predictions.join(truth, list(keys))


def lookup_vectors(df: DataFrame, points: DataFrame, col: str, dim: int, out: str = "vector") -> DataFrame:
    """Category -> vector; a missing or unknown category gets zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return df.join(points, col, "left").withColumn(out, F.coalesce(F.col("point"), zeros)).drop("point")


def relabel(df: DataFrame, mapping: DataFrame, label: str = "cluster", new: str = "merged") -> DataFrame:
    """Join ``(label, new)``; unmapped labels become -1."""
    return df.join(mapping, label, "left").withColumn(new, F.coalesce(F.col(new), F.lit(-1)))


def once_per_value(df: DataFrame, col: str, expr: Column, out: str) -> DataFrame:
    """Evaluate an expensive expression once per distinct value and join it back.

    The rows travel with a 256-bit digest and the length of the value, not joined on the value itself; the digests of null
    and of any text differ.
    """
    text = F.col(col).cast("string")
    key = F.struct(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("h"), F.coalesce(F.length(text), F.lit(-1)).alias("n"))
    done = df.select(col).withColumn("_key", key).groupBy("_key").agg(F.first(col).alias(col)).withColumn(out, expr)
    return df.withColumn("_key", key).join(done.select("_key", out), "_key", "left").drop("_key")


def with_embedding_metadata(results: DataFrame, metadata: DataFrame,
                            keys: Sequence[str] = ("embedding_model", "dataset_name", "fold", "repeat")) -> DataFrame:
    return results.join(metadata, list(keys))


def stack_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of result frames with different columns."""
    res = frames[0]
    for f in frames[1:]:
        res = res.unionByName(f, allowMissingColumns=True)
    return res


def missing_names(expected: DataFrame, found: DataFrame, on: str) -> DataFrame:
    return expected.select(on).distinct().join(found.select(on).distinct(), on, "left_anti")
