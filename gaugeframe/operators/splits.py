"""Splits, folds, repeats and samples that depend on keys only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import bucket, uniform
from .ranks import ONE_TASK_ROWS, number_rows


def role_by_column(col: str = "set", test_value: str = "test") -> Column:
    """``test`` where the column says so; everything else, missing included, is ``train``."""
    return F.when(F.col(col).eqNullSafe(F.lit(test_value)), F.lit("test")).otherwise(F.lit("train"))


def role_by_hash(row_id: str, test_size: float = 0.2, seed: int = 42) -> Column:
    """Random hold-out drawn from the row key alone; the test share is approximate."""
    return F.when(bucket(1000, seed, F.col(row_id)) < int(round(test_size * 1000)), F.lit("test")).otherwise(F.lit("train"))


def join_splits(features: DataFrame, splits: DataFrame, keys: Sequence[str] = ("dataset", "row_id")) -> DataFrame:
    """Index-list split: one output row per (repeat, fold, row)."""
    return features.join(splits, list(keys))


def repeats_for(samples: str = "num_samples", lite: bool = False) -> Column:
    """Ten repeats below 2 500 rows, one above 250 000, three between; one in lite mode."""
    if lite:
        return F.lit(1)
    return F.when(F.col(samples) < 2500, F.lit(10)).when(F.col(samples) > 250000, F.lit(1)).otherwise(F.lit(3))


def expand_folds(tasks: DataFrame, samples: str = "num_samples", folds: str = "folds", lite: bool = False) -> DataFrame:
    """One row per (task, repeat, fold)."""
    last = F.lit(0) if lite else F.col(folds) - 1
    out = tasks.withColumn("repeat", F.explode(F.sequence(F.lit(0), repeats_for(samples, lite) - 1)))
    return out.withColumn("fold", F.explode(F.sequence(F.lit(0), last)))


def stratified_folds(df: DataFrame, row_id: str, k: int, label: str | None = None, by: Sequence[str] = (),
                     seed: int = 42, out: str = "fold", one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Fold 0 … k-1 per row; every class is dealt out evenly in keyed random order.

    Large classes are dealt in slices of the random key, which is uniform, so no class has to fit into one task.
    """
    keys = [*by, *([label] if label else [])]
    n = df.count()
    slices = max(1, -(-n // one_task_rows))
    df = df.withColumn("_u", uniform(seed, F.col(row_id))).withColumn(
        "_s", F.floor(F.col("_u") * slices).cast("int"))
    w = W.partitionBy(*keys, "_s").orderBy("_u", row_id)
    df = df.withColumn("_pos", F.row_number().over(w) - 1)
    if slices > 1:
        sizes = df.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
        before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
        starts = sizes.select(*keys, "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        df = df.join(starts, [*keys, "_s"]).withColumn("_pos", F.col("_pos") + F.col("_start")).drop("_start")
    return df.withColumn(out, F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_u", "_s", "_pos")


def _next_prime(n: int) -> int:
    p = max(2, n)
    while any(p % d == 0 for d in range(2, int(p ** 0.5) + 1)):
        p += 1
    return p


def random_collections(tasks: DataFrame, task_id: str = "task_id", num_collections: int = 20, max_size: int = 10,
                       seed: int = 42) -> DataFrame:
    """``(collection, position, task_id)``: seeded collections of 2 … max_size-1 distinct tasks.

    A collection walks the numbered tasks by ``x -> a x + b`` modulo the next prime, a bijection, so members never
    repeat and only the drawn rows are generated.
    """
    numbered = number_rows(tasks.select(task_id).distinct(), [task_id], "slot")
    total = numbered.count()
    if total < 2:
        raise ValueError(f"{total} tasks are too few for a collection")
    prime = _next_prime(total)
    spark = tasks.sparkSession
    draws = spark.range(num_collections).withColumnRenamed("id", "number").select(
        F.concat(F.lit("collection_"), F.col("number").cast("string")).alias("collection"),
        F.least(F.lit(2) + bucket(max_size - 2, seed, "size", F.col("number")), F.lit(total)).alias("size"),
        (F.lit(1) + F.floor(uniform(seed, "a", F.col("number")) * F.lit(float(prime - 1)))).alias("a"),
        F.floor(uniform(seed, "b", F.col("number")) * F.lit(float(prime))).alias("b"))
    walk = draws.withColumn("x", F.explode(F.sequence(F.lit(0), F.least(
        F.col("size") - 1 + (prime - total), F.lit(prime - 1)))))
    walk = walk.withColumn("slot", F.pmod(F.col("a") * F.col("x") + F.col("b"), F.lit(prime)).cast("bigint"))
    walk = walk.filter(F.col("slot") < total)
    pos = F.row_number().over(W.partitionBy("collection").orderBy("x"))
    walk = walk.withColumn("position", pos).filter(F.col("position") <= F.col("size"))
    return walk.join(numbered, "slot").select("collection", "position", task_id)


def collection_table(members: DataFrame, task_id: str = "task_id") -> DataFrame:
    """One row per collection: ordered member ids and their ``_``-joined text."""
    listed = members.groupBy("collection").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", task_id))), lambda m: m[task_id]).alias("selected_task_ids"))
    return listed.select("collection", F.array_join(F.col("selected_task_ids").cast("array<string>"), "_")
                         .alias("selected_task_ids_str"), "selected_task_ids")


def shuffle_key(row_id: str, seed: int = 42) -> Column:
    """Sort key of a seeded shuffle; rows, vectors and labels move together because they are one row."""
    return uniform(seed, "shuffle", F.col(row_id))
