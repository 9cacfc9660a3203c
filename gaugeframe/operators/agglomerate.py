"""Ward's clustering of any number of points by reciprocal nearest pairs.

Two clusters that are each other's cheapest partner are joined sooner or later whatever else happens, and joining others never makes a
partner cheaper. So every round joins all such pairs at once, and only clusters that are new or whose partner was
joined look for one again, in blocks. The joins and their costs are the ones of the one-at-a-time method; a number of
clusters is reached by undoing the dearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import as_double
from ..staging import stage
from .blockwise import BLOCK_POINTS, against_blocks, point_blocks, squared_distances
from .ranks import number_rows


def _cheapest(seekers: DataFrame, live: DataFrame, block_points: int) -> DataFrame:
    """``(id, near, cost)``: the partner of least cost of each seeker; equal costs go to the pair of smallest ids."""
    blocks = point_blocks(live, "id", "centre", ["size"], block_points)

    def compare(chunk, block):
        near, cost = np.zeros(len(chunk["keys"]), np.int64), np.zeros(len(chunk["keys"]))
        for part, d in squared_distances(chunk["points"], block["points"]):
            ids, sizes = chunk["keys"][part][:, None], chunk["size"][part][:, None]
            d *= sizes * block["size"] / (sizes + block["size"])
            d[ids == block["keys"]] = np.inf
            tied = d == d.min(axis=1, keepdims=True)
            first = np.where(tied, np.minimum(ids, block["keys"]), np.iinfo(np.int64).max)
            tied &= first == first.min(axis=1, keepdims=True)
            second = np.where(tied, np.maximum(ids, block["keys"]), np.iinfo(np.int64).max)
            at = second.argmin(axis=1)
            near[part], cost[part] = block["keys"][at], d[np.arange(len(at)), at]
        return pa.RecordBatch.from_arrays([pa.array(chunk["keys"]), pa.array(near), pa.array(cost)], names=["id", "near", "cost"])

    found = against_blocks(seekers, "id", "centre", blocks, compare, "id long, near long, cost double", ["size"], ["size"])
    order = F.struct("cost", F.least("id", "near"), F.greatest("id", "near"))
    return found.filter(F.col("cost") < float("inf")).groupBy("id").agg(F.min_by("near", order).alias("near"), F.min("cost").alias("cost"))


def ward_joins(points: DataFrame, key: str, vec: str, keep: int, block_points: int = BLOCK_POINTS) -> DataFrame:
    """The joins ``(gone, into, cost, round)`` that leave ``keep`` clusters of ``points(key long, vec)``, each named by its least key."""
    spark = points.sparkSession
    none = lambda kind: F.lit(None).cast(kind)
    live = stage(points.select(F.col(key).cast("long").alias("id"), F.lit(1.0).alias("size"), as_double(vec).alias("centre"),
                               none("long").alias("near"), none("double").alias("cost")), "ward-live")
    wanted, number, joins = live.count() - keep, 0, []
    while wanted > 0:
        seekers = live.filter("near is null").drop("near", "cost")
        found = _cheapest(seekers, live, block_points)
        live = stage(live.filter("near is not null").unionByName(seekers.join(found, "id", "left")).select(
            "id", "size", "centre", "near", "cost"), "ward-near")
        cheapest = live.agg(F.min("cost")).first()[0]
        if cheapest is None or joins and _all(joins).filter(F.col("cost") < cheapest).count() >= wanted:
            break  # one cluster is left, or no later join can be among the cheapest
        other = live.select(F.col("id").alias("near"), F.col("near").alias("back"), F.col("size").alias("size2"), F.col("centre").alias("centre2"))
        pairs = stage(live.join(other, "near").filter((F.col("back") == F.col("id")) & (F.col("id") < F.col("near"))), "ward-pairs")
        joins.append(stage(pairs.select(F.col("near").alias("gone"), F.col("id").alias("into"), "cost", F.lit(number).alias("round")), "ward-joins"))
        if len(joins) >= 16:  # keep the plan short however many rounds there are
            joins = [stage(_all(joins), "ward-joins")]
        both = F.col("size") + F.col("size2")
        centre = F.zip_with("centre", "centre2", lambda a, b: (a * F.col("size") + b * F.col("size2")) / both)
        new = pairs.withColumn("middle", centre).select(  # apart, or "size" in the lambda would be the new one
            "id", both.alias("size"), F.col("middle").alias("centre"), none("long").alias("near"), none("double").alias("cost"))
        taken = stage(pairs.select(F.explode(F.array("id", "near")).alias("id")), "ward-taken")
        lost = taken.select(F.col("id").alias("near"), F.lit(True).alias("lost"))
        kept = lambda c: F.when(F.col("lost").isNull(), F.col(c)).alias(c)
        rest = live.join(taken, "id", "left_anti").join(lost, "near", "left").select("id", "size", "centre", kept("near"), kept("cost"))
        live = stage(rest.unionByName(new), "ward-live")
        number += 1
    if not joins:
        return spark.createDataFrame([], "gone long, into long, cost double, round int")
    return number_rows(_all(joins), ["cost", "round", "into", "gone"], "place").filter(F.col("place") < wanted).drop("place")


def _all(joins: list[DataFrame]) -> DataFrame:
    whole = joins[0]
    for more in joins[1:]:
        whole = whole.unionByName(more)
    return whole


def ward_labels(points: DataFrame, key: str, vec: str, keep: int, out: str = "merged", block_points: int = BLOCK_POINTS) -> DataFrame:
    """``(key, out)``: labels 0 to ``keep - 1`` of the clusters that Ward's criterion leaves, by their least key."""
    joins = ward_joins(points, key, vec, keep, block_points)
    ids = points.select(F.col(key).cast("long").alias("id"))
    up = stage(ids.join(joins.select(F.col("gone").alias("id"), "into"), "id", "left").select("id", F.coalesce("into", "id").alias("root")), "ward-roots")
    while True:  # a cluster's name follows its joins; each round doubles the steps taken
        above = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = stage(up.join(above, "root").select("id", F.col("top").alias("root")), "ward-roots")
        if not new.join(up.withColumnRenamed("root", "was"), "id").filter("root <> was").limit(1).count():
            break
        up = new
    names = number_rows(up.select("root").distinct(), ["root"], "label")
    return up.join(names, "root").select(F.col("id").alias(key), F.col("label").cast("int").alias(out))
