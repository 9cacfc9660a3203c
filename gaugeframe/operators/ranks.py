"""Global order without a single-task window: numbering and exact quantiles.

To number rows they are range-partitioned by (group, order), staged once, and numbered inside each range slice; the
slices' totals (one row per slice and group) supply the offsets. Quantiles are looked up in an index of counted values that
is sliced likewise. A group of any size is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..staging import stage

ONE_TASK_ROWS = 1_000_000


def number_rows(df: DataFrame, order: Sequence[str], out: str, by: Sequence[str] = (),
                one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Add ``out``: 0-based position by ``order`` within ``by``; ``order`` must be unique within ``by``."""
    df = stage(df, "number")
    if df.count() <= one_task_rows:
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    cut = stage(df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()), "number-sliced")
    keys = [*by, "_slice"]
    totals = cut.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = W.partitionBy(*keys).orderBy(*order)
    return (cut.withColumn(out, F.row_number().over(w) - 1).join(starts, keys)
            .withColumn(out, (F.col(out) + F.col("_start")).cast("bigint")).drop("_slice", "_start"))


@dataclass(frozen=True)
class RankIndex:
    """Where every distinct value of a column stands: staged ``points(_key, column, value, n, slice)``, ``n`` rows hold the value.

    ``slices(_key, column, slice, start, n)`` tell how many rows stand before each range slice, ``totals(_key, column, n)`` how
    many there are. ``column`` is the place in ``cols``; ``_key`` the struct of the grouping columns.
    """

    points: DataFrame
    slices: DataFrame
    totals: DataFrame
    cols: tuple[str, ...]
    by: tuple[str, ...]

    def at(self, wanted: DataFrame) -> DataFrame:
        """``(_key, column, pos, value)``: the value at each 0-based position of ``wanted(_key, column, pos)``."""
        keys = ["_key", "column", "slice"]
        near = self.slices.select(F.col("_key").alias("_k"), F.col("column").alias("_c"), "slice", "start", "n")
        asked = wanted.join(near, (F.col("_key") == F.col("_k")) & (F.col("column") == F.col("_c")) &
                            (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("n")))
        asked = asked.select(*keys, (F.col("pos") - F.col("start")).alias("pos"), F.lit(None).cast("double").alias("value"),
                             F.lit(1).alias("mark"), "start")
        ahead = W.partitionBy(*keys).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
        points = self.points.select(*keys, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("pos"), "value", F.lit(0).alias("mark"),
                                    F.lit(None).cast("long").alias("start"))
        upto = W.partitionBy(*keys).orderBy("pos", "mark").rowsBetween(W.unboundedPreceding, 0)
        found = points.unionByName(asked).withColumn("value", F.last("value", ignorenulls=True).over(upto)).filter("mark = 1")
        return found.select("_key", "column", (F.col("pos") + F.col("start")).alias("pos"), "value")


def rank_index(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), slice_values: int = ONE_TASK_ROWS) -> RankIndex:
    """Index of the finite values of each column.

    Equal values collapse to one counted row before anything is ordered; the counted values are dealt by range in slices of about
    ``slice_values``, so a group of any size is many tasks.
    """
    keys = ["_key", "column"]
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    long = df.select(group.alias("_key"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])))
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    points = stage(long.groupBy(*keys, "value").agg(F.count("*").alias("n")), "rank-values")
    many = -(-points.count() // max(1, slice_values))
    if many > 1:
        points = stage(points.repartitionByRange(many, *keys, "value").withColumn("slice", F.spark_partition_id()), "rank-slices")
    else:
        points = points.withColumn("slice", F.lit(0))
    slices = points.groupBy(*keys, "slice").agg(F.sum("n").alias("n"))
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = stage(slices.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "rank-starts")
    return RankIndex(points, slices, slices.groupBy(*keys).agg(F.sum("n").alias("n")), tuple(cols), tuple(by))


def quantile_arrays(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                    one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Rows ``(*by, column, q)``: exact, linearly interpolated quantiles of the finite values of each column.

    All probabilities are looked up in one index of the counted values, whose slices hold about ``one_task_rows`` of them; a
    further probability costs two more rows of the look-up and nothing else.
    """
    by, probs, keys = list(by), [float(p) for p in probs], ["_key", "column"]
    index = rank_index(df, cols, by, one_task_rows)
    marks = index.totals.select(*keys, "n", F.posexplode(F.lit(probs)).alias("i", "p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    marks = marks.select(*keys, "i", F.floor("at").alias("below"), F.ceil("at").alias("above"), (F.col("at") - F.floor("at")).alias("share"))
    found = index.at(marks.select(*keys, F.explode(F.array("below", "above")).alias("pos")).distinct())
    ends = marks.select(*keys, "i", "share", F.inline(F.array(
        F.struct(F.col("below").alias("pos"), F.lit(0).alias("end")), F.struct(F.col("above").alias("pos"), F.lit(1).alias("end")))))
    ends = ends.join(found, [*keys, "pos"])
    low, high = F.max(F.when(F.col("end") == 0, F.col("value"))), F.max(F.when(F.col("end") == 1, F.col("value")))
    each = ends.groupBy(*keys, "i").agg((low + (high - low) * F.max("share")).alias("v"))
    listed = each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("q"))
    names = F.array(*[F.lit(c) for c in cols])
    return listed.select(*[F.col("_key")[c].alias(c) for c in by], F.get(names, F.col("column")).alias("column"), "q")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                    one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Rows ``(*by, column, q0, q1, …)``: exact quantiles of the finite values of each column."""
    got = quantile_arrays(df, cols, probs, by, one_task_rows)
    return got.select(*by, "column", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))])
