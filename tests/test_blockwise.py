"""Rows against many points in blocks, and Ward's joins in rounds, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import agglomerate as ag, blockwise as bw, embed as emb


def frame(spark, m, **more):
    rows = [(i, [float(v) for v in r], *[float(c[i]) for c in more.values()]) for i, r in enumerate(m)]
    return spark.createDataFrame(rows, ", ".join(["id long", "vec array<double>", *[f"{c} double" for c in more]]))


def plain_ward(points, k):
    """Labels by joining the cheapest pair, one at a time; clusters are told apart by their least point."""
    groups = {i: [i] for i in range(len(points))}
    while len(groups) > k:
        ids = sorted(groups)
        centres, sizes = np.array([points[groups[i]].mean(0) for i in ids]), np.array([len(groups[i]) for i in ids])
        cost = ((centres[:, None] - centres[None]) ** 2).sum(2) * sizes[:, None] * sizes / (sizes[:, None] + sizes)
        cost[np.tril_indices(len(ids))] = np.inf
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        groups[ids[i]] += groups.pop(ids[j])
    out = np.zeros(len(points), int)
    for label, i in enumerate(sorted(groups)):
        out[groups[i]] = label
    return out


@pytest.mark.parametrize("n, k, block", [(200, 10, 64), (200, 3, 4096), (30, 29, 8), (12, 1, 4096), (5, 5, 4096)])
def test_ward_equals_plain_ward(spark, n, k, block):
    m = np.random.default_rng(n + k).normal(size=(n, 3)) * [1, 5, 0.2]
    got = {r["id"]: r["merged"] for r in ag.ward_labels(frame(spark, m), "id", "vec", k, block_points=block).collect()}
    assert [got[i] for i in range(n)] == plain_ward(m, k).tolist()


def test_ward_of_equal_points(spark):
    m = np.repeat(np.array([[0.0, 0], [4, 4], [9, 0]]), 7, axis=0)
    got = ag.ward_labels(frame(spark, m), "id", "vec", 3).orderBy("id").collect()
    assert [r["merged"] for r in got] == [0] * 7 + [1] * 7 + [2] * 7


def test_a_chain_of_growing_gaps(spark):
    m = np.cumsum(1.5 ** np.arange(14))[:, None]  # one reciprocal pair a round
    got = {r["id"]: r["merged"] for r in ag.ward_labels(frame(spark, m), "id", "vec", 4).collect()}
    assert [got[i] for i in range(14)] == plain_ward(m, 4).tolist()


@pytest.mark.parametrize("broadcast", [1 << 24, 0])
def test_summary_of_twenty_thousand_points(spark, monkeypatch, broadcast):
    monkeypatch.setattr(bw, "BROADCAST_BYTES", broadcast)
    rng = np.random.default_rng(1)
    rows, points, weight = rng.normal(size=(60, 4)), rng.normal(size=(20_000, 4)), rng.uniform(size=20_000)
    blocks = bw.point_blocks(frame(spark, points, weight=weight), "id", "vec", ["weight"])
    assert blocks.count() == 5 and blocks.agg(F.max(F.size("flat"))).first()[0] < 4 * 4500  # no cell holds all of them
    got = {r["id"]: r for r in bw.distance_summary(frame(spark, rows), "vec", blocks).collect()}
    far = np.sqrt(((rows[:, None] - points[None]) ** 2).sum(2))
    for i in range(60):
        assert np.allclose([got[i]["least"], got[i]["weighted"], got[i]["deviation"]], [far[i].min(), far[i] @ weight, far[i].std()])


def test_pairs_of_rows_and_points(spark):
    rng = np.random.default_rng(2)
    rows, points = rng.normal(size=(7, 2)), rng.normal(size=(5, 2))
    blocks = bw.point_blocks(frame(spark, points), "id", "vec", block_points=2)
    got = {(r["id"], r["cluster"]): r["distance"] for r in bw.pair_distances(frame(spark, rows), "id", "vec", blocks).collect()}
    assert len(got) == 35 and all(v == pytest.approx(np.linalg.norm(rows[i] - points[j])) for (i, j), v in got.items())
    empty = frame(spark, rows).filter("id < 0")
    assert bw.pair_distances(empty, "id", "vec", blocks).count() == 0


def test_targets_keep_repeated_rows_and_other_columns(spark):
    df = frame(spark, np.zeros((3, 2))).select(F.lit(1).alias("id"), F.col("vec").alias("embedding"), F.lit(0).alias("cluster"), F.lit("x").alias("keys"),
                                             F.lit(5).alias("least"), F.lit(6).alias("_least0"), F.lit(7).alias("weighted"))
    got = emb.cluster_distance_targets(df, df, ("min", "std")).collect()
    assert len(got) == 3 and all(r["targets"] == [0.0, 0.0] and (r["keys"], r["least"], r["_least0"]) == ("x", 5, 6) for r in got)
