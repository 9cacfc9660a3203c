"""Neighbour join and its evaluators against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.functions.vectors import DISTANCES
from gaugeframe.operators import knn, neighbors
from gaugeframe.operators.knn import fold_join, knn_join
from gaugeframe.operators.neighbors import knn_classify, knn_regress, local_outlier_factor
from gaugeframe.staging import stage


def frame(spark, m, ids=None, **extra):
    ids = range(len(m)) if ids is None else ids
    names = list(extra)
    rows = [(int(i), [float(x) for x in v], *[extra[n][j] for n in names]) for j, (i, v) in enumerate(zip(ids, m))]
    types = "".join(f", {n} {'double' if isinstance(extra[n][0], float) else 'int'}" for n in names)
    return spark.createDataFrame(rows, "id bigint, v array<double>" + types)


def distances(a, b, metric):
    d = a[:, None, :] - b[None]
    if metric == "euclidean":
        return np.sqrt((d ** 2).sum(-1))
    if metric == "manhattan":
        return np.abs(d).sum(-1)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    size = na[:, None] * nb[None]
    return 1 - np.divide((a[:, None, :] * b[None]).sum(-1), size, out=np.zeros_like(size), where=size > 0)


def brute(a, b, k, metric, exclude=False):
    d = np.round(distances(a, b, metric), 12)
    out = []
    for i in range(len(a)):
        order = [j for j in np.lexsort((np.arange(len(b)), d[i])) if not (exclude and i == j)][:k]
        out += [(i, int(j), r + 1) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("metric", sorted(DISTANCES))
@pytest.mark.parametrize("strategy", ["broadcast", "cells"])
def test_hot_copies_and_zero_vectors(spark, metric, strategy):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(240, 4)), 3)
    m[::3] = m[0]  # a third of all rows are copies of one vector
    m[1] = 0.0
    df = frame(spark, m).repartition(5)
    got = knn_join(df, df, 4, query_id="id", query_vec="v", train_id="id", train_vec="v", metric=metric,
                   exclude_self=True, strategy=strategy, block_rows=16, chunk_rows=8)
    rows = sorted((r["q"], r["t"], r["rank"]) for r in got.collect())
    assert rows == sorted(brute(m, m, 4, metric, True))


def test_clustered_cells_match_broadcast_and_prune(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 50
    m = centres[rng.integers(12, size=900)] + rng.normal(size=(900, 6))
    df = frame(spark, m)
    kw = dict(query_id="id", query_vec="v", train_id="id", train_vec="v", exclude_self=True)
    a = knn_join(df, df, 5, strategy="broadcast", **kw).select("q", "t", "rank")
    b = knn_join(df, df, 5, strategy="cells", block_rows=40, chunk_rows=32, **kw).select("q", "t", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("strategy", ["broadcast", "cells"])
def test_groups_of_very_different_size(spark, strategy):
    rng = np.random.default_rng(7)
    m = np.round(rng.normal(size=(300, 3)), 3)
    g = [0 if i % 3 else (1 if i % 9 else 2 + i % 4) for i in range(300)]
    df = frame(spark, m, g=g)
    got = knn_join(df, df, 3, query_id="id", query_vec="v", train_id="id", train_vec="v", by=["g"], exclude_self=True,
                   strategy=strategy, block_rows=32, chunk_rows=16)
    want = []
    for k in set(g):
        idx = np.array([i for i in range(300) if g[i] == k])
        want += [(int(idx[a]), int(idx[b]), r) for a, b, r in brute(m[idx], m[idx], 3, "euclidean", True)]
    assert sorted((r["q"], r["t"], r["rank"]) for r in got.collect()) == sorted(want)


def test_fewer_train_rows_than_k(spark):
    q, t = frame(spark, np.eye(3)), frame(spark, np.ones((2, 3)))
    for strategy in ("broadcast", "cells"):
        got = knn_join(q, t, 5, query_id="id", query_vec="v", train_id="id", train_vec="v", strategy=strategy)
        assert got.count() == 6


def test_bad_arguments(spark):
    df = frame(spark, np.eye(2))
    kw = dict(query_id="id", query_vec="v", train_id="id", train_vec="v")
    with pytest.raises(ValueError):
        knn_join(df, df, 1, metric="hamming", **kw)
    with pytest.raises(ValueError):
        knn_join(df, df, 0, **kw)
    with pytest.raises(ValueError):
        knn_join(df, df, 1, strategy="broadcast", broadcast_bytes=1, **kw)


def test_zero_distance_takes_all_weight(spark):
    train = frame(spark, np.array([[0.0], [0.0], [1.0], [2.0]]), y=[1, 0, 2, 2])
    test = frame(spark, np.array([[0.0], [0.5]]))
    got = {r["id"]: r["proba"] for r in knn_classify(train, test, 3, 3, "distance", row_id="id", vec="v").collect()}
    assert got[0] == [0.5, 0.5, 0.0]
    assert np.allclose(got[1], [1 / 3, 1 / 3, 1 / 3])
    reg = frame(spark, np.array([[0.0], [0.0], [1.0]]), y=[1.0, 3.0, 9.0])
    pred = {r["id"]: r["prediction"] for r in knn_regress(reg, test, 3, "distance", row_id="id", vec="v").collect()}
    assert pred[0] == 2.0
    with pytest.raises(ValueError):
        knn_classify(train, test, 3, 3, "other", row_id="id", vec="v").collect()


def lof(m, k):
    d = distances(m, m, "euclidean")
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    reach = np.maximum(dist, dist[near, -1])
    lrd = 1 / (reach.mean(1) + 1e-10)
    return lrd[near].mean(1) / lrd


def test_lof_formula_and_grid(spark):
    m = np.random.default_rng(1).normal(size=(80, 3))
    got = {r["id"]: r["prediction"] for r in local_outlier_factor(frame(spark, m), 10, row_id="id", vec="v").collect()}
    assert np.allclose([got[i] for i in range(80)], lof(m, 10), rtol=1e-9)
    x, y = np.meshgrid(np.arange(12.0), np.arange(12.0))
    grid = np.column_stack([x.ravel(), y.ravel()])
    inner = [i for i, (a, b) in enumerate(grid) if 3 <= a <= 8 and 3 <= b <= 8]
    got = {r["id"]: r["prediction"] for r in local_outlier_factor(frame(spark, grid), 8, row_id="id", vec="v").collect()}
    assert max(abs(got[i] - 1) for i in inner) < 0.05


def test_lof_caps_neighbours(spark):
    m = np.random.default_rng(2).normal(size=(6, 2))
    got = {r["id"]: r["prediction"] for r in local_outlier_factor(frame(spark, m), 50, row_id="id", vec="v").collect()}
    assert np.allclose([got[i] for i in range(6)], lof(m, 5))


def test_approximate_join_recall_and_copies(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    m = centres[rng.integers(30, size=1500)] + 0.6 * rng.normal(size=(1500, 16))
    df = frame(spark, m)
    kw = dict(query_id="id", query_vec="v", train_id="id", train_vec="v", exclude_self=True)
    exact = {(r["q"], r["t"]) for r in knn_join(df, df, 5, **kw).collect()}
    found = [len(exact & {(r["q"], r["t"]) for r in knn_join(df, df, 5, strategy="approx", probes=p, block_rows=32, **kw).collect()}) / len(exact)
             for p in (1, 12, 1000)]
    assert found[0] < found[1] and found[1] >= 0.95 and found[2] == 1.0


def test_every_large_group_has_its_own_pivots(spark):
    rng = np.random.default_rng(9)
    g = [0] * 900 + [1] * 60 + [2] * 5
    df = frame(spark, rng.normal(size=(len(g), 3)), g=g)
    rows = df.select("g", F.col("id").alias("t"), F.col("v").alias("tv"), F.lit(1).alias("copy"))
    from gaugeframe.operators import knn
    got = [r["g"] for r in knn._pivot_rows(rows, ["g"], len(g), 20, 1000)]
    assert got.count(0) == 45 and got.count(1) == 3 and got.count(2) == 0
    kw = dict(query_id="id", query_vec="v", train_id="id", train_vec="v", by=["g"])
    a, b = (sorted(map(tuple, knn_join(df, df, 3, strategy=s, block_rows=20, **kw).select("g", "q", "t", "rank").collect())) for s in ("broadcast", "cells"))
    assert a == b


@pytest.mark.parametrize("metric, key", [("euclidean", "int"), ("manhattan", "string"), ("cosine", "string")])
def test_cells_by_any_key(spark, metric, key):
    """Keys may be texts, also where a visited block holds nothing nearer, and their names may begin with an underscore."""
    rng = np.random.default_rng(12)
    m, g = rng.normal(size=(400, 3)), [i % 2 for i in range(400)]
    df = frame(spark, m, g=g).withColumn("_run", F.col("g").cast(key)).drop("g")
    got = knn_join(df, df, 3, query_id="id", query_vec="v", train_id="id", train_vec="v", by=["_run"], exclude_self=True,
                   metric=metric, strategy="cells", block_rows=16, chunk_rows=8)
    want = []
    for k in set(g):
        idx = np.array([i for i in range(400) if g[i] == k])
        want += [(int(idx[a]), int(idx[b]), r) for a, b, r in brute(m[idx], m[idx], 3, metric, True)]
    assert sorted((r["q"], r["t"], r["rank"]) for r in got.collect()) == sorted(want)


def test_many_vectors_of_few_dimensions_go_by_cells(spark, monkeypatch):
    """With the same rows as a broadcast; repeated ids and missing values stay with the broadcast."""
    rng, asked, cells = np.random.default_rng(13), [], knn._cells_join
    monkeypatch.setattr(knn, "MANY_ROWS", 100)
    monkeypatch.setattr(knn, "_cells_join", lambda *a: asked.append(1) or cells(*a))
    plain = frame(spark, rng.normal(size=(300, 2)))
    odd = plain.withColumn("v", F.when(F.col("id") == 7, F.array(F.lit(None), F.lit(1.0))).otherwise(F.col("v")))
    for df, by_cells in ((plain, 1), (plain.unionByName(plain.filter("id < 9")), 0), (odd, 0)):
        asked.clear()
        kw = dict(query_id="id", query_vec="v", train_id="id", train_vec="v", exclude_self=True)
        got, want = knn_join(df, df, 3, block_rows=32, **kw), knn_join(df, df, 3, strategy="broadcast", **kw)
        assert len(asked) == by_cells
        assert sorted((r["q"], r["t"], r["rank"]) for r in got.collect()) == sorted((r["q"], r["t"], r["rank"]) for r in want.collect())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_fold_join_meets_other_folds_in_slices(spark, metric):
    """No slice copies rows per fold, and the slices give what one join with a copy of the rows per fold gives."""
    rng = np.random.default_rng(8)
    m = np.vstack([rng.normal(size=(150, 20)).round(1), np.ones((30, 20))])
    df = spark.createDataFrame([(i, i * 7 % 3, v.tolist()) for i, v in enumerate(m)], "id long, fold int, v array<double>")
    copies = df.withColumn("_run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("_run <> fold")
    want = knn_join(df.withColumn("_run", F.col("fold")), copies, 7, query_id="id", query_vec="v", train_id="id", train_vec="v", metric=metric, by=["_run"])
    key = lambda r: (r["_run"], r["q"], r["rank"], r["t"], round(r["distance"], 12))
    want = sorted(map(key, want.collect()))
    for limit in (1 << 20, 12_000):
        got = fold_join(df, 7, row_id="id", vec="v", fold="fold", folds=3, metric=metric, broadcast_bytes=limit)
        assert got.columns == ["_run", "q", "t", "distance", "rank"] and sorted(map(key, got.collect())) == want


@pytest.mark.parametrize("metric", sorted(DISTANCES))
def test_screened_tiles_give_what_all_exact_distances_give(monkeypatch, metric):
    """Short copies only rule out pairs: ties, outliers, far centres, repeated ids, bounds and rows met before change nothing."""
    rng = np.random.default_rng(14)
    monkeypatch.setattr(knn, "_ROWS", 64)
    monkeypatch.setattr(knn, "_QUERIES", 32)
    for kind in range(4):
        m, tid = rng.normal(size=(400, 18)), rng.permutation(400)
        if kind == 1:
            m[:150], tid[:150] = m[150:300], tid[150:300]
        elif kind == 2:
            m = rng.standard_cauchy(size=m.shape) * 100 + 1e4
        elif kind == 3:
            m = np.round(m)
            m[::7] = 0.0
        q, whole = np.vstack([m[:50], m[-20:]]), knn.Screened(tid, m, metric)
        for own in (None, np.concatenate([tid[:50], tid[-20:]])):
            want = knn.block_top_k(q, m, tid, 7, metric, own)
            for parts in ([whole], [whole.part(slice(0, 5)), whole.part(slice(5, 250)), whole.part(np.arange(250, 400))]):
                assert all((a == b).all() for a, b in zip(want, knn.nearest(q, parts, 7, metric, own), strict=True))
        want, first = knn.block_top_k(q, m, tid, 7, metric), knn.nearest(q, [whole.part(slice(0, 200))], 7, metric)
        ids = np.concatenate([tid[first[1]], tid[200:]])
        got = knn.nearest(q, [whole.part(slice(200, 400))], 7, metric, held=(first[0], tid[first[1]], first[2]))
        assert all((a == b).all() for a, b in zip((want[0], tid[want[1]], want[2]), (got[0], ids[got[1]], got[2])))
        bound = np.full(len(q), want[2].max())
        bound[want[0]] = want[2]
        assert all((a == b).all() for a, b in zip(want, knn.nearest(q, [whole], 7, metric, None, bound)))


@pytest.mark.parametrize("metric", sorted(DISTANCES))
@pytest.mark.parametrize("strategy", ["cells", "auto"])
def test_vectors_without_structure_are_not_copied_to_cells(spark, monkeypatch, metric, strategy):
    """The train blocks go round in several slices: a probe meets its own cell and is shuffled to no other."""
    rng, probed, rounds, probe, turn = np.random.default_rng(15), [], [], knn._probe, knn._round_join
    m = rng.normal(size=(360, 18))
    m[::9] = m[0]
    df = frame(spark, m)
    monkeypatch.setattr(knn, "_probe", lambda chunks, *a: probed.append(chunks.columns) or probe(chunks, *a))
    monkeypatch.setattr(knn, "_round_join", lambda *a: rounds.append(turn(*a)) or rounds[-1])
    got = knn_join(df, df, 4, query_id="id", query_vec="v", train_id="id", train_vec="v", metric=metric, exclude_self=True,
                   strategy=strategy, block_rows=24, chunk_rows=16, broadcast_bytes=32_000)
    assert sorted((r["q"], r["t"], r["rank"]) for r in got.collect()) == sorted(brute(m, m, 4, metric, True))
    assert len(rounds[0]) > 2 and probed == [["cell", "qs", "qvs"]]


def test_slices_of_a_round_hold_whole_cells_or_parts_of_large_ones():
    assert knn._dealt_cells({3: 40, 1: 50, 2: 30, 4: 250, 5: 10}, 100) == ([(1, 0, 1), (2, 0, 1), (3, 1, 1), (4, 2, 3), (5, 5, 1)], 6)


@pytest.mark.parametrize("metric", sorted(DISTANCES))
def test_fold_neighbours_are_those_of_the_fold_join(spark, monkeypatch, metric):
    """In one slice and in several, without a row per neighbour ever being dealt out."""
    rng = np.random.default_rng(16)
    m = np.vstack([rng.normal(size=(150, 18)).round(1), np.ones((30, 18))])
    df = stage(spark.createDataFrame([(i, i * 7 % 3, i % 4, v.tolist()) for i, v in enumerate(m)], "id long, fold int, y int, v array<double>"))
    kw = dict(row_id="id", vec="v", fold="fold", folds=3, metric=metric)
    near = fold_join(df, 7, **kw).join(df.selectExpr("id as t", "y as label"), "t").join(df.selectExpr("id as q", "y"), "q")
    want = {}
    for r in near.orderBy("_run", "q", "rank").collect():
        want.setdefault((r["_run"], r["q"], r["y"]), []).append((r["label"], round(r["distance"], 12)))
    want = sorted((run, y, tuple(v)) for (run, _, y), v in want.items())
    for limit in (1 << 20, 12_000):
        got = knn.fold_neighbours(df, 7, label="y", broadcast_bytes=limit, **kw)
        assert sorted((r["run"], r["y"], tuple(zip(r["labels"], [round(d, 12) for d in r["distances"]]))) for r in got.collect()) == want


def test_grid_of_repeated_ids_is_that_of_the_joined_labels(spark, monkeypatch):
    """Plain rows take the neighbours as they are; rows whose ids repeat go by the join, and rows without repeats score alike both ways."""
    rng = np.random.default_rng(17)
    df = stage(spark.createDataFrame([(i, i % 3, int(i % 2), rng.normal(size=4).tolist()) for i in range(60)], "row_id long, fold int, y int, embedding array<double>"))
    kw = dict(ks=(3, 5), metrics=("euclidean",), folds=3)
    joined, join = [], neighbors.fold_join
    monkeypatch.setattr(neighbors, "fold_join", lambda *a, **b: joined.append(1) or join(*a, **b))
    plain = sorted(map(tuple, neighbors.knn_grid(df, 2, **kw).collect()))
    assert not joined
    neighbors.knn_grid(df.unionByName(df.limit(3)), 2, **kw)
    assert joined == [1]
    monkeypatch.setattr(neighbors, "plain_rows", lambda *a: False)
    assert plain == sorted(map(tuple, neighbors.knn_grid(df, 2, **kw).collect()))
