"""Boosted trees that grow together, against trees grown by plain loops."""

from pathlib import Path

import numpy as np
import pytest

from gaugeframe.operators import boosting as bo
from gaugeframe.staging import stage_root


def frame(spark, n=240, width=3, seed=0):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(n, width)), 1)
    y = 3 * m[:, 0] - 2 * (m[:, 1] > 0.3) + 0.1 * rng.normal(size=n) + 40
    rows = [(i, [float(v) for v in r], float(t), i % 3) for i, (r, t) in enumerate(zip(m, y))]
    return spark.createDataFrame(rows, "row_id long, embedding array<double>, y double, fold int"), m, y


def plain_tree(x, r, cuts, depth):
    """Nested ``(feature, cut, left, right)`` or a mean; every cut of every feature is tried."""
    mean, best = r.mean(), (((r - r.mean()) ** 2).sum() - 1e-9, None)
    for f in range(x.shape[1]) if depth else []:
        for c in cuts[f]:
            goes = x[:, f] <= c
            if goes.any() and not goes.all():
                left = sum(((p - p.mean()) ** 2).sum() for p in (r[goes], r[~goes]))
                if left < best[0] - 1e-9:
                    best = (left, (f, c))
    if best[1] is None:
        return mean
    f, c = best[1]
    goes = x[:, f] <= c
    return f, c, plain_tree(x[goes], r[goes], cuts, depth - 1), plain_tree(x[~goes], r[~goes], cuts, depth - 1)


def plain_told(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boosting(m, y, inside, cuts, task):
    start = y[inside].mean()
    told = np.full(len(y), start)
    for _ in range(task.rounds):
        tree = plain_tree(m[inside], (y - told)[inside], cuts, task.depth)
        told = told + task.step * np.array([plain_told(tree, row) for row in m])
    return told


TASKS = [bo.BoostTask(f, d, r, s) for f in range(3) for d, r, s in ((2, 5, 0.3), (3, 3, 0.5))]


@pytest.mark.parametrize("block_bytes", [bo.BLOCK_BYTES, 150])
def test_models_equal_plain_boosting(spark, block_bytes):
    df, m, y = frame(spark)
    rows = bo.BoostedMany.pack(df, "row_id", "embedding", "y", block_bytes=block_bytes)
    assert rows.count == (1 if block_bytes > 150 else 5)
    models, held = rows.fit(TASKS, keep=True)
    fold = np.arange(len(y)) % 3
    for k, task in enumerate(TASKS):
        want = plain_boosting(m, y, fold != task.fold, rows.edges, task)
        assert np.allclose(models[k](m), want, atol=1e-8)
        own = fold == task.fold
        assert held[k].tolist() == [pytest.approx(((want - y)[own] ** 2).sum()), own.sum()]


def test_models_whose_sums_do_not_fit_take_turns(spark, monkeypatch):
    df, m, y = frame(spark, 60)
    rows = bo.BoostedMany.pack(df, "row_id", "embedding", "y", block_bytes=100)
    together, _ = rows.fit(TASKS[:3], keep=True)
    monkeypatch.setattr(bo, "SUM_BYTES", 1)
    apart, held = rows.fit(TASKS[:3], keep=True)
    assert all(np.allclose(a(m), b(m)) for a, b in zip(together, apart)) and held[:, 1].tolist() == [20, 20, 20]


def test_flat_targets_and_constant_features(spark):
    df, m, _ = frame(spark, 30)
    flat = df.selectExpr("row_id", "array(embedding[0], 1D) AS embedding", "7D AS y", "fold")
    models, held = bo.BoostedMany.pack(flat, "row_id", "embedding", "y").fit(TASKS[:2], keep=True)
    assert np.allclose(models[0](m[:, :2]), 7) and np.allclose(held[:, 0], 0)


def test_blocks_are_bounded_by_rows_and_predictions(spark, monkeypatch):
    df, m, y = frame(spark, 100, 2)
    whole = bo.BoostedMany.pack(df, "row_id", "embedding", "y")
    parts = bo.BoostedMany.pack(df, "row_id", "embedding", "y", block_rows=15)
    assert parts.whole and parts.count == 7
    cut = bo.BoostedMany.pack(df, "row_id", "embedding", "y", block_rows=15, task_rows=50)
    assert (whole.count, cut.count) == (1, 7) and cut.blocks.count() == 7
    monkeypatch.setattr(bo, "TOLD_BYTES", 2 * 8 * cut.rows)  # two models at a time
    seen, passes = [], bo.BoostedMany._fit_in_passes
    monkeypatch.setattr(bo.BoostedMany, "_fit_in_passes", lambda self, tasks: seen.append(len(tasks)) or passes(self, tasks))
    one, held = whole.fit(TASKS[:3], keep=True)
    told = lambda: set(Path(stage_root(spark)).glob("boost-told-*"))
    before = told()
    many, held_cut = cut.fit(TASKS[:3], keep=True)
    assert told() == before  # a round's predictions replace the last round's
    same, held_parts = parts.fit(TASKS[:3], keep=True)
    assert seen == [2, 1] and np.allclose(held, held_cut) and np.allclose(held, held_parts)
    assert all(np.allclose(a(m), b(m)) and np.allclose(a(m), c(m)) for a, b, c in zip(one, many, same))


def test_level_sums_take_a_feature_at_a_time():
    rng = np.random.default_rng(1)
    bins, node, residual = rng.integers(0, bo.BINS, (500, 3)).astype(np.uint8), rng.integers(0, 7, 500), rng.normal(size=500)
    got = bo.level_sums(bins, node, residual, 2)
    want = np.zeros((4, 3, bo.BINS, 2))
    for b, k, r in zip(bins, node, residual):
        for f in range(3) if k >= 3 else ():
            want[k - 3, f, b[f]] += (r, 1)
    assert np.allclose(got, want)
