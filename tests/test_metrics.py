"""Metrics against direct formulas, with ties, one-class groups and many range slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import gram, metrics as met


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None
    return ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))


def scored(spark, g, y, s):
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(g, y, s)], "g int, y int, prediction double")


@pytest.mark.parametrize("slices", ["1", "8", "64"])
def test_auc_over_many_slices(spark, slices):
    rng = np.random.default_rng(0)
    n = 3000
    g = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))  # one group holds well over a third
    y = rng.integers(0, 2, n)
    s = np.round(rng.normal(size=n) + 0.3 * y, 1)
    y[g == 5] = 1
    df = scored(spark, g, y, s)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", slices)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["g"]: r["auc_score"] for r in met.roc_auc(df, ["g"]).collect()}
        whole = met.roc_auc(df).first()["auc_score"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    assert len(got) == len(set(g))
    for k, v in got.items():
        want = auc(y[g == k], s[g == k])
        assert (v is None and want is None) or abs(v - want) < 1e-12
    assert abs(whole - auc(y, s)) < 1e-12


def test_auc_of_negated_scores(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 500), np.round(rng.normal(size=500), 1)
    a = met.roc_auc(scored(spark, np.zeros(500), y, s), ["g"]).first()["auc_score"]
    b = met.roc_auc(scored(spark, np.zeros(500), y, -s), ["g"]).first()["auc_score"]
    assert abs(a + b - 1) < 1e-12


def test_multiclass_auc(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 4, 400)
    p = np.round(rng.dirichlet(np.ones(4), 400), 2)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(y, p)], "y int, proba array<double>")
    ovr = [auc((y == c).astype(int), p[:, c]) for c in range(4)]
    assert abs(met.roc_auc_ovr(df).first()[0] - np.mean(ovr)) < 1e-12
    weighted = np.average(ovr, weights=np.bincount(y))
    assert abs(met.roc_auc_ovr(df, average="weighted").first()[0] - weighted) < 1e-12
    pairs = []
    for a in range(4):
        for b in range(a + 1, 4):
            m = (y == a) | (y == b)
            pairs.append((auc((y[m] == a).astype(int), p[m, a]) + auc((y[m] == b).astype(int), p[m, b])) / 2)
    assert abs(met.roc_auc_ovo(df).first()[0] - np.mean(pairs)) < 1e-12


def test_regression_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "y double, prediction double")
    assert df.agg(met.mape()).first()[0] == pytest.approx(0.5 / 2.220446049250313e-16)
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, prediction double")
    assert flat.agg(met.r2()).first()[0] == 0.0
    assert flat.agg(met.rmse()).first()[0] == pytest.approx(np.sqrt(0.5))


def test_registry_rejects_unknown_task(spark):
    df = scored(spark, [0], [1], [0.5])
    with pytest.raises(ValueError):
        met.compute_metrics(df, "no such task", ["g"])


def vectors(spark, m, g=None):
    return spark.createDataFrame([(int(g[i]) if g is not None else 0, [float(x) for x in v]) for i, v in enumerate(m)],
                                 "g int, embedding array<double>")


def test_rank_me_and_alpha(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1])
    s = np.linalg.svd(m, compute_uv=False)
    p = s / s.sum() + 1e-7
    df = vectors(spark, m).repartition(7)
    assert gram.rank_me(df).first()[0] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-9)
    lam = s ** 2 / 300
    slope = np.polyfit(np.log(np.arange(1, 7)), np.log(lam), 1)[0]
    assert gram.alpha_req(df).first()[0] == pytest.approx(-slope, rel=1e-8)
    few = vectors(spark, m[:3])
    s = np.linalg.svd(m[:3], compute_uv=False)
    p = s / s.sum() + 1e-7
    assert gram.rank_me(few).first()[0] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-6)


def test_alpha_needs_two_eigenvalues(spark):
    df = vectors(spark, np.outer(np.arange(1, 5), [1.0, 0.0]))
    with pytest.raises(Exception, match="two eigenvalues"):
        gram.alpha_req(df).collect()


def test_grouped_spectra(spark):
    rng = np.random.default_rng(5)
    m, g = rng.normal(size=(200, 4)), rng.integers(0, 3, 200)
    got = {r["g"]: r["sigma"] for r in gram.singular_values(vectors(spark, m, g).repartition(6), by=["g"]).collect()}
    for k in range(3):
        assert np.allclose(got[k], np.linalg.svd(m[g == k], compute_uv=False))


def test_column_predictors(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(500, 4))
    m[:, 3] = 2 * m[:, 0] - m[:, 1] + 0.01 * rng.normal(size=500) + 5
    df = vectors(spark, m)
    model = gram.ColumnPredictors(df, "embedding", ridge=1e-10)
    got = np.array([r["predicted"] for r in model.predict(df).collect()])
    for j in range(4):
        x = np.column_stack([np.delete(m, j, 1), np.ones(500)])
        w, *_ = np.linalg.lstsq(x, m[:, j], rcond=None)
        assert np.allclose(got[:, j], x @ w, atol=1e-4)
    with pytest.raises(NotImplementedError):
        model.views(df, "sum")
    concat = np.array([r["embedding"] for r in model.views(df.withColumnRenamed("embedding", "e").withColumn(
        "embedding", F.col("e")), "concat", "embedding").collect()])
    assert concat.shape == (500, 16)


@pytest.mark.parametrize("n, d, rank", [(60, 10_000, 60), (80, 9_000, 7)])
def test_wide_vectors_without_a_square_matrix(spark, n, d, rank):
    rng = np.random.default_rng(d)
    m = rng.normal(size=(n, rank)) * 0.8 ** np.arange(rank) @ rng.normal(size=(rank, d))
    want = np.linalg.svd(m, compute_uv=False)
    p = want / want.sum() + 1e-7
    df = vectors(spark, m).repartition(3)
    assert gram.rank_me(df).first()[0] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-6)


@pytest.mark.parametrize("tile", [16, 1 << 20])
def test_the_spectrum_by_tiles_of_any_width(spark, tile):
    m = np.random.default_rng(5).normal(size=(40, 12)) * [9, 7, 5, 3, 2, 1, 1, 1, 0.1, 0.01, 0, 0]
    n, d, sigma = gram.wide_singular_values(vectors(spark, m), "embedding", tile_bytes=8 * 12 * tile // 4)
    assert (n, d) == (40, 12) and np.allclose(sigma, np.linalg.svd(m, compute_uv=False), atol=1e-6)
    by = gram.singular_values(vectors(spark, m, [i % 2 for i in range(40)]), by=["g"], widest=4)
    for r in by.collect():
        assert np.allclose(r["sigma"], np.linalg.svd(m[r["g"]::2], compute_uv=False), atol=1e-6)


@pytest.mark.parametrize("walk_rows", [1, 50, 200_000])
def test_one_walk_gives_both_multiclass_aucs(spark, monkeypatch, walk_rows):
    """Ties, slices of any size, a group key that is null, a class without rows and a group of one class."""
    monkeypatch.setattr(met, "WALK_ROWS", walk_rows)
    rng = np.random.default_rng(4)
    n = 900
    g = rng.choice(["a", "b", None, "one"], n)
    y = np.where(g == "one", 2, rng.integers(0, 3, n))
    p = np.round(rng.random((n, 4)), 1)
    p[rng.random(n) < 0.4] = 0.25
    df = spark.createDataFrame([(a, int(b), c.tolist()) for a, b, c in zip(g, y, p)], "g string, y int, proba array<double>").repartition(5)
    both = met.roc_auc_multiclass(df, ["g"])
    got = {r["g"]: (r["auc_score_ovr"], r["auc_score_ovo"]) for r in both.collect()}
    alone = {r["g"]: r["auc_score_ovo"] for r in met.roc_auc_ovo(df, ["g"]).collect()}
    assert set(got) == set(alone) == {"a", "b", None, "one"} and got["one"] == (None, None) and alone["one"] is None
    for name in ("a", "b", None):
        yy, pp = y[g == name], p[g == name]
        ovr = [auc((yy == c).astype(int), pp[:, c]) for c in range(4)]
        ovo = [auc((yy[(yy == a) | (yy == b)] == a).astype(int), pp[(yy == a) | (yy == b), a]) for a in range(3) for b in range(3) if a != b]
        assert abs(got[name][0] - np.mean([v for v in ovr if v is not None])) < 1e-12
        assert abs(got[name][1] - np.mean(ovo)) < 1e-12 and abs(alone[name] - np.mean(ovo)) < 1e-12


def test_the_multiclass_metrics_share_one_walk(spark):
    df = spark.createDataFrame([("a", 0, [0.7, 0.3]), ("a", 1, [0.2, 0.8])], "g string, y int, proba array<double>")
    plan = met.compute_metrics(df, met.MULTICLASS, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("MapInPandas") == 0
