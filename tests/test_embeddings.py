"""Scaling, sphere embedding, targets, clusters, reductions and the table vectoriser."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF, NGram
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import unit_point
from gaugeframe.operators import embed as emb, scaling as scl, sphere as sph


def numbers(spark, m, names=("a", "b")):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(m)], "id bigint, " + ", ".join(f"{n} double" for n in names))


def values(df, *cols):
    return np.array([[r[c] for c in cols] for r in df.orderBy("id").collect()], dtype=float)


def test_power_fit_reaches_the_best_likelihood(spark):
    rng = np.random.default_rng(0)
    m = np.column_stack([np.exp(rng.normal(size=800)), rng.normal(size=800) - 3])
    df = numbers(spark, m)
    model = scl.fit_power(df, ["a", "b"])
    for j, c in enumerate("ab"):
        x = m[:, j]

        def fit(lam):
            y = scl._yeo_johnson_values(x, lam)
            return -0.5 * len(x) * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

        grid = np.linspace(-4, 4, 8001)
        assert abs(model.lam[c] - grid[np.argmax([fit(v) for v in grid])]) < 3e-3
    out = values(model.apply(df), "a", "b")
    assert np.allclose(out.mean(0), 0, atol=1e-9) and np.allclose(out.std(0), 1, atol=1e-9)


def test_quantile_normal_and_chain(spark):
    rng = np.random.default_rng(1)
    m = rng.exponential(size=(2000, 2))
    m[:600, 1] = 0.5
    df = numbers(spark, m)
    out = values(scl.fit_quantile_normal(df, ["a"]).apply(df), "a")[:, 0]
    rank = (np.argsort(np.argsort(m[:, 0]))) / 1999
    want = np.array([NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in rank])
    assert np.abs(out - want)[(rank > 0.01) & (rank < 0.99)].max() < 0.02
    smooth = values(scl.fit_outlier_scaling(df, ["a", "b"], "quantile_rtdl", "id").apply(df), "a", "b")
    assert np.allclose(smooth.std(0), 1, atol=1e-6)
    for method in ("robust", "power", "quantile", "none"):
        assert values(scl.fit_outlier_scaling(df, ["a", "b"], method, clip=True).apply(df), "a", "b").shape == (2000, 2)
    with pytest.raises(ValueError):
        scl.fit_outlier_scaling(df, ["a"], "nope")


def test_constant_columns_do_not_divide_by_zero(spark):
    df = numbers(spark, np.column_stack([np.ones(10), np.arange(10)]))
    for fit in (scl.fit_standard, scl.fit_robust, scl.fit_power):
        assert np.isfinite(values(fit(df, ["a", "b"]).apply(df), "a", "b")).all()


def test_sphere_geometry():
    for dim in (2, 7, 8, 64):
        point, turn = sph.great_circle(dim, 42, "x")
        assert abs(np.linalg.norm(point) - 1) < 1e-12 and abs(point @ turn) < 1e-12
        assert abs(np.linalg.norm(turn) - 1) < 1e-12


def test_sphere_missing_constant_and_unseen(spark):
    df = spark.createDataFrame([(0, 1.0, "x", 5.0), (1, 3.0, "y", 5.0), (2, None, None, 5.0)], "id int, n double, c string, k double")
    model = sph.fit_sphere(df, ["n", "c", "k"], ["c"], 6)
    got = values(model.transform(df).select("id", *[F.col("embedding")[i].alias(str(i)) for i in range(6)]), *map(str, range(6)))
    point, turn = sph.great_circle(6, 42, "n")
    first = math.sin(0.1 * math.pi) * point + math.cos(0.1 * math.pi) * turn + unit_point(6, 42, "c", "x")
    assert np.allclose(got[0], first / 3)
    assert np.allclose(got[2], 0)
    new = spark.createDataFrame([(9, 2.0, "never seen", 5.0)], "id int, n double, c string, k double")
    assert np.linalg.norm(model.transform(new).first()["embedding"]) > 0
    with pytest.raises(ValueError):
        model.transform(new.drop("c"))


def test_sphere_does_not_depend_on_partitioning(spark):
    df = spark.range(500).select("id", (F.col("id") * 1.5).alias("n"), (F.col("id") % 9).cast("string").alias("c"))
    model = sph.fit_sphere(df, ["n", "c"], ["c"], 8)
    a, b = model.transform(df.repartition(9)), sph.fit_sphere(df.coalesce(1), ["n", "c"], ["c"], 8).transform(df.coalesce(1))
    assert a.exceptAll(b).count() == 0


def test_fitted_sphere_runs_on_a_stream(spark, tmp_path):
    spark.range(100).select("id", F.col("id").cast("double").alias("n")).write.parquet(str(tmp_path / "in"))
    static = spark.read.parquet(str(tmp_path / "in"))
    model = sph.fit_sphere(static, ["n"], [], 4)
    q = model.transform(spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory") \
        .queryName("sphere_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sphere_stream").exceptAll(model.transform(static)).count() == 0


def test_targets(spark):
    ids = spark.range(4000)
    for kind, mean in (("standard_normal", 0), ("integers", 4.5), ("binomial", 5), ("poisson", 1), ("geometric", 2)):
        got = ids.select(F.avg(emb.random_target(kind, "id"))).first()[0]
        assert abs(got - mean) < 0.15, kind
    with pytest.raises(ValueError):
        emb.random_target("cauchy", "id")
    assert len(emb.random_targets(ids, "id", 3).first()["targets"]) == 3


def blobs(spark, seed=0, centres=((0, 0), (0, 1), (10, 10), (10, 11), (-9, 5))):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.array(centres[i % len(centres)]) + 0.05 * rng.normal(size=2)], i % len(centres)) for i in range(250)]
    return spark.createDataFrame(rows, "id bigint, embedding array<double>, cluster int")


def test_merge_clusters_keeps_noise(spark):
    df = blobs(spark).withColumn("cluster", F.when(F.col("id") < 5, -1).otherwise(F.col("cluster")))
    got = emb.merge_clusters(df, max_clusters=3)
    pairs = {(r["cluster"], r["merged"]) for r in got.collect()}
    table = dict(pairs)
    assert len(pairs) == 6 and table[-1] == -1
    assert table[0] == table[1] and table[2] == table[3] and len({table[0], table[2], table[4]}) == 3
    same = emb.merge_clusters(df, max_clusters=5)
    assert same.filter("cluster <> merged").count() == 0


def test_cluster_targets_formula(spark):
    df = blobs(spark)
    rows = df.collect()
    m, c = np.array([r["embedding"] for r in rows]), np.array([r["cluster"] for r in rows])
    cent = np.array([m[c == k].mean(0) for k in range(5)])
    d = np.linalg.norm(m[:, None] - cent[None], axis=2)
    got = np.array([r["targets"] for r in emb.cluster_distance_targets(df, df, ("std", "min", "mean")).collect()])
    assert np.allclose(got, np.column_stack([-d.min(1), -d.mean(1), d.std(1)]))
    with pytest.raises(ValueError):
        emb.cluster_distance_targets(df, df, ("max",))


def test_clustering_and_assignment(spark):
    df = blobs(spark)
    for bisecting in (False, True):
        train = emb.fit_clusters(df.drop("cluster"), k=3, bisecting=bisecting)
        new = emb.assign_clusters(train, df.drop("cluster"), "id", "embedding")
        both = train.join(new.withColumnRenamed("q", "id").withColumnRenamed("cluster", "again"), "id")
        assert both.filter("cluster <> again").count() == 0
    noisy = emb.fit_clusters(df.drop("cluster"), k=3, far_share=0.1)
    assert 10 <= noisy.filter("cluster = -1").count() <= 40


def test_views(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 6.0])], "row_id int, view int, embedding array<double>")
    assert emb.aggregate_views(v, "mean").first()["embedding"] == [2.0, 4.0]
    assert emb.aggregate_views(v, "concat").first()["embedding"] == [1.0, 2.0, 3.0, 6.0]
    assert emb.aggregate_views(v, "first_element").first()["embedding"] == [1.0, 2.0]
    with pytest.raises(NotImplementedError):
        emb.aggregate_views(v, "max")


def test_pca_is_centred(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 5)) * [5, 2, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id bigint, embedding array<double>")
    got = np.array([r["reduced"] for r in emb.reduce_pca(df, k=2).orderBy("id").collect()])
    u, s, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    want = (m - m.mean(0)) @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    k = emb.reduce_kernel_pca(df, k=2, gamma=0.1).first()["reduced"]
    assert len(k) == 2


def test_fourier_map_approximates_the_kernel():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 3))
    z = emb.fourier_map(3, 20000, 0.3)(x)
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_vectorizer(spark):
    df = spark.range(100).select("id", (F.col("id") * 2.0).alias("n"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("few"),
                                 F.concat(F.lit("name "), F.col("id").cast("string")).alias("many"), F.to_timestamp(F.lit("2024-03-04 05:06:07")).alias("at"))
    vec = emb.TableVectorizer(["n", "few", "many", "at"], hash_size=64, components=4)
    with pytest.raises(ValueError):
        vec.transform(df)
    got = vec.fit(df).transform(df)
    sizes = {len(r["embedding"]) for r in got.collect()}
    assert len(sizes) == 1
    unseen = df.limit(1).withColumn("few", F.lit("other")).withColumn("n", F.lit(None).cast("double"))
    assert len(vec.transform(unseen).first()["embedding"]) in sizes


def test_trigram_slots_are_those_of_spark_ml(spark, monkeypatch):
    """Without a Java object per character: no character array, no n-grams in the plan."""
    texts = ["", None, "ab", "abc", "ABCabc  abc", "Größe \u4f60\u597d\U0001f600 straße", "\0a\0b", "x" * 70, "na\u00efve caf\u00e9 " * 40,
             "".join(chr(0x4e00 + i % 400) for i in range(900))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    chars = df.withColumn("c", F.split(F.lower(F.coalesce("t", F.lit(""))), ""))
    grams = NGram(n=3, inputCol="c", outputCol="g").transform(chars)
    want = {r["id"]: r["h"] for r in HashingTF(numFeatures=64, inputCol="g", outputCol="h").transform(grams).collect()}
    made = emb.with_trigrams(df, "t", "h", 64)
    assert made.columns == ["id", "t", "h"] and "split(" not in made._jdf.queryExecution().toString()
    assert {r["id"]: r["h"] for r in made.collect()} == want

    monkeypatch.setattr(emb, "TRIGRAM_CHARS", 50)
    for rows in (1, 3, 1000):
        monkeypatch.setattr(emb, "TRIGRAM_ROWS", rows)
        runs = emb._runs([(t or "").lower() for t in texts])
        many, slots, counts = (np.concatenate(c) for c in zip(*(emb._trigram_counts(some, 64) for some in runs)))
        for at, (a, b) in enumerate(zip(np.cumsum(many) - many, np.cumsum(many))):
            assert dict(zip(slots[a:b].tolist(), counts[a:b].tolist())) == dict(zip(want[at].indices.tolist(), want[at].values.tolist()))


def test_many_valued_texts_are_told_by_hashes(spark):
    df = spark.range(60).select(F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias("_t_few"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("_t_many"),
                                F.concat(F.lit("x"), (F.col("id") % 40).cast("string")).alias("_t_40"))
    vec = emb.TableVectorizer([])
    assert vec._many_valued(df, ["_t_few", "_t_many", "_t_40"]) == ["_t_many"] and vec._many_valued(df, []) == []


def test_pooling_needs_equal_lengths(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<double>")
    b = spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>")
    assert {r["label"] for r in emb.pool_embeddings([a, a]).collect()} == {0, 1}
    with pytest.raises(ValueError):
        emb.pool_embeddings([a, b])
