"""Admission, typing, encoding, splits and order on edge frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import admission as adm, aggregates as agg, encoding as enc, projections as prj, ranks, splits as spl

INF, NAN = float("inf"), float("nan")


def test_bounds_are_inclusive(spark):
    prof = spark.createDataFrame([("a", 10, 5), ("b", 11, 5), ("c", 11, 6)], "dataset string, num_samples int, num_features int")
    got = {r["dataset"]: r["reason"] for r in adm.admit_datasets(prof, 10, 5, deny=["a"]).collect()}
    assert got["a"] == "excluded by name"
    assert got["c"].split(" | ") == ["too many samples: 11 > 10", "too many features: 6 > 5"]
    fits = [r[0] for r in prof.select(adm.model_fits(F.lit(10), F.lit(None).cast("int"))).collect()]
    assert fits == [True, False, False]


def test_invalid_embeddings(spark):
    ragged = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    nan = spark.createDataFrame([([1.0, NAN],)], "embedding array<double>")
    null = spark.createDataFrame([(None,), ([1.0],)], "embedding array<double>")
    for bad in (ragged, nan, null):
        with pytest.raises(ValueError):
            adm.require_valid_embeddings(bad)
    ok = spark.createDataFrame([([1.0],)], "embedding array<double>")
    assert adm.require_valid_embeddings(ok.filter("false")).count() == 0
    assert adm.require_valid_embeddings(ok).count() == 1
    with pytest.raises(ValueError):
        adm.require_finite(nan, "embedding")
    with pytest.raises(ValueError):
        adm.require_finite(ok.withColumn("y", F.lit(NAN)), "embedding", "y")


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 1.0), (1, None, None, 2.0)], "a int, b int, c string, d double")
    kept, kinds = prj.drop_constant_columns(df, {"a": False, "b": False, "c": True, "d": False})
    assert kept.columns == ["d"] and kinds == {"d": False}


def test_value_and_column_coercion(spark):
    df = spark.createDataFrame([("1", "1", INF), ("x", "2", NAN), (None, "inf", -INF), ("2.5", None, 3.0)], "a string, b string, c double")
    got = [r["a"] for r in df.select(enc.to_number("a").alias("a")).collect()]
    assert got == [1.0, None, None, 2.5]
    kinds = enc.resolve_kinds(df, ["a", "b", "c"])
    assert kinds.categorical == ("a",) and kinds.numeric == ("b", "c")
    rows = kinds.apply(df).collect()
    assert [r["b"] for r in rows] == [1.0, 2.0, None, None]
    assert [r["c"] for r in rows] == [None, None, None, 3.0]
    assert enc.resolve_kinds(df, ["b"], ["b"]).categorical == ("b",)


def test_label_codes(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "y string")
    codes = enc.fit_label_codes(train, "y")
    assert {r["y"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        enc.apply_label_codes(spark.createDataFrame([("z",)], "y string"), codes, "y")


def test_first_seen_codes_unseen_and_missing(spark):
    train = spark.createDataFrame([(0, "q"), (1, "a"), (2, None), (3, "q")], "id int, v string")
    codes = enc.fit_first_seen_codes(train, "v", "id")
    test = spark.createDataFrame([("a",), ("q",), (None,), ("new",)], "v string")
    assert [r["code"] for r in enc.apply_codes(test, codes, "v").orderBy(F.col("v").asc_nulls_last()).collect()] == [1, -1, 0, -1]


def test_infer_categorical(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("few"), F.col("id").alias("many"), (F.col("id") % 30).alias("thirty"))
    got = {r["column"]: r["is_categorical"] for r in enc.infer_categorical(df, ["few", "many", "thirty"]).collect()}
    assert got == {"few": True, "many": False, "thirty": False}
    got = {r["column"]: r["is_categorical"] for r in enc.infer_categorical(df, ["few", "many", "thirty"], ["many", "thirty"]).collect()}
    assert got == {"few": False, "many": False, "thirty": True}


def test_edge_labels_keep_missing(spark):
    df = spark.createDataFrame([(0.04,), (0.05,), (0.1,), (0.5,), (None,)], "r double")
    got = [r[0] for r in df.select(prj.edge_label("r", [0.05, 0.1])).collect()]
    assert got == ["<0.05", "[0.05,0.1)", ">=0.1", ">=0.1", None]


@pytest.mark.parametrize("limit", [10**6, 50])
def test_numbering_and_folds_do_not_depend_on_slices(spark, limit):
    df = spark.range(1000).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    got = [r["pos"] for r in ranks.number_rows(df, ["id"], "pos", ["y"], one_task_rows=limit).orderBy("y", "id").collect()]
    assert got == list(range(857)) + list(range(143))
    folds = spl.stratified_folds(df, "id", 5, "y", one_task_rows=limit)
    again = spl.stratified_folds(df.repartition(13), "id", 5, "y", one_task_rows=10**6)
    assert folds.select("id", "fold").exceptAll(again.select("id", "fold")).count() == 0
    for r in folds.groupBy("y").pivot("fold").count().collect():
        assert max(r[1:]) - min(r[1:]) <= 1


@pytest.mark.parametrize("limit", [10**6, 100, 10])
def test_quantiles_with_skew_ties_and_missing_groups(spark, limit):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=2000), np.zeros(1500), 1e9 * rng.random(3), 1e-9 * rng.random(700)]
    g = [None if i % 5 == 0 else int(i % 3) for i in range(len(x))]
    rows = [(a, float(b)) for a, b in zip(g, x)] + [(0, NAN), (0, None)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = (0.0, 0.1, 0.5, 0.777, 1.0)
    got = {r["g"]: [r[f"q{i}"] for i in range(5)] for r in ranks.exact_quantiles(df, ["x"], probs, ["g"], one_task_rows=limit).collect()}
    assert set(got) == {None, 0, 1, 2}
    for k, q in got.items():
        assert np.allclose(q, np.quantile(x[[a == k for a in g]], probs), rtol=1e-12, atol=0)
    many = ranks.quantile_arrays(df, ["x"], [i / 200 for i in range(201)], one_task_rows=limit).first()["q"]
    assert np.allclose(many, np.quantile(x, np.arange(201) / 200), rtol=1e-12, atol=0)


def test_splits(spark):
    df = spark.createDataFrame([(1, "test"), (2, "train"), (3, None), (4, "x")], "id int, set string")
    assert [r[0] for r in df.select(spl.role_by_column()).collect()] == ["test", "train", "train", "train"]
    ids = spark.range(20000)
    share = ids.select(spl.role_by_hash("id").alias("r")).filter("r = 'test'").count() / 20000
    assert abs(share - 0.2) < 0.01
    tasks = spark.createDataFrame([("a", 2499, 3), ("b", 2500, 3), ("c", 250000, 3), ("d", 250001, 3)], "d string, num_samples int, folds int")
    got = {r["d"]: r["count"] for r in spl.expand_folds(tasks).groupBy("d").count().collect()}
    assert got == {"a": 30, "b": 9, "c": 9, "d": 3}
    assert spl.expand_folds(tasks, lite=True).count() == 4


def test_collections(spark):
    tasks = spark.range(37).withColumnRenamed("id", "task_id")
    got = spl.random_collections(tasks, num_collections=50).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["collection"], []).append(r["task_id"])
    assert len(sizes) == 50
    assert all(2 <= len(v) < 10 and len(set(v)) == len(v) for v in sizes.values())
    with pytest.raises(ValueError):
        spl.random_collections(tasks.limit(1))


def test_coverage(spark):
    rows = [("d1", "m1", "a"), ("d1", "m2", "a"), ("d2", "m1", "a"), ("d2", "m1", "b"), ("d2", "m2", "a")]
    df = spark.createDataFrame(rows, "dataset_name string, embedding_model string, algorithm string")
    kept, gone = agg.clean_results(df)
    assert {r[0] for r in kept.select("dataset_name").collect()} == {"d1"}
    assert [r[0] for r in gone.collect()] == ["d2"]
