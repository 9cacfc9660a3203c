"""Outlier scores, searched evaluators, plug-ins, readers, writers and jobs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import embed as emb, outliers as out, tuned
from gaugeframe.operators.metrics import BINARY, MULTICLASS, OUTLIER, REGRESSION
from gaugeframe.plans import jobs, plugins as pl
from gaugeframe.sources import sinks, tables as src


def matrix(spark, m, **extra):
    rows = [(i, [float(x) for x in r], *[extra[k][i] for k in extra]) for i, r in enumerate(m)]
    kinds = "".join(f", {k} {'double' if isinstance(v[0], float) else 'int'}" for k, v in extra.items())
    return spark.createDataFrame(rows, "row_id bigint, embedding array<double>" + kinds)


def test_expected_path():
    assert out.expected_path(1) == 0 and out.expected_path(2) == 1
    assert out.expected_path(256) == pytest.approx(10.244770920, abs=1e-6)


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    m = np.vstack([rng.normal(size=(600, 3)), [[9, 9, 9]]])
    df = matrix(spark, m)
    a = {r["row_id"]: r["prediction"] for r in out.isolation_forest(df, trees=40).collect()}
    b = {r["row_id"]: r["prediction"] for r in out.isolation_forest(df.repartition(11), trees=40).collect()}
    assert a == b
    assert max(a, key=a.get) == 600 and all(-0.5 <= v <= 0.5 for v in a.values())
    c = [r["prediction"] for r in out.isolation_forest(df, trees=40, contamination=0.1).collect()]
    assert 0.05 < np.mean(np.array(c) > 0) < 0.12
    with pytest.raises(ValueError):
        out.isolation_forest(df, contamination=0.7)


def test_tree_samples_are_bounded_and_whole(spark):
    big = spark.range(20000).withColumn("g", (F.col("id") % 3 == 0).cast("int")).withColumn("embedding", F.array(F.col("id").cast("double")))
    got = out.tree_samples(big, "id", 5, 64, 1, ["g"]).groupBy("g", "tree").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert len(got) == 10 and all(r["n"] == 64 and r["d"] == 64 for r in got)
    small = out.tree_samples(big.filter("id < 30"), "id", 5, 64, 1).groupBy("tree").count().collect()
    assert len(small) == 5 and all(r["count"] == 30 for r in small)


def test_every_row_is_as_likely_in_a_tree_sample(spark):
    rows = spark.range(3000).select(F.col("id").alias("row_id"))
    got = out.tree_samples(rows, "row_id", 300, 100, 7).toPandas()
    assert (got.groupby("tree").size() == 100).all() and got["tree"].nunique() == 300
    share = got.groupby("row_id").size().reindex(range(3000), fill_value=0)  # of 300 trees, each with chance 1/30
    assert abs(share.mean() - 10) < 1e-9 and 8.2 < share.var() < 11.2  # binomial: 9.67
    near = got.pivot_table(index="row_id", columns="tree", values="_rank", aggfunc="size", fill_value=0)
    both = (near[range(0, 299)].to_numpy() * near[range(1, 300)].to_numpy()).sum() / 299  # neighbouring trees share 100 * 100 / 3000 rows
    assert 3.0 < both < 3.7
    again = out.tree_samples(rows.repartition(13), "row_id", 300, 100, 7).toPandas()
    assert set(map(tuple, got.to_numpy())) == set(map(tuple, again[got.columns].to_numpy()))


def test_forest_scores_in_dataset_batches(spark):
    rng = np.random.default_rng(1)
    df = matrix(spark, rng.normal(size=(300, 2)), g=[i % 6 for i in range(300)])
    a = out.isolation_forest(df, trees=10, max_samples=32, by=["g"])
    b = out.isolation_forest(df, trees=10, max_samples=32, by=["g"], slice_rows=7)
    assert a.exceptAll(b).count() == 0 and a.count() == 300


def test_centre_distance(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(200, 4)) * [1, 5, 10, 0.1]
    m[:, 3] = 3.0
    got = out.centre_distance(matrix(spark, m), contamination=0.1).orderBy("row_id").collect()
    z = (m - m.mean(0)) / np.where(m.std(0) < 1e-9, 1, m.std(0))
    assert np.allclose([r["prediction"] for r in got], (z ** 2).sum(1))
    assert sum(r["is_outlier"] for r in got) == 20
    for bad in (0.6, -0.1):
        with pytest.raises(ValueError):
            out.centre_distance(matrix(spark, m), contamination=bad)


def classification(spark, n=120, classes=3):
    rng = np.random.default_rng(42)
    y = rng.integers(0, classes, n)
    return matrix(spark, rng.normal(size=(n, 4)) + 2.0 * y[:, None], y=[int(v) for v in y])


SMALL = {
    tuned.LogisticEvaluator: {"max_iter": tuned.Fixed(20)},
    tuned.PerceptronEvaluator: {"n_layers": tuned.Whole(1, 2), "max_iter": tuned.Fixed(20), "learning_rate_init": tuned.Fixed(0.01),
                                "batch_size": tuned.Fixed(16)},
    tuned.KernelSVMEvaluator: {},
    tuned.KNNSearchEvaluator: {"n_neighbors": tuned.Whole(5, 10, step=5)},
}


@pytest.mark.parametrize("cls", list(SMALL), ids=lambda c: c.__name__)
def test_search_contract(spark, cls):
    train = classification(spark)
    ev = cls(n_trials=2, cv_folds=2, overrides=SMALL[cls])
    assert ev.best_params is None and ev.history(spark) is None
    with pytest.raises(ValueError):
        ev.predict(train)
    with pytest.raises(ValueError):
        ev.fit_best()
    with pytest.raises(ValueError):
        ev.fit(train.drop("y"))
    got = ev.fit(train).predict(train.drop("y")).collect()
    assert len(got) == 120
    assert all(abs(sum(r["proba"]) - 1) < 1e-6 and len(r["proba"]) == 3 for r in got)
    truth = {r["row_id"]: r["y"] for r in train.collect()}
    assert np.mean([truth[r["row_id"]] == r["prediction"] for r in got]) > 0.6
    assert ev.history(spark).count() == 2
    params = ev.parameters()
    assert params["best_cv_score"] == ev.best_score and any(k.startswith("best_") for k in params)
    ev.reset()
    assert ev.best_model is None and ev.history(spark) is None


@pytest.mark.parametrize("classes", [2, 3])
def test_many_logistic_models_equal_single_fits(spark, classes):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from gaugeframe.operators import many_models as mm
    from gaugeframe.staging import stage
    df = classification(spark, 150, classes).withColumns({
        "fold": (F.col("row_id") % 3).cast("int"), "w_balanced": F.when(F.col("y") == 0, 3.0).otherwise(0.7)})
    rows = stage(df.repartition(5).select("embedding", "y", "fold", "w_balanced"), "many")
    tasks = [mm.LogisticTask(f, lam, bal, 300) for f in range(3) for lam, bal in ((1.0, False), (1e-2, True), (1e-4, False))]
    coef = mm.fit_logistic_models(rows, tasks, 4, classes)
    counts = mm.held_out_counts(rows, tasks, coef, classes)
    assert counts.sum((1, 2)).tolist() == [50] * 9
    vectors = df.withColumn("v", array_to_vector("embedding")).withColumn("one", F.lit(1.0))
    for task, c in list(zip(tasks, coef))[:4]:
        one = LogisticRegression(featuresCol="v", labelCol="y", regParam=task.penalty, standardization=False, maxIter=300, tol=1e-9,
                                 weightCol="w_balanced" if task.balanced else "one", family="auto").fit(vectors.filter(F.col("fold") != task.fold))
        want = np.vstack([one.coefficientMatrix.toArray().T, one.interceptVector.toArray()])
        got = c - (c.mean(axis=1, keepdims=True) if classes > 2 else 0)
        assert np.allclose(got[:-1], want[:-1], atol=0.02 * np.abs(want).max())
    f1 = mm.weighted_f1(counts)
    p, r = counts[0].diagonal() / counts[0].sum(0), counts[0].diagonal() / counts[0].sum(1)
    assert f1[0] == pytest.approx((2 * p * r / (p + r) * counts[0].sum(1)).sum() / 50)


def test_binary_kernel_svm_and_regressor(spark):
    ev = tuned.KernelSVMEvaluator(n_trials=1, cv_folds=2)
    got = ev.fit(classification(spark, classes=2)).predict(classification(spark, classes=2)).collect()
    assert all(len(r["proba"]) == 2 for r in got)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(150, 3))
    df = matrix(spark, m, y=[float(v) for v in m[:, 0] * 3 + 1])
    reg = tuned.BoostedRegressor(n_trials=1, cv_folds=2, overrides={"max_iter": tuned.Fixed(10)})
    pred = {r["row_id"]: r["prediction"] for r in reg.fit(df).predict(df).collect()}
    assert np.corrcoef([pred[i] for i in range(150)], m[:, 0])[0, 1] > 0.8 and reg.best_score < 0


def test_drawn_trials():
    space = tuned.PerceptronEvaluator().search_space()
    a, b = tuned.draw_trial(space, 3), tuned.draw_trial(dict(reversed(space.items())), 3)
    assert a == b and "n_layers" not in a and all(32 <= h <= 512 for h in a["hidden_layer_sizes"])
    ks = {tuned.draw_trial(tuned.KNNSearchEvaluator().search_space(), t)["n_neighbors"] for t in range(200)}
    assert min(ks) == 5 and max(ks) == 100 and all(k % 5 == 0 for k in ks)
    with pytest.raises(TypeError):
        tuned.draw_trial({"x": {"type": "uniform"}}, 0)


# ---- readers and writers -----------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    for name, n in (("one", 10), ("two", 5000), ("skip", 3)):
        np.savez(tmp_path / f"{name}.npz", X=rng.normal(size=(n, 3)), y=np.arange(n) % 2)
    got = src.read_matrix_archives(spark, str(tmp_path), exclude=["skip"])
    assert {r["dataset"]: r["count"] for r in got.groupBy("dataset").count().collect()} == {"one": 10, "two": 5000}
    assert got.select("dataset", "row_id").distinct().count() == 5010
    np.savez(tmp_path / "bad.npz", X=np.array([{"a": 1}], dtype=object), y=np.array([0]))
    with pytest.raises(Exception, match="allow_pickle"):
        src.read_matrix_archives(spark, str(tmp_path)).count()


def test_collections_errors(spark, tmp_path):
    good = {"c0": {"selected_task_ids_str": "3_1", "selected_task_ids": [3, 1]}}
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert src.read_collections(spark, str(tmp_path / "good.json")).first()["selected_task_ids"] == [3, 1]
    with pytest.raises(FileNotFoundError):
        src.read_collections(spark, str(tmp_path / "none.json"))
    (tmp_path / "broken.json").write_text('{"c0": ')
    with pytest.raises(ValueError, match="is not JSON"):
        src.read_collections(spark, str(tmp_path / "broken.json"))
    for i, bad in enumerate(({"c0": {"selected_task_ids_str": "1"}}, {"c0": {"selected_task_ids_str": "1", "selected_task_ids": "x"}})):
        (tmp_path / f"schema{i}.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError, match="lacks a field"):
            src.read_collections(spark, str(tmp_path / f"schema{i}.json")).collect()


def test_save_table_flattens_nested(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0], {"k": "v"})], "a int, e array<double>, p map<string,string>")
    parquet, csv = sinks.save_table(df, str(tmp_path), "results", "ts")
    assert spark.read.parquet(parquet).first()["e"] == [1.0, 2.0]
    assert spark.read.option("header", True).option("escape", '"').csv(csv).first()["e"] == "[1.0,2.0]"


def test_csv_without_key_gets_fixed_ids(spark, tmp_path):
    spark.range(50).withColumn("v", F.col("id") * 2).write.option("header", True).csv(str(tmp_path / "c"))
    got = src.read_csv_dataset(spark, str(tmp_path / "c"))
    assert got.select("row_id").distinct().count() == 50


# ---- jobs --------------------------------------------------------------------------------------------------------


def small_data(spark, n=160):
    rng = np.random.default_rng(3)
    rows = [(i, "d%d" % (i % 2), float(rng.normal() + 3 * (i % 3)), "k%d" % (i % 4), "c%d" % (i % 3 if i % 2 else i % 4 // 2)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id bigint, dataset string, n double, c string, target string")


SPEC = pl.TableSpec(("n", "c"), ("c",), "row_id", "target", "dataset")


def test_plugins_refuse_direct_prediction():
    with pytest.raises(NotImplementedError):
        pl.SphereEmbedder().predict(None, SPEC, "run", BINARY, 2)


def test_supervised_job_with_gates_external_and_search(spark, tmp_path):
    data = small_data(spark)
    splits = data.select("dataset", "row_id", F.lit(0).alias("repeat"), F.lit(0).alias("fold"),
                         F.when(F.col("row_id") % 5 == 0, "test").otherwise("train").alias("role"))
    tasks = data.select("dataset").distinct().withColumn("task_type", F.lit(MULTICLASS)).withColumn("folds", F.lit(1))

    def lengths(context, rows):
        return [[v, 1.0] for v in rows["n"]]

    got = jobs.supervised_benchmark(
        data, splits, tasks, SPEC, [pl.SphereEmbedder(dim=8), pl.ExternalEmbedder(fn=lengths, context_rows=20)],
        [pl.KNNClassifier(k=5), pl.Tuned(make=lambda: tuned.KNNSearchEvaluator(n_trials=2, cv_folds=2, overrides={
            "n_neighbors": tuned.Fixed(5)}))],
        lite=True, measure_rank=True, save_to=str(tmp_path / "saved"))
    rows = got.results.collect()
    assert {(r["embedding_model"], r["dataset_name"], r["algorithm"]) for r in rows} == {
        (m, d, a) for m in ("Sphere", "External") for d in ("d0", "d1") for a in ("KNNClassifier", "Tuned")}
    assert {r["task"] for r in rows} == {BINARY, MULTICLASS}
    assert got.metadata.filter("rank_me > 0").count() == 4
    assert spark.read.parquet(str(tmp_path / "saved")).count() == len(rows)
    none = jobs.supervised_benchmark(data, splits, tasks, SPEC, [pl.SphereEmbedder()], [pl.KNNClassifier()], max_samples=10)
    assert none.results is None and none.skipped.count() == 2


@pytest.mark.parametrize("slice_rows", [7, 10_000])
def test_external_model_sees_a_bounded_context_and_every_row(spark, slice_rows):
    rows = small_data(spark).withColumn("run", F.col("dataset")).withColumn("role", F.when(F.col("row_id") % 4 > 1, "test").otherwise("train"))
    seen = pl.ExternalEmbedder(fn=lambda context, rows: [[len(context), v] for v in rows["n"]], context_rows=10, slice_rows=slice_rows)
    got = seen.embed(rows, SPEC, "run").collect()
    assert sorted(r["row_id"] for r in got) == list(range(160)) and {r["embedding"][0] for r in got} == {10.0}
    assert all(r["embedding"][1] == r["n"] for r in got)


def test_constant_columns_are_dropped_per_dataset(spark):
    data = small_data(spark).withColumn("flat", F.when(F.col("dataset") == "d0", F.lit(5.0)).otherwise(F.col("n") * 2))
    spec = pl.TableSpec(("n", "flat", "c"), ("c",), "row_id", "target", "dataset")
    masked = jobs._mask_constants(data, spec)
    assert {(r["dataset"], r[pl.KEPT], r["x"]) for r in masked.groupBy("dataset", pl.KEPT).agg(F.count("flat").alias("x")).collect()} == {
        ("d0", 2, 0), ("d1", 3, 80)}
    run = masked.withColumn("run", F.col("dataset"))
    got = pl.SphereEmbedder(dim=8).embed(run, spec, "run").filter("dataset = 'd0'").orderBy("row_id").collect()
    plain = pl.SphereEmbedder(dim=8).embed(run.drop(pl.KEPT, "flat"), SPEC, "run").filter("dataset = 'd0'").orderBy("row_id").collect()
    assert np.allclose([r["embedding"] for r in got], [r["embedding"] for r in plain])


def test_a_failing_run_is_told_and_the_others_go_on(spark):
    data = small_data(spark).withColumn("target", F.when(F.expr("row_id = 0"), "only here").otherwise(F.col("target")))
    splits = data.select("dataset", "row_id", F.lit(0).alias("repeat"), F.lit(0).alias("fold"),
                         F.when(F.col("row_id") % 5 == 0, "test").otherwise("train").alias("role"))
    tasks = data.select("dataset").distinct().withColumn("task_type", F.lit(MULTICLASS)).withColumn("folds", F.lit(1))

    class Broken(pl.ScaledEmbedder):
        name = "Broken"

        def embed(self, rows, spec, run):
            return super().embed(rows, spec, run).withColumn("embedding", F.when(F.col(spec.row_id) == 1, F.array(F.lit(float("nan"))))
                                                             .otherwise(F.col("embedding")))

    got = jobs.supervised_benchmark(data, splits, tasks, SPEC, [pl.SphereEmbedder(dim=8), Broken(name="Broken")], [pl.KNNClassifier()], lite=True)
    assert {(r["embedding_model"], r["dataset_name"]) for r in got.results.collect()} == {("Sphere", "d1")}
    told = {(r["run"], r["stage"]): r["reason"] for r in got.errors.collect()}
    assert "1 labels missing" in told["d0|0|0", MULTICLASS] and "invalid vectors: 1 of 80" in told["d1|0|0", "Broken"]


def test_suite_isolates_failures(spark):
    def fails():
        raise RuntimeError("no")

    outcomes, errors = jobs.run_suite(spark, {"bad": fails, "good": lambda: jobs.Outcome(spark.range(1))})
    assert outcomes["bad"].results is None and outcomes["good"].results.count() == 1
    assert [r["error"] for r in errors.collect()] == ["RuntimeError"]


def test_single_dataset_job(spark, tmp_path):
    data = small_data(spark).withColumn("set", F.when(F.col("row_id") % 5 == 0, "test")).drop("dataset")
    data.write.option("header", True).csv(str(tmp_path / "one"))
    schema = "row_id bigint, n double, c string, target string, set string"
    got = jobs.single_dataset_benchmark(spark, str(tmp_path / "one"), "target", MULTICLASS, [pl.SphereEmbedder(dim=8)],
                                        [pl.KNNClassifier()], schema=schema, key="row_id", categorical=["c"]).results.first()
    assert got["task"] == MULTICLASS and 0 <= got["auc_score"] <= 1
    reg = jobs.single_dataset_benchmark(spark, str(tmp_path / "one"), "n", REGRESSION, [pl.SphereEmbedder(dim=8)],
                                        [pl.KNNRegressor()], schema=schema, key="row_id", categorical=["c", "target"]).results.first()
    assert reg["mape_score"] > 0


def test_outlier_job_skips_and_excludes(spark):
    data = small_data(spark).withColumn("target", (F.col("row_id") % 10 == 0).cast("int"))
    got = jobs.outlier_benchmark(data, SPEC, [pl.ScaledEmbedder()], [pl.LocalOutlierFactor(k=5)], exclude=["d1"])
    assert {r["dataset_name"] for r in got.results.collect()} == {"d0"}
    assert got.skipped.first()["reason"] == "excluded by name"
    assert got.results.first()["task"] == OUTLIER


def test_steps_that_are_saved_again_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "results")
    lines = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.6)], "embedding_model string, algorithm string, auc double")
    sinks.append_results(lines, path, "outlier", "t1", sinks.step_name("m", {"k": 5}))
    sinks.append_results(lines, path, "outlier", "t1", sinks.step_name("m", {"k": 10}))
    sinks.append_results(lines, path, "outlier", "t2", sinks.step_name("m", {"k": 5}))
    sinks.append_results(lines.limit(1), path, "outlier", "t1", sinks.step_name("m", {"k": 5}))
    got = spark.read.parquet(path)
    assert {(r["run_ts"], r["step"]): r["count"] for r in got.groupBy("run_ts", "step").count().collect()} == {
        ("t1", sinks.step_name("m", {"k": 5})): 1, ("t1", sinks.step_name("m", {"k": 10})): 2, ("t2", sinks.step_name("m", {"k": 5})): 2}


def test_a_repeated_job_leaves_every_line_once(spark, tmp_path):
    data = small_data(spark).withColumn("target", (F.col("row_id") % 10 == 0).cast("int"))
    path = str(tmp_path / "job")
    for _ in range(2):
        got = jobs.outlier_benchmark(data, SPEC, [pl.ScaledEmbedder()], [pl.LocalOutlierFactor(k=5), pl.LocalOutlierFactor(k=7)], save_to=path, run_ts="t")
    assert spark.read.parquet(path).count() == got.results.count() == 4


def test_runs_are_fitted_side_by_side(spark):
    import threading
    rows = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 12).cast("string").alias("run"))
    together, now, failed = [], [], []

    def one(name, part):
        now.append(name)
        together.append(len(now))
        if name == "3":
            raise RuntimeError("this one")
        out = part.withColumn("n", F.lit(part.count())).withColumn("thread", F.lit(threading.get_ident()))
        now.remove(name)
        return out

    got = pl._each_run(rows, "run", one, failed, parallelism=4).collect()
    assert len(got) == 55 and all(r["n"] == 5 for r in got) and "run_number" not in got[0]
    assert failed == [("3", "RuntimeError: this one")] and max(together) > 1 and len({r["thread"] for r in got}) > 1
    with pytest.raises(ValueError):
        pl._each_run(rows.limit(0), "run", one, [])


def test_jobs_of_two_threads_delete_only_their_own(spark):
    import contextvars
    from gaugeframe import staging

    def job(first, second):
        own = staging.mark()
        inner = staging.stage(spark.range(first), "a")
        began.append(inner)
        return staging.settle(spark, own, inner.select((F.col("id") + second).alias("id")))[0]

    began = []
    outer = staging.mark()
    held = staging.stage(spark.range(7), "held")
    results = [contextvars.copy_context().run(job, n, 1) for n in (3, 4)]
    assert held.count() == 7 and [r.count() for r in results] == [3, 4]
    with pytest.raises(Exception):
        began[0].collect()
    (kept,) = staging.settle(spark, outer, results[0].union(results[1]))
    assert kept.count() == 7
    with pytest.raises(Exception):
        spark.read.parquet(results[0].inputFiles()[0]).count()


def test_fourier_distances_by_group_and_overall(spark):
    rng = np.random.default_rng(3)
    m, g = rng.normal(size=(500, 3)), rng.integers(0, 4, 500).tolist()
    df = matrix(spark, m, g=g).repartition(5)
    f = emb.fourier_map(3, 16, 1.0 / 3, 42)

    def expected(rows):
        mapped = f((rows - rows.mean(axis=0)) / rows.std(axis=0))
        return ((mapped - mapped.mean(axis=0)) ** 2).sum(axis=1)

    got = {r["row_id"]: r["prediction"] for r in out.centre_distance(df, fourier=16).collect()}
    assert np.allclose([got[i] for i in range(500)], expected(m))
    got = {r["row_id"]: r["prediction"] for r in out.centre_distance(df, fourier=16, by=["g"]).collect()}
    for k in range(4):
        at = np.flatnonzero(np.array(g) == k)
        assert np.allclose([got[i] for i in at], expected(m[at]))


def test_fourier_features_stay_with_the_workers(spark):
    rows = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.0, 2.0])], "row_id int, _z array<double>")
    made = out._fourier_distance(rows, [], "row_id", emb.fourier_map(2, 8, 0.5, 1), "prediction")
    assert made.columns == ["row_id", "prediction"] and "zip_with" not in made._jdf.queryExecution().optimizedPlan().toString()
