"""End-to-end jobs, readers and writers over the driver tables."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..functions.hashing import bucket
from ..operators import splits as spl
from ..operators.metrics import MULTICLASS, REGRESSION
from ..plans import jobs, plugins as pl, reports
from ..sources import archives, sinks, tables as src
from ..staging import scratch_path
from .aggregate_queries import STAT_COLS, stats_sql
from .embedding_queries import sphere_sql
from .evaluator_queries import lof_sql
from .registry import RESULT_LINES, auc_sql, query, result_lines, role_sql, rounded, u_sql
from .scaling_queries import _COLLECTIONS, drawn_collections


def scratch(t, name: str) -> str:
    return scratch_path(t.spark, name)


# ---- outlier benchmark -------------------------------------------------------------------------------------------

_OUT = """SELECT c_custkey AS vec_id, c_mktsegment AS dataset, c_acctbal, c_nationkey::VARCHAR AS c_nationkey,
  (c_acctbal < -500 OR c_acctbal > 9500)::INT AS y FROM customer"""
_OUT_SPEC = pl.TableSpec(("c_acctbal", "c_nationkey"), ("c_nationkey",), "c_custkey", "y", "dataset")


def _outlier_rows(t):
    return t.customer.select("c_custkey", F.col("c_mktsegment").alias("dataset"), "c_acctbal", "c_nationkey",
                             ((F.col("c_acctbal") < -500) | (F.col("c_acctbal") > 9500)).cast("int").alias("y"))


_OUT_EMB = sphere_sql(_OUT, "vec_id", ["c_acctbal"], ["c_nationkey"], 8, by="dataset")
_OUT_VEC = f"SELECT vec_id, dataset, y, v FROM (SELECT vec_id, list(e ORDER BY i) AS v FROM ({_OUT_EMB}) GROUP BY vec_id) JOIN ({_OUT}) USING (vec_id)"


@query("outlier_benchmark", f"""SELECT 'Sphere' AS embedding_model, dataset AS dataset_name, 'LocalOutlierFactor' AS algorithm,
  'Outlier Detection' AS task, auc_score, '10' AS algorithm_k, n AS dataset_size, ratio AS outlier_ratio FROM
  ({auc_sql(f"SELECT dataset, y, prediction FROM ({lof_sql(_OUT_VEC, 10, 'dataset')}) JOIN (SELECT vec_id AS key, y FROM ({_OUT})) USING (key)", "dataset", "y", "prediction")
    .replace(", 6) AS auc_score", ", 4) AS auc_score")})
  JOIN (SELECT dataset, count(*) AS n, round(avg(y),6) AS ratio FROM ({_OUT}) GROUP BY dataset) USING (dataset)""")
def outlier_benchmark(t):
    got = jobs.outlier_benchmark(_outlier_rows(t), _OUT_SPEC, [pl.SphereEmbedder(dim=8)], [pl.LocalOutlierFactor(k=10)],
                                 max_samples=10**9)
    res = got.results.select("embedding_model", "dataset_name", "algorithm", "task", "auc_score", "algorithm_k", "dataset_size", "outlier_ratio")
    return rounded(rounded(res, "outlier_ratio"), "auc_score", places=4)


@query("outlier_benchmark_all_evaluators")
def outlier_benchmark_all_evaluators(t):
    got = jobs.outlier_benchmark(_outlier_rows(t), _OUT_SPEC, [pl.SphereEmbedder(dim=8), pl.ScaledEmbedder()],
                                 [pl.LocalOutlierFactor(k=20), pl.IsolationForest(), pl.CentreDistance()], max_samples=10**9)
    return rounded(got.results, "auc_score", "outlier_ratio")


# ---- supervised benchmark ----------------------------------------------------------------------------------------

_SUP = """SELECT c_custkey AS vec_id, c_mktsegment AS dataset, c_acctbal, c_nationkey::VARCHAR AS c_nationkey, 'class_'||(c_nationkey%3) AS target FROM customer"""
_SUP_SPEC = pl.TableSpec(("c_acctbal", "c_nationkey"), ("c_nationkey",), "c_custkey", "target", "dataset")


def supervised_inputs(t):
    data = t.customer.select("c_custkey", F.col("c_mktsegment").alias("dataset"), "c_acctbal", "c_nationkey",
                             F.concat(F.lit("class_"), (F.col("c_nationkey") % 3).cast("string")).alias("target"))
    lists = data.select("dataset", "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("repeat"))
    lists = lists.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    lists = lists.withColumn("role", F.when(bucket(2, F.col("repeat"), F.col("c_custkey")) == F.col("fold"), "test").otherwise("train"))
    tasks = data.select("dataset").distinct().withColumn("task_type", F.lit(MULTICLASS)).withColumn("folds", F.lit(2))
    return data, lists, tasks


_REP = "(SELECT dataset AS ds, CASE WHEN count(*)<2500 THEN 10 WHEN count(*)>250000 THEN 1 ELSE 3 END AS reps FROM ({}) GROUP BY dataset)"
_RUNS = f"""SELECT s.vec_id||'#'||r||'#'||f AS vec_id, s.vec_id AS id, dataset, dataset||'|'||r||'|'||f AS run, c_acctbal, c_nationkey, target,
  (target[7:])::INT AS y, CASE WHEN floor({u_sql("(r||'|'||s.vec_id)")}*2) = f THEN 'test' ELSE 'train' END AS role
  FROM ({_SUP}) s JOIN {_REP.format(_SUP)} ON ds = dataset, range(0,10) a(r), range(0,2) b(f) WHERE r < reps"""
_RUN_VEC = f"""SELECT vec_id, run, id, y, role, v FROM (SELECT vec_id, list(e ORDER BY i) AS v FROM
  ({sphere_sql(_RUNS, "vec_id", ["c_acctbal"], ["c_nationkey"], 8, by="run", train="role='train'")}) GROUP BY vec_id) JOIN ({_RUNS}) USING (vec_id)"""


def vote_sql(vectors: str, k: int, classes: int, tie: str) -> str:
    """(run, q, y, proba) of the test rows of ``vectors(vec_id, run, y, role, v, <tie>)``."""
    return f"""SELECT run, q, y, list(p ORDER BY c) AS proba FROM (SELECT run, q, y, c, count(*) FILTER (label=c)::DOUBLE/{k} AS p FROM
      (SELECT a.run, a.vec_id AS q, a.y, b.y AS label, row_number() OVER (PARTITION BY a.vec_id, a.run ORDER BY list_distance(a.v,b.v), b.{tie}) AS rank
       FROM vv a JOIN vv b ON a.run = b.run AND a.role='test' AND b.role='train'), range(0,{classes}) r(c) WHERE rank <= {k}
      GROUP BY run, q, y, c) GROUP BY run, q, y"""


def _macro(sql):
    return sql.replace("round((sum", "((sum").replace("nullif(p*n,0), 6)", "nullif(p*n,0))")


_OVR = _macro(auc_sql("SELECT run||'#'||c AS rc, (y=c)::INT AS hit, proba[c+1] AS s FROM pp, range(0,3) z(c)", "rc", "hit", "s"))
_OVO = _macro(auc_sql("SELECT run||'#'||a||'#'||b AS rc, (y=a)::INT AS hit, proba[a+1] AS s FROM pp, range(0,3) x(a), range(0,3) z(b) WHERE a<>b AND (y=a OR y=b)", "rc", "hit", "s"))


@query("supervised_benchmark", f"""WITH vv AS MATERIALIZED ({_RUN_VEC}), pp AS MATERIALIZED ({vote_sql('vv', 5, 3, 'id')})
  SELECT 'Sphere' AS embedding_model, split_part(run,'|',1) AS dataset_name, split_part(run,'|',2)::INT AS repeat,
  split_part(run,'|',3)::INT AS fold, 'KNNClassifier' AS algorithm, round(ovr,4) AS auc_score_ovr, round(ovo,4) AS auc_score_ovo, round(ll,4) AS log_loss_score
  FROM (SELECT run, avg(-ln(least(greatest(proba[y+1],2.220446049250313e-16),1-2.220446049250313e-16))) AS ll FROM pp GROUP BY run)
  JOIN (SELECT split_part(rc,'#',1) AS run, avg(auc_score) AS ovr FROM ({_OVR}) GROUP BY 1) USING (run)
  JOIN (SELECT split_part(rc,'#',1) AS run, avg(auc_score) AS ovo FROM ({_OVO}) GROUP BY 1) USING (run)""")
def supervised_benchmark(t):
    data, lists, tasks = supervised_inputs(t)
    got = jobs.supervised_benchmark(data, lists, tasks, _SUP_SPEC, [pl.SphereEmbedder(dim=8)], [pl.KNNClassifier(k=5)], max_samples=10**9)
    res = got.results.select("embedding_model", "dataset_name", "repeat", "fold", "algorithm", "auc_score_ovr", "auc_score_ovo", "log_loss_score")
    return rounded(res, "auc_score_ovr", "auc_score_ovo", "log_loss_score", places=4)


@query("supervised_benchmark_regression")
def supervised_benchmark_regression(t):
    data, lists, tasks = supervised_inputs(t)
    data = data.withColumn("target", F.col("c_acctbal") / 100 + F.col("c_nationkey"))
    got = jobs.supervised_benchmark(data, lists, tasks.withColumn("task_type", F.lit(REGRESSION)), _SUP_SPEC,
                                    [pl.SphereEmbedder(dim=8), pl.ScaledEmbedder()], [pl.KNNRegressor(k=5), pl.KNNRegressor(k=10, weights="distance")],
                                    max_samples=10**9)
    return rounded(got.results, "mae_score", "mape_score", "r2_score", "rmse_score")


def _pipeline(features, task):
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="v"),
                            LogisticRegression(featuresCol="v", labelCol="y", maxIter=20)])


@query("end_to_end_predictor")
def end_to_end_predictor(t):
    data, lists, tasks = supervised_inputs(t)
    spec = pl.TableSpec(("c_acctbal", "c_nationkey"), (), "c_custkey", "target", "dataset")
    got = jobs.supervised_benchmark(data, lists, tasks, spec, [pl.PipelinePredictor(make=_pipeline)], [], max_samples=10**9)
    return rounded(got.results, "auc_score_ovr", "auc_score_ovo", "log_loss_score")


# ---- dataset separation ------------------------------------------------------------------------------------------

_NATIONS = """SELECT c_nationkey AS task_id, row_number() OVER (ORDER BY c_nationkey) - 1 AS slot, count(*) OVER () AS total FROM
  (SELECT DISTINCT c_nationkey FROM customer)"""
_MEMBERS = f"""SELECT 'collection_'||number AS collection, position, task_id FROM (SELECT number, size, slot, row_number() OVER (PARTITION BY number ORDER BY x) AS position
  FROM (SELECT number, size, x, (a::BIGINT*x+b::BIGINT)%29 AS slot FROM (SELECT number, 2+floor({u_sql("('42|size|'||number)")}*8) AS size,
  1+floor({u_sql("('42|a|'||number)")}*28) AS a, floor({u_sql("('42|b|'||number)")}*29) AS b FROM range(0,20) r(number)), range(0,29) s(x)
  WHERE x <= size - 1 + 4) WHERE slot < 25) JOIN ({_NATIONS}) USING (slot) WHERE position <= size"""
_SEP = f"""SELECT c_custkey AS vec_id, c_nationkey AS dataset, c_acctbal, c_mktsegment, {role_sql(42, 'c_custkey')} AS role FROM customer"""
_SEP_VEC = f"""SELECT vec_id, dataset, role, v FROM (SELECT vec_id, list(e ORDER BY i) AS v FROM
  ({sphere_sql(_SEP, "vec_id", ["c_acctbal"], ["c_mktsegment"], 8, by="dataset", train="role='train'")}) GROUP BY vec_id) JOIN ({_SEP}) USING (vec_id)"""
_SEP_OVR = _macro(auc_sql("SELECT run||'#'||c AS rc, (y=c)::INT AS hit, proba[c+1] AS s FROM pp JOIN sz USING (run), range(0,10) z(c) WHERE c < size", "rc", "hit", "s"))


def separation_inputs(t):
    data = t.customer.select("c_custkey", F.col("c_nationkey").alias("dataset"), "c_acctbal", "c_mktsegment")
    members = spl.random_collections(data.select(F.col("dataset").alias("task_id"))).withColumnRenamed("task_id", "dataset")
    return data, members, pl.TableSpec(("c_acctbal", "c_mktsegment"), ("c_mktsegment",), "c_custkey", "y", "dataset")


@query("separation_benchmark", f"""WITH mm AS MATERIALIZED ({_MEMBERS}), sz AS (SELECT collection AS run, count(*) AS size FROM mm GROUP BY 1),
  vv AS MATERIALIZED (SELECT collection AS run, dataset||'|'||vec_id AS vec_id, (position-1)::INT AS y, role, v FROM ({_SEP_VEC}) JOIN mm ON task_id = dataset),
  pp AS MATERIALIZED ({vote_sql('vv', 5, 10, 'vec_id')})
  SELECT run AS collection, CASE WHEN size > 2 THEN 'Supervised Multiclass Classification' ELSE 'Supervised Binary Classification' END AS task,
  round(CASE WHEN size > 2 THEN ovr ELSE NULL END,4) AS auc_score_ovr, round(CASE WHEN size > 2 THEN ll END,4) AS log_loss_score,
  round(CASE WHEN size <= 2 THEN ovr END,4) AS auc_score, ids AS task_ids FROM sz JOIN
  (SELECT run, avg(-ln(least(greatest(proba[y+1],2.220446049250313e-16),1-2.220446049250313e-16))) AS ll FROM pp GROUP BY run) USING (run)
  JOIN (SELECT split_part(rc,'#',1) AS run, avg(auc_score) AS ovr FROM ({_SEP_OVR}) GROUP BY 1) USING (run)
  JOIN (SELECT collection AS run, string_agg(task_id::VARCHAR,'_' ORDER BY position) AS ids FROM mm GROUP BY 1) USING (run)""")
def separation_benchmark(t):
    data, members, spec = separation_inputs(t)
    got = jobs.separation_benchmark(data, members, spec, [pl.SphereEmbedder(dim=8)], [pl.KNNClassifier(k=5)])
    res = got.results
    for c in ("auc_score", "auc_score_ovr", "log_loss_score"):
        if c not in res.columns:
            res = res.withColumn(c, F.lit(None).cast("double"))
    return rounded(res.select("collection", "task", "auc_score_ovr", "log_loss_score", "auc_score", "task_ids"),
                   "auc_score_ovr", "log_loss_score", "auc_score", places=4)


# ---- single dataset, suite ---------------------------------------------------------------------------------------


_ONE = """SELECT c_custkey AS vec_id, 'single' AS run, c_acctbal, c_nationkey::VARCHAR AS c_nationkey, (dense_rank() OVER (ORDER BY c_mktsegment)-1)::INT AS y,
  CASE WHEN c_custkey%5=0 THEN 'test' ELSE 'train' END AS role FROM customer"""
_ONE_VEC = f"""SELECT vec_id, run, vec_id AS id, y, role, v FROM (SELECT vec_id, list(e ORDER BY i) AS v FROM
  ({sphere_sql(_ONE, "vec_id", ["c_acctbal"], ["c_nationkey"], 8, by="run", train="role='train'")}) GROUP BY vec_id) JOIN ({_ONE}) USING (vec_id)"""
_ONE_AUC = _macro(auc_sql("SELECT c AS rc, (y=c)::INT AS hit, proba[c+1] AS s FROM pp, range(0,5) z(c)", "rc", "hit", "s"))


@query("single_dataset_benchmark", f"""WITH vv AS MATERIALIZED ({_ONE_VEC}), pp AS MATERIALIZED ({vote_sql('vv', 5, 5, 'id')})
  SELECT 'Sphere' AS embedding_model, 'KNNClassifier' AS algorithm, 'Supervised Multiclass Classification' AS task, '5' AS algorithm_k,
  'uniform' AS algorithm_weights, 'euclidean' AS algorithm_metric, round(auc,6) AS auc_score, round(ll,6) AS log_loss_score FROM
  (SELECT sum(auc_score*n)/sum(n) AS auc FROM ({_ONE_AUC}) JOIN (SELECT y AS rc, count(*) AS n FROM pp GROUP BY y) USING (rc)),
  (SELECT avg(-ln(least(greatest(proba[y+1],2.220446049250313e-16),1-2.220446049250313e-16))) AS ll FROM pp)""")
def single_dataset_benchmark(t):
    path = scratch(t, "csv-dataset")
    rows = t.customer.select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment",
                             F.when(F.col("c_custkey") % 5 == 0, "test").alias("set"))
    rows.write.option("header", True).csv(path)
    schema = "c_custkey bigint, c_acctbal double, c_nationkey int, c_mktsegment string, set string"
    got = jobs.single_dataset_benchmark(t.spark, path, "c_mktsegment", MULTICLASS, [pl.SphereEmbedder(dim=8)],
                                        [pl.KNNClassifier(k=5)], schema=schema, key="c_custkey", categorical=["c_nationkey"])
    return rounded(got.results, "auc_score", "log_loss_score")


@query("benchmark_suite")
def benchmark_suite(t):
    def broken():
        raise ValueError("a part that fails")

    outcomes, errors = jobs.run_suite(t.spark, {
        "outlier": lambda: jobs.outlier_benchmark(_outlier_rows(t), _OUT_SPEC, [pl.SphereEmbedder(dim=8)], [pl.CentreDistance()],
                                                  max_samples=10**9),
        "broken": broken})
    lines = outcomes["outlier"].results.select(F.lit("outlier").alias("part"), "dataset_name", F.round("auc_score", 6).alias("auc_score"))
    return lines.unionByName(errors.select("part", F.col("error").alias("dataset_name"), F.lit(None).cast("double").alias("auc_score")))


@query("external_model_per_dataset", f"""SELECT c_custkey, round(c_acctbal - lo, 4) AS above FROM customer JOIN
  (SELECT c_nationkey, min(c_acctbal) AS lo FROM (SELECT *, {role_sql(42, 'c_custkey')} AS role FROM customer) WHERE role = 'train' GROUP BY 1) USING (c_nationkey)""")
def external_model_per_dataset(t):
    """A model of the user's that sees the two poorest train rows of a nation as its context."""
    def above(context, rows):
        return [[v - context["lo"].min()] for v in rows["c_acctbal"]]

    rows = t.customer.select("c_custkey", F.col("c_nationkey").alias("run"), "c_acctbal").withColumn("role", spl.role_by_hash("c_custkey"))
    low = rows.filter("role = 'train'").groupBy("run").agg(F.min("c_acctbal").alias("lo"))
    model = pl.ExternalEmbedder(fn=above, context_rows=2, slice_rows=50)
    got = model.embed(rows.join(low, "run"), pl.TableSpec(("c_acctbal", "lo"), (), "c_custkey"), "run")
    return got.select("c_custkey", F.round(F.col("embedding")[0], 4).alias("above"))


# ---- reports -----------------------------------------------------------------------------------------------------

_KEYS = "algorithm, embedding_model, dataset_name, dataset_size, num_features, time_to_compute_embedding, algorithm_metric"
_RENAMED = f"""SELECT * REPLACE (CASE embedding_model WHEN 'model_A' THEN 'alpha' ELSE embedding_model END AS embedding_model) FROM ({RESULT_LINES})
  WHERE embedding_model IN ('model_A','model_N')"""
_BEST = f"""SELECT {_KEYS}, outlier_ratio, max(auc_score) AS auc_score FROM ({_RENAMED}) WHERE algorithm_metric = 'euclidean' OR algorithm_metric IS NULL
  GROUP BY {_KEYS}, outlier_ratio"""


def _clean_sql(source: str) -> str:
    return f"""SELECT * FROM ({source}) SEMI JOIN (SELECT dataset_name FROM (SELECT dataset_name, embedding_model, count(DISTINCT algorithm) AS n FROM ({source})
      GROUP BY 1,2) GROUP BY 1 HAVING min(n)=max(n)) USING (dataset_name)"""


def _report(table, metric):
    return rounded(table, *[f"{s}_{metric}" for s in STAT_COLS], "averaged_embedding_compute_time")


@query("outlier_report", stats_sql("embedding_model, algorithm", "auc_score", _clean_sql(_BEST)))
def outlier_report(t):
    got = reports.outlier_report(result_lines(t), {"model_A": "alpha"}, ["alpha", "model_N"])
    return _report(got["outlier_descriptive"], "auc_score")


_BEST_BIN = f"""SELECT *, CASE WHEN outlier_ratio < 0.1 THEN '<0.1' WHEN outlier_ratio < 0.3 THEN '[0.1,0.3)' ELSE '>=0.3' END AS outlier_ratio_bin_based
  FROM ({_clean_sql(_BEST)})"""


@query("outlier_report_by_ratio", stats_sql("embedding_model, outlier_ratio_bin_based", "auc_score", _BEST_BIN))
def outlier_report_by_ratio(t):
    got = reports.outlier_report(result_lines(t), {"model_A": "alpha"}, ["alpha", "model_N"], bin_edges=[0.1, 0.3])
    return _report(got["outlier_ratio"], "auc_score")


def _supervised_sql(task: str, metric: str, fn: str) -> str:
    cleaned = _clean_sql(f"""SELECT * FROM ({RESULT_LINES}) WHERE (algorithm_metric = 'euclidean' OR algorithm_metric IS NULL)
      AND (algorithm_weights = 'distance' OR algorithm_weights IS NULL) AND task = '{task}'""")
    return stats_sql("embedding_model, algorithm", metric, f"SELECT {_KEYS}, {fn}({metric}) AS {metric} FROM ({cleaned}) GROUP BY {_KEYS}")


_DEFAULT_LINES = f"(SELECT *, auc_score*0.9 + 0.01*num_features AS auc_score_ovr FROM ({RESULT_LINES}))"


@query("supervised_report_default_metric", _supervised_sql("Supervised Multiclass Classification", "auc_score_ovr", "max").replace(f"({RESULT_LINES})", _DEFAULT_LINES))
def supervised_report_default_metric(t):
    """The multiclass report on the metric it takes unless told otherwise."""
    lines = result_lines(t).withColumn("auc_score_ovr", F.col("auc_score") * 0.9 + F.col("num_features") * 0.01)
    return _report(reports.supervised_report(lines, tasks=["multiclass"])["multiclass_descriptive"], "auc_score_ovr")


@query("supervised_report_binary", _supervised_sql("Supervised Binary Classification", "auc_score", "max"))
def supervised_report_binary(t):
    return _report(reports.supervised_report(result_lines(t), multiclass_metric="auc_score", tasks=["binary"])["binary_descriptive"], "auc_score")


@query("supervised_report_multiclass", _supervised_sql("Supervised Multiclass Classification", "auc_score", "max"))
def supervised_report_multiclass(t):
    return _report(reports.supervised_report(result_lines(t), multiclass_metric="auc_score", tasks=["multiclass"])["multiclass_descriptive"], "auc_score")


@query("supervised_report_regression", _supervised_sql("Supervised Regression", "mape_score", "min"))
def supervised_report_regression(t):
    return _report(reports.supervised_report(result_lines(t), multiclass_metric="auc_score", tasks=["regression"])["regression_descriptive"], "mape_score")


# ---- readers and writers -----------------------------------------------------------------------------------------


@query("csv_dataset_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_custkey AS row_id FROM customer")
def csv_dataset_scan(t):
    path = scratch(t, "csv")
    t.customer.write.option("header", True).csv(path)
    return src.read_csv_dataset(t.spark, path, t.customer.schema, "c_custkey")


@query("catalogue_scan", """SELECT o_orderpriority AS dataset, count(*) AS n, count(*) FILTER (o_orderkey%3=0) AS test FROM orders GROUP BY 1""")
def catalogue_scan(t):
    tasks_at, splits_at = scratch(t, "tasks"), scratch(t, "splits")
    rows = t.orders.select(F.col("o_orderpriority").alias("dataset"), F.lit(0).alias("repeat"), F.lit(0).alias("fold"),
                           F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("role"))
    rows.write.partitionBy("dataset").parquet(splits_at)
    rows.groupBy("dataset").agg(F.count("*").alias("instances")).write.parquet(tasks_at)
    tasks, splits = src.read_catalogue(t.spark, tasks_at, splits_at)
    return splits.join(tasks, "dataset").groupBy("dataset").agg(F.max("instances").alias("n"), F.count_if(F.col("role") == "test").alias("test"))


@query("collections_round_trip", f"""SELECT collection, string_agg(task_id::VARCHAR, '_' ORDER BY position) AS selected_task_ids_str,
  count(*)::INT AS n FROM ({_COLLECTIONS}) GROUP BY collection""")
def collections_round_trip(t):
    path = scratch(t, "collections")
    sinks.save_collections(spl.collection_table(drawn_collections(t)), path)
    return src.read_collections(t.spark, path).select("collection", "selected_task_ids_str", F.size("selected_task_ids").alias("n"))


@query("saved_result_table", f"SELECT embedding_model, algorithm, count(*) AS n, round(max(auc_score),6) AS best FROM ({RESULT_LINES}) GROUP BY ALL")
def saved_result_table(t):
    got = rounded(result_lines(t).groupBy("embedding_model", "algorithm").agg(F.count("*").alias("n"), F.max("auc_score").alias("best")), "best")
    _, csv = sinks.save_table(got, scratch(t, "results"), "results", "20240101_000000")
    return t.spark.read.schema(got.schema).option("header", True).csv(csv)


@query("appended_results", f"SELECT algorithm, 'outlier' AS benchmark, count(*) AS n FROM ({RESULT_LINES}) GROUP BY algorithm")
def appended_results(t):
    path = scratch(t, "append")
    lines = result_lines(t).select("algorithm", "auc_score", "repeat")
    for r in (0, 1):
        sinks.append_results(lines.filter(F.col("repeat") == r).drop("repeat"), path, "outlier", "run1")
    return t.spark.read.parquet(path).groupBy("algorithm", "benchmark").agg(F.count("*").alias("n"))


@query("matrix_archives_round_trip", """SELECT label::VARCHAR AS dataset, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS row_id,
  (vec_id % 2)::INT AS y, round(embedding[1]::DOUBLE,6) AS first, round(embedding[64]::DOUBLE,6) AS last, round(list_sum(embedding::DOUBLE[]),6) AS total
  FROM embeddings WHERE label <> 3""")
def matrix_archives_round_trip(t):
    """The vectors of each label as an archive, read back by row ranges without one of them."""
    path = scratch(t, "archives")
    sinks.save_matrix_archives(t.embeddings.select(F.col("label").alias("dataset"), F.col("vec_id").alias("row_id"), F.col("embedding").alias("features"),
                                                   (F.col("vec_id") % 2).cast("int").alias("y")), path)
    got = archives.scan_matrix_archives(t.spark, path, exclude=("3",), partition_bytes=4096)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return got.select("dataset", "row_id", "y", F.round(F.col("features")[0], 6).alias("first"), F.round(F.col("features")[63], 6).alias("last"),
                      F.round(total, 6).alias("total"))


@query("repeated_results", f"SELECT algorithm, 'outlier' AS benchmark, count(*) AS n, round(sum(auc_score),4) AS total FROM ({RESULT_LINES}) GROUP BY algorithm")
def repeated_results(t):
    """Steps that are saved twice, the first time with other lines, count once."""
    path = scratch(t, "steps")
    lines = result_lines(t).select("algorithm", "auc_score", "repeat")
    for kept in ("auc_score > 0.6", "true"):
        for r in (0, 1):
            sinks.append_results(lines.filter(F.col("repeat") == r).filter(kept).drop("repeat"), path, "outlier", "run1", sinks.step_name("repeat", r))
    got = t.spark.read.parquet(path).groupBy("algorithm", "benchmark").agg(F.count("*").alias("n"), F.sum("auc_score").alias("total"))
    return rounded(got, "total", places=4)


@query("saved_report", stats_sql("embedding_model, algorithm", "auc_score", _clean_sql(_BEST)))
def saved_report(t):
    path = scratch(t, "report")
    got = reports.outlier_report(result_lines(t), {"model_A": "alpha"}, ["alpha", "model_N"], folder=path)["outlier_descriptive"]
    read = t.spark.read.schema(got.schema).option("header", True).csv(f"{path}/outlier_descriptive.csv")
    return _report(read, "auc_score")
