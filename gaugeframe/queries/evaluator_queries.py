"""Evaluators over the driver tables."""

from pyspark.sql import functions as F

from ..operators import neighbors as nb, outliers as out
from ..operators.metrics import roc_auc_ovr
from ..operators.splits import role_by_hash, stratified_folds
from ..operators.tuned import (BoostedRegressor, KernelSVMEvaluator, KNNSearchEvaluator, LogisticEvaluator,
                               PerceptronEvaluator, PerceptronRegressor)
from ..staging import stage
from .join_queries import _DIST, knn_sql
from .registry import EMB, auc_sql, query, role_sql, rounded, u_sql

_E = f"SELECT vec_id, v, label, {role_sql(42, 'vec_id')} AS role FROM ({EMB})"


def embeddings_split(t):
    rows = t.embeddings.select("vec_id", "embedding", F.col("label").alias("y")).withColumn("role", role_by_hash("vec_id"))
    return rows.filter("role = 'train'"), rows.filter("role = 'test'")


def near_sql(k: int, metric: str = "euclidean") -> str:
    return f"""SELECT q, t, d, label, y FROM (SELECT a.vec_id AS q, b.vec_id AS t, {_DIST[metric]} AS d, b.label, a.label AS y,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST[metric]}, b.vec_id) AS rank FROM ({_E}) a, ({_E}) b
      WHERE a.role='test' AND b.role='train') WHERE rank <= {k}"""


def proba_sql(k: int, weights: str, metric: str = "euclidean") -> str:
    """(q, y, c, p): class probabilities in long form."""
    w = "1.0::DOUBLE" if weights == "uniform" else "CASE WHEN min(d) OVER (PARTITION BY q) = 0 THEN (d=0)::INT::DOUBLE ELSE 1/d END"
    return f"""SELECT q, y, c::INT AS c, coalesce(sum(w) FILTER (label=c),0)/sum(w) AS p FROM (SELECT *, {w} AS w FROM ({near_sql(k, metric)})),
      range(0,10) r(c) GROUP BY q, y, c"""


def _long(pred):
    return rounded(pred.select(F.col("vec_id").alias("q"), F.posexplode_outer("proba").alias("c", "p")), "p")


@query("knn_classifier_uniform", f"SELECT q, c, round(p,6) AS p FROM ({proba_sql(5, 'uniform')})")
def knn_classifier_uniform(t):
    train, test = embeddings_split(t)
    return _long(nb.knn_classify(train, test, 10, 5, row_id="vec_id"))


@query("knn_classifier_distance", f"SELECT q, c, round(p,6) AS p FROM ({proba_sql(10, 'distance', 'cosine')})")
def knn_classifier_distance(t):
    train, test = embeddings_split(t)
    return _long(nb.knn_classify(train, test, 10, 10, "distance", "cosine", row_id="vec_id"))


_AUC_ROWS = f"SELECT c, (y=c)::INT AS hit, p AS s FROM ({proba_sql(5, 'uniform')})"
_AUC_EXACT = auc_sql(_AUC_ROWS, "c", "hit", "s").replace("round((sum", "((sum").replace("nullif(p*n,0), 6)", "nullif(p*n,0))")


@query("knn_classifier_auc", f"SELECT round(avg(auc_score),6) AS auc_score_ovr FROM ({_AUC_EXACT})")
def knn_classifier_auc(t):
    train, test = embeddings_split(t)
    pred = nb.knn_classify(train, test, 10, 5, row_id="vec_id").join(test.select("vec_id", "y"), "vec_id")
    return rounded(roc_auc_ovr(pred), "auc_score_ovr")


@query("knn_regressor_uniform", f"SELECT q AS vec_id, round(avg(label),6) AS prediction FROM ({near_sql(7)}) GROUP BY q")
def knn_regressor_uniform(t):
    train, test = embeddings_split(t)
    return rounded(nb.knn_regress(train, test, 7, row_id="vec_id"), "prediction")


@query("knn_regressor_distance", f"""SELECT q AS vec_id, round(CASE WHEN min(d)=0 THEN avg(label) FILTER (d=0) ELSE sum(label/d)/sum(1/d) END,6)
  AS prediction FROM ({near_sql(9, 'manhattan')}) GROUP BY q""".replace("sum(label/d)", "sum(label/nullif(d,0))").replace("sum(1/d)", "sum(1/nullif(d,0))"))
def knn_regressor_distance(t):
    train, test = embeddings_split(t)
    return rounded(nb.knn_regress(train, test, 9, "distance", "manhattan", row_id="vec_id"), "prediction")


def lof_sql(source: str, k: int, by: str | None = None) -> str:
    """(key, prediction) of ``source(vec_id, v[, by])``."""
    extra = by or ""
    b = f", {by}" if by else ""
    on = "a.vec_id<>b.vec_id" + (f" AND a.{by}=b.{by}" if by else "")
    using = f"({by}, t)" if by else "(t)"
    return f"""WITH nn AS MATERIALIZED ({knn_sql(source, k, on=on, extra=extra)}),
      kd AS (SELECT q AS t, max(distance) AS kd{b} FROM nn GROUP BY q{b}),
      lrd AS MATERIALIZED (SELECT q, 1.0/(avg(greatest(distance, kd))+1e-10) AS lrd{b} FROM nn JOIN kd USING {using} GROUP BY q{b})
      SELECT n.q AS key, avg(o.lrd)/any_value(m.lrd) AS prediction{', n.' + by if by else ''} FROM nn n JOIN lrd o ON o.q = n.t{f' AND o.{by}=n.{by}' if by else ''}
      JOIN lrd m ON m.q = n.q{f' AND m.{by}=n.{by}' if by else ''} GROUP BY n.q{', n.' + by if by else ''}"""


@query("local_outlier_factor", f"SELECT key AS vec_id, round(prediction,6) AS prediction FROM ({lof_sql(EMB, 20)})")
def local_outlier_factor(t):
    return rounded(nb.local_outlier_factor(t.embeddings, 20, row_id="vec_id"), "prediction")


_SEGMENT_POINTS = "SELECT c_custkey AS vec_id, c_mktsegment AS seg, [c_acctbal/1000, c_nationkey::DOUBLE] AS v FROM customer"


@query("local_outlier_factor_per_dataset", f"SELECT key AS c_custkey, seg, round(prediction,5) AS prediction FROM ({lof_sql(_SEGMENT_POINTS, 10, 'seg')})")
def local_outlier_factor_per_dataset(t):
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"),
                             F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("embedding"))
    return rounded(nb.local_outlier_factor(rows, 10, row_id="c_custkey", by=["seg"]), "prediction", places=5)


def _line_vectors(t):
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return t.wide("lineitem").select(key.alias("k"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("embedding"))


_SKIP = "floor(ln({u})/ln(1 - least(1.0, {margin}/n)))"
_MARGIN = 64 + 8 * 64 ** 0.5 + 16


@query("tree_samples", f"""WITH RECURSIVE z AS MATERIALIZED (SELECT o_orderkey AS k, o_orderstatus AS g, count(*) OVER (PARTITION BY o_orderstatus)::DOUBLE AS n FROM orders),
  hit AS (SELECT k, g, n, 0 AS draws, {_SKIP.format(u=u_sql("('42|skip|0|'||k)"), margin=_MARGIN)} AS tree FROM z
    UNION ALL SELECT k, g, n, draws + 1, tree + 1 + {_SKIP.format(u=u_sql("('42|skip|'||(draws+1)||'|'||k)"), margin=_MARGIN)} FROM hit WHERE tree < 20)
  SELECT o_orderkey, o_orderstatus, tree::INT AS tree, rank::INT AS rank FROM (SELECT k AS o_orderkey, g AS o_orderstatus, tree, row_number() OVER
    (PARTITION BY g, tree ORDER BY {u_sql("('42|place|'||tree::INT||'|'||k)")}, k) AS rank FROM hit WHERE tree < 20) WHERE rank <= 64""")
def tree_samples(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return out.tree_samples(rows, "o_orderkey", 20, 64, 42, ["o_orderstatus"]).withColumnRenamed("_rank", "rank")


@query("isolation_forest")
def isolation_forest(t):
    return rounded(out.isolation_forest(_line_vectors(t), row_id="k"), "prediction")


@query("isolation_forest_per_dataset")
def isolation_forest_per_dataset(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("embedding"))
    return rounded(out.isolation_forest(rows, row_id="c_custkey", contamination=0.1, by=["c_mktsegment"]), "prediction")


_Z = " + ".join(f"pow(({c}-avg({c}) OVER w)/stddev_pop({c}) OVER w, 2)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("centre_distance", f"""SELECT k, round(s,5) AS prediction, (s > (SELECT quantile_cont(s,0.9) FROM z))::INT AS is_outlier FROM z"""
       .replace("SELECT k,", f"WITH z AS MATERIALIZED (SELECT l_orderkey||'-'||l_partkey||'-'||l_suppkey||'-'||l_linenumber AS k, {_Z} AS s FROM lineitem WINDOW w AS ()) SELECT k,", 1))
def centre_distance(t):
    return rounded(out.centre_distance(_line_vectors(t), row_id="k", contamination=0.1), "prediction", places=5)


_ZS = " + ".join(f"pow(({c}-avg({c}) OVER w)/stddev_pop({c}) OVER w, 2)" for c in ("c_acctbal", "c_nationkey"))


@query("centre_distance_per_dataset", f"SELECT c_custkey, c_mktsegment, round({_ZS},6) AS prediction FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def centre_distance_per_dataset(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("embedding"))
    return rounded(out.centre_distance(rows, row_id="c_custkey", by=["c_mktsegment"]).drop("is_outlier"), "prediction")


@query("centre_distance_fourier")
def centre_distance_fourier(t):
    return rounded(out.centre_distance(_line_vectors(t), row_id="k", fourier=32), "prediction")


# ---- neighbour grid ----------------------------------------------------------------------------------------------

_KS = tuple(range(5, 101, 5))
_F = f"""SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY {u_sql("('42|'||vec_id)")}, vec_id) - 1) % 5)::INT AS fold FROM ({EMB})"""


def _grid_sql(metric):
    return f"""SELECT '{metric}' AS metric, weights, k, fold, q, y, label FROM (SELECT weights, k, fold, q, y, label, row_number() OVER
      (PARTITION BY weights, k, q ORDER BY sum(w) DESC, label) AS place FROM (SELECT fold, q, y, label, k, weights,
      CASE WHEN weights='uniform' THEN 1.0 WHEN least_d = 0 THEN (d=0)::INT ELSE 1/d END AS w FROM
      (SELECT *, min(d) OVER (PARTITION BY q) AS least_d FROM (SELECT a.fold, a.vec_id AS q, a.label AS y, b.label, {_DIST[metric]} AS d,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST[metric]}, b.vec_id) AS rank FROM f a, f b WHERE a.fold<>b.fold)),
      (VALUES {','.join(f'({k})' for k in _KS)}) ks(k), (VALUES ('uniform'),('distance')) ws(weights) WHERE rank <= k)
      GROUP BY weights, k, fold, q, y, label) WHERE place = 1"""


@query("knn_search_grid", f"""WITH f AS MATERIALIZED ({_F}), p AS MATERIALIZED ({_grid_sql('euclidean')} UNION ALL {_grid_sql('manhattan')} UNION ALL {_grid_sql('cosine')})
  SELECT metric, weights, k::INT AS k, fold, round(sum(s*CASE WHEN s+c=0 THEN 0 ELSE 2.0*r/(s+c) END)/sum(s),6) AS f1_weighted FROM
  (SELECT metric, weights, k, fold, cls, count(*) FILTER (y=cls) AS s, count(*) FILTER (label=cls) AS c, count(*) FILTER (y=cls AND label=cls) AS r
   FROM p, range(0,10) x(cls) GROUP BY ALL) GROUP BY metric, weights, k, fold""")
def knn_search_grid(t):
    rows = stage(stratified_folds(t.embeddings.select("vec_id", "embedding", F.col("label").alias("y")), "vec_id", 5, "y"), "knn-search")
    got = nb.knn_grid(rows, 10, ks=_KS, row_id="vec_id")
    return rounded(got, "f1_weighted")


# ---- searched evaluators -----------------------------------------------------------------------------------------


def _searched(t, evaluator):
    train, test = embeddings_split(t)
    evaluator.row_id, evaluator.label = "vec_id", "y"
    return evaluator.fit(train).predict(test)


@query("knn_hyperparameter_search")
def knn_hyperparameter_search(t):
    got = _searched(t, KNNSearchEvaluator())
    return got.select("vec_id", "prediction")


@query("logistic_regression_search")
def logistic_regression_search(t):
    return _searched(t, LogisticEvaluator()).select("vec_id", "prediction")


@query("perceptron_search")
def perceptron_search(t):
    return _searched(t, PerceptronEvaluator()).select("vec_id", "prediction")


def _priced_parts(t):
    return t.part.select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size").cast("double"), F.col("p_partkey") % 7.0)
                         .alias("embedding"), F.col("p_retailprice").alias("y")).withColumn("role", role_by_hash("vec_id"))


@query("perceptron_regression_search")
def perceptron_regression_search(t):
    rows, model = _priced_parts(t), PerceptronRegressor(row_id="vec_id")
    return rounded(model.fit(rows.filter("role = 'train'")).predict(rows.filter("role = 'test'")), "prediction")


@query("boosted_regression_search")
def boosted_regression_search(t):
    rows, model = _priced_parts(t), BoostedRegressor(row_id="vec_id")
    return rounded(model.fit(rows.filter("role = 'train'")).predict(rows.filter("role = 'test'")), "prediction")


@query("kernel_svm_search")
def kernel_svm_search(t):
    return _searched(t, KernelSVMEvaluator()).select("vec_id", "prediction")


@query("search_trial_history")
def search_trial_history(t):
    train, _ = embeddings_split(t)
    model = KNNSearchEvaluator(row_id="vec_id")
    model.optimize(train)
    return model.history(t.spark).select("number", F.round("value", 6).alias("value"), F.to_json("params").alias("params"), "state")
