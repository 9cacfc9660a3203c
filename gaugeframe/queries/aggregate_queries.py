"""Aggregations over the driver tables."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators.admission import keep_listed
from .frame_queries import order_profile, _ORDER_PROFILE
from .registry import EMB, RESULT_LINES, query, result_lines, rounded, u_sql
from .scaling_queries import _COLLECTIONS, drawn_collections


@query("outlier_ratio_per_dataset", """SELECT user_id, round(sum((event_type='error')::INT)::DOUBLE/count(*),6) AS outlier_ratio
  FROM events GROUP BY user_id""")
def outlier_ratio_per_dataset(t):
    rows = t.events.withColumn("y", (F.col("event_type") == "error").cast("int"))
    return rounded(rows.groupBy("user_id").agg(agg.outlier_ratio().alias("outlier_ratio")), "outlier_ratio")


@query("column_ranges", " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", min(x) AS min_value, max(x) AS max_value FROM (SELECT l_returnflag, "
    f"CASE WHEN l_linenumber = 1 THEN NULL ELSE {c} END AS x FROM lineitem) GROUP BY l_returnflag" for c in ("l_quantity", "l_tax", "l_discount")))
def column_ranges(t):
    cols = ["l_quantity", "l_tax", "l_discount"]
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    spoil = lambda c: F.when(F.col("l_linenumber") == 1, F.when(F.col("l_suppkey") % 2 == 0, inf).otherwise(nan)).otherwise(F.col(c))
    rows = t.lineitem.select("l_returnflag", *[spoil(c).alias(c) for c in cols])
    return agg.column_ranges(rows, cols, ["l_returnflag"])


@query("best_score_per_configuration", f"""SELECT embedding_model, algorithm, dataset_name, round(max(auc_score),6) AS auc_score
  FROM ({RESULT_LINES}) GROUP BY ALL""")
def best_score_per_configuration(t):
    return rounded(agg.best_score(result_lines(t), ["embedding_model", "algorithm", "dataset_name"], "auc_score"), "auc_score")


@query("lowest_error_per_configuration", f"""SELECT embedding_model, algorithm, dataset_name, round(min(mape_score),6) AS mape_score
  FROM ({RESULT_LINES}) GROUP BY ALL""")
def lowest_error_per_configuration(t):
    return rounded(agg.best_score(result_lines(t), ["embedding_model", "algorithm", "dataset_name"], "mape_score", True), "mape_score")


COVERAGE = f"""SELECT dataset_name, min(n) AS lo, max(n) AS hi FROM (SELECT dataset_name, embedding_model, count(DISTINCT algorithm) AS n
  FROM ({RESULT_LINES}) GROUP BY 1,2) GROUP BY 1"""


@query("coverage_cleaning", f"""SELECT dataset_name, count(*) AS n FROM ({RESULT_LINES}) SEMI JOIN (SELECT dataset_name FROM ({COVERAGE}) WHERE lo=hi)
  USING (dataset_name) GROUP BY dataset_name""")
def coverage_cleaning(t):
    kept, _ = agg.clean_results(result_lines(t))
    return kept.groupBy("dataset_name").agg(F.count("*").alias("n"))


@query("coverage_rejected", f"SELECT dataset_name FROM ({COVERAGE}) WHERE lo<>hi")
def coverage_rejected(t):
    return agg.clean_results(result_lines(t))[1]


@query("keep_rows_of_valid_datasets", f"""SELECT algorithm, count(*) AS n FROM ({RESULT_LINES}) WHERE dataset_name IN
  (SELECT 'd'||p_partkey FROM part WHERE p_size < 20) GROUP BY algorithm""")
def keep_rows_of_valid_datasets(t):
    valid = t.part.filter("p_size < 20").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("dataset_name"))
    return keep_listed(result_lines(t), "dataset_name", valid).groupBy("algorithm").agg(F.count("*").alias("n"))


def stats_sql(keys: str, metric: str, source: str) -> str:
    return f"""SELECT {keys}, round(avg({metric}),6) AS average_{metric}, round(stddev_samp({metric}),6) AS std_{metric},
      round(min({metric}),6) AS min_{metric}, round(max({metric}),6) AS max_{metric}, round(median({metric}),6) AS median_{metric},
      round(avg(time_to_compute_embedding),6) AS averaged_embedding_compute_time, count(DISTINCT dataset_name) AS num_datasets
      FROM ({source}) GROUP BY {keys}"""


STAT_COLS = ("average", "std", "min", "max", "median")


@query("descriptive_statistics", stats_sql("embedding_model, algorithm", "auc_score", RESULT_LINES))
def descriptive_statistics(t):
    got = agg.describe_results(result_lines(t), "auc_score")
    return rounded(got, *[f"{s}_auc_score" for s in STAT_COLS], "averaged_embedding_compute_time")


_BINNED = f"""SELECT *, CASE WHEN outlier_ratio < 0.05 THEN '<0.05' WHEN outlier_ratio < 0.2 THEN '[0.05,0.2)' ELSE '>=0.2' END
  AS outlier_ratio_bin_based FROM ({RESULT_LINES})"""


@query("statistics_by_outlier_ratio", stats_sql("embedding_model, outlier_ratio_bin_based", "auc_score", _BINNED))
def statistics_by_outlier_ratio(t):
    got = agg.describe_by_outlier_ratio(result_lines(t), [0.05, 0.2], "auc_score")
    return rounded(got, *[f"{s}_auc_score" for s in STAT_COLS], "averaged_embedding_compute_time")


CENTROIDS = f"""SELECT label, i, avg(v[i+1]) AS x FROM ({EMB}), range(0,64) r(i) WHERE label <> 9 GROUP BY label, i"""


@query("cluster_centroids", f"SELECT label AS cluster, i::INT AS i, round(x,6) AS x FROM ({CENTROIDS})")
def cluster_centroids(t):
    rows = t.embeddings.select(F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"), "embedding")
    return rounded(agg.centroids(rows).select("cluster", F.posexplode_outer("centroid").alias("i", "x")), "x")


@query("cluster_sizes_and_weights", """SELECT label AS cluster, count(*) AS n, round(count(*)/sum(count(*)) OVER (),6) AS weight
  FROM embeddings WHERE label <> 9 GROUP BY label""")
def cluster_sizes_and_weights(t):
    rows = t.embeddings.select(F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"), "embedding")
    return rounded(agg.centroids(rows).select("cluster", "n", "weight"), "weight")


@query("cluster_count_and_mode", """SELECT c_mktsegment, count(DISTINCT c_nationkey) - max((c_nationkey=0)::INT) AS n_clusters,
  CASE WHEN count(DISTINCT c_nationkey) - max((c_nationkey=0)::INT) <= 10 THEN 'classification' ELSE 'regression' END AS mode
  FROM customer GROUP BY c_mktsegment""")
def cluster_count_and_mode(t):
    rows = t.customer.select("c_mktsegment", (F.col("c_nationkey") - 1).alias("cluster"))
    return agg.cluster_mode(rows, by=["c_mktsegment"])


@query("collection_limits", f"""SELECT collection, max(num_samples) AS max_samples, max(num_features) AS max_features FROM ({_COLLECTIONS})
  JOIN (SELECT dataset AS task_id, num_samples, num_features FROM ({_ORDER_PROFILE})) USING (task_id) GROUP BY collection""")
def collection_limits(t):
    return agg.collection_limits(drawn_collections(t), order_profile(t).withColumnRenamed("dataset", "task_id"), "task_id")


_TRIALS = f"""SELECT l_suppkey::INT AS number, avg(l_discount*{u_sql("('9|'||l_orderkey)")}) AS value FROM lineitem GROUP BY l_suppkey"""


def _fold_scores(t):
    from ..functions.hashing import uniform
    return t.lineitem.select(F.col("l_suppkey").cast("int").alias("number"), (F.col("l_discount") * uniform(9, F.col("l_orderkey"))).alias("score"))


@query("mean_score_per_trial", f"SELECT number, round(value,6) AS value FROM ({_TRIALS})")
def mean_score_per_trial(t):
    return rounded(agg.trial_scores(_fold_scores(t)), "value")


@query("best_trial", f"SELECT number, round(value,6) AS value FROM ({_TRIALS}) ORDER BY value DESC, number LIMIT 1")
def best_trial(t):
    return rounded(agg.best_trial(agg.trial_scores(_fold_scores(t))), "value")
