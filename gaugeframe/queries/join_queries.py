"""Joins over the driver tables."""

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators.blockwise import pair_distances, point_blocks
from ..operators.aggregates import centroids
from ..operators.knn import knn_join
from ..operators.sphere import category_points
from .frame_queries import order_profile, _ORDER_PROFILE
from .registry import EMB, RESULT_LINES, g_sql, query, result_lines, rounded, spread

_DIST = {"euclidean": "list_distance(a.v,b.v)", "cosine": "list_cosine_distance(a.v,b.v)",
         "manhattan": "list_sum(list_transform(list_zip(a.v,b.v), lambda p: abs(p[1]-p[2])))"}


def knn_sql(source: str, k: int, metric: str = "euclidean", on: str = "a.vec_id<>b.vec_id", extra: str = "") -> str:
    """Self-join neighbours of ``source(vec_id, v, …)`` as (q, t, distance, rank)."""
    return f"""SELECT q, t, distance, rank{extra and ', ' + extra} FROM (SELECT *, row_number() OVER (PARTITION BY q{extra and ', ' + extra}
      ORDER BY distance, t)::INT AS rank FROM (SELECT a.vec_id AS q, b.vec_id AS t, {_DIST[metric]} AS distance{extra and ', a.' + extra}
      FROM ({source}) a, ({source}) b WHERE {on})) WHERE rank <= {k}"""


def self_knn(t, k, metric="euclidean", **kw):
    return knn_join(t.embeddings, t.embeddings, k, query_id="vec_id", query_vec="embedding", train_id="vec_id",
                    train_vec="embedding", metric=metric, exclude_self=True, **kw)


def _rounded_sql(sql):
    return f"SELECT q, t, round(distance,6) AS distance, rank FROM ({sql})"


@query("knn_join_euclidean", _rounded_sql(knn_sql(EMB, 5)))
def knn_join_euclidean(t):
    return rounded(self_knn(t, 5), "distance")


@query("knn_join_manhattan", _rounded_sql(knn_sql(EMB, 5, "manhattan")))
def knn_join_manhattan(t):
    return rounded(self_knn(t, 5, "manhattan"), "distance")


@query("knn_join_cosine", _rounded_sql(knn_sql(EMB, 5, "cosine")))
def knn_join_cosine(t):
    return rounded(self_knn(t, 5, "cosine"), "distance")


@query("knn_join_cells", _rounded_sql(knn_sql(EMB, 5)))
def knn_join_cells(t):
    return rounded(self_knn(t, 5, strategy="cells", block_rows=128), "distance")


@query("knn_join_approximate")
def knn_join_approximate(t):
    """How many of the five nearest the approximate join finds, per vector."""
    kw = dict(block_rows=64)
    exact = self_knn(t, 5).select("q", "t").withColumn("found", F.lit(1))
    near = self_knn(t, 5, strategy="approx", probes=24, **kw).select("q", "t")
    return exact.drop("found").join(near.withColumn("found", F.lit(1)), ["q", "t"], "left").groupBy("q").agg(
        F.count("*").alias("wanted"), F.count("found").alias("found"))


@query("knn_join_per_dataset", "SELECT q, t, round(distance,6) AS distance, rank, label FROM (" +
       knn_sql(EMB, 3, on="a.vec_id<>b.vec_id AND a.label=b.label", extra="label") + ")")
def knn_join_per_dataset(t):
    return rounded(self_knn(t, 3, by=["label"]), "distance")




@query("knn_join_customers", """SELECT q, t, round(distance,6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, t)::INT AS rank
  FROM (SELECT a.k AS q, b.k AS t, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance
  FROM (SELECT s_suppkey AS k, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier) a,
       (SELECT c_custkey AS k, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer) b)) WHERE rank <= 4""")
def knn_join_customers(t):
    q = t.supplier.select("s_suppkey", F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("v"))
    c = t.customer.select("c_custkey", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("v"))
    return rounded(knn_join(q, c, 4, query_id="s_suppkey", query_vec="v", train_id="c_custkey", train_vec="v"), "distance")


MODELS = [dict(name="small", max_samples=8, max_features=5), dict(name="wide", max_samples=None, max_features=6),
          dict(name="tall", max_samples=14, max_features=3)]
EVALUATORS = [dict(name="knn", task_types=["Supervised Binary Classification", "Supervised Multiclass Classification"]),
              dict(name="ovo", task_types="Supervised Multiclass Classification")]


@query("work_plan", f"""SELECT dataset, m.name AS embedding_model, e.name AS algorithm FROM (SELECT *, CASE WHEN num_classes > 2 THEN 1 ELSE 0 END AS multi
  FROM ({_ORDER_PROFILE})) p, (VALUES ('small',8,5),('wide',1000000000,6),('tall',14,3)) m(name,n,d), (VALUES ('knn',0),('knn',1),('ovo',1)) e(name,task)
  WHERE p.num_samples <= m.n AND p.num_features <= m.d AND e.task = p.multi""")
def work_plan(t):
    from ..operators.projections import classification_type
    prof = order_profile(t).withColumn("task_type", classification_type())
    return jn.work_plan(prof, MODELS, EVALUATORS).select("dataset", "embedding_model", "algorithm")


@query("predictions_with_truth", """SELECT doc_id, quality, toxic, n_chars, lang FROM labels JOIN documents USING (doc_id)""")
def predictions_with_truth(t):
    return jn.join_truth(t.documents.select("doc_id", "n_chars", "lang"), t.labels, ["doc_id"]).select(
        "doc_id", "quality", "toxic", "n_chars", "lang")


def points_sql(source: str, column: str, dim: int) -> str:
    """Unit points of the distinct values ``v`` of ``source`` as rows (v, i, p)."""
    return f"""SELECT v, i, g/sqrt(sum(g*g) OVER (PARTITION BY v)) AS p FROM (SELECT v, i, {g_sql(f"('42|{column}|'||v||'|'||i)")} AS g
      FROM (SELECT DISTINCT v FROM ({source}) WHERE v IS NOT NULL), range(0,{dim}) r(i))"""


@query("category_vector_lookup", "SELECT c_custkey, " + ", ".join(
    f"round(coalesce(max(p) FILTER (i={i}), 0), 6) AS e{i}" for i in range(6)) + f""" FROM
  (SELECT c_custkey, CASE WHEN c_nationkey%4<>0 THEN c_mktsegment END AS v FROM customer)
  LEFT JOIN ({points_sql("SELECT c_mktsegment AS v FROM customer WHERE c_mktsegment <> 'BUILDING'", "seg", 6)}) USING (v) GROUP BY c_custkey""")
def category_vector_lookup(t):
    rows = t.customer.withColumn("seg", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")))
    known = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("seg"))
    return spread(jn.lookup_vectors(rows.select("c_custkey", "seg"), category_points(known, "seg", 6), "seg", 6).drop("seg"), "vector", 6)


@query("rows_by_centroids", f"""SELECT vec_id, c AS cluster, round(list_distance(v, m),6) AS distance FROM ({EMB}),
  (SELECT label AS c, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS x FROM ({EMB}), range(1,65) r(i) GROUP BY label, i) GROUP BY label)""")
def rows_by_centroids(t):
    blocks = point_blocks(centroids(t.embeddings, "embedding", "label"), "label", "centroid")
    return rounded(pair_distances(t.embeddings, "vec_id", "embedding", blocks), "distance")


@query("relabel_clusters", """SELECT vec_id, (CASE WHEN label < 6 THEN label // 2 ELSE -1 END)::INT AS merged FROM embeddings""")
def relabel_clusters(t):
    mapping = t.embeddings.filter("label < 6").select("label", F.floor(F.col("label") / 2).cast("int").alias("merged")).distinct()
    return jn.relabel(t.embeddings.select("vec_id", "label"), mapping, "label").select("vec_id", "merged")


@query("once_per_distinct_text", "SELECT doc_id, md5(text) AS digest, length(text)::INT AS size FROM documents")
def once_per_distinct_text(t):
    done = jn.once_per_value(t.documents.select("doc_id", "text"), "text", F.struct(
        F.md5("text").alias("digest"), F.length("text").alias("size")), "w")
    return done.select("doc_id", "w.digest", "w.size")


@query("results_with_embedding_metadata", f"""SELECT embedding_model, dataset_name, fold, repeat, count(*) AS n, round(max(auc_score),6) AS auc_score,
  max(num_features) AS num_features, max(time_to_compute_embedding) AS time_to_compute_embedding FROM ({RESULT_LINES})
  GROUP BY ALL""")
def results_with_embedding_metadata(t):
    keys = ["embedding_model", "dataset_name", "fold", "repeat"]
    lines = result_lines(t)
    meta = lines.select(*keys, "num_features", "time_to_compute_embedding").distinct()
    joined = jn.with_embedding_metadata(lines.select(*keys, "auc_score"), meta)
    got = joined.groupBy(*keys).agg(F.count("*").alias("n"), F.max("auc_score").alias("auc_score"),
                                    F.max("num_features").alias("num_features"),
                                    F.max("time_to_compute_embedding").alias("time_to_compute_embedding"))
    return rounded(got, "auc_score")
