"""Embedding operators over the driver tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import embed as emb, sphere as sph
from ..operators.splits import role_by_hash
from ..staging import stage
from .join_queries import points_sql
from .registry import EMB, g_sql, query, role_sql, rounded, spread, u_sql

DIM = 8
SEED = 42


def axis_sql(col: str, dim: int = DIM) -> str:
    """A numeric column's great circle as rows (i, p, t)."""
    return f"""SELECT i, p, t/sqrt(sum(t*t) OVER ()) AS t FROM (SELECT i, p, CASE WHEN i >= {dim // 2 * 2} THEN 0.0
      WHEN i%2=0 THEN lead(p) OVER (ORDER BY i) ELSE -lag(p) OVER (ORDER BY i) END AS t FROM
      (SELECT i, g/sqrt(sum(g*g) OVER ()) AS p FROM (SELECT i, {g_sql(f"('{SEED}|{col}|axis|'||i)")} AS g FROM range(0,{dim}) r(i))))"""


def sphere_sql(source: str, key: str, numeric: list[str], categorical: list[str], dim: int = DIM,
               by: str | None = None, train: str = "TRUE") -> str:
    """Sphere embedding of ``source`` as rows (key, i, e); ranges from rows where ``train`` holds, per ``by``."""
    total = len(numeric) + len(categorical)
    group = f"GROUP BY {by}" if by else ""
    match = f"s.{by} = m.{by}" if by else "TRUE"
    parts = []
    for c in numeric:
        pick = f"{by}, " if by else ""
        parts.append(f"""SELECT s.{key}, i, CASE WHEN s.{c} IS NOT NULL AND hi > lo THEN
          sin(pi()*(0.8*((s.{c}-lo)/(hi-lo))+0.1))*p + cos(pi()*(0.8*((s.{c}-lo)/(hi-lo))+0.1))*t ELSE 0 END AS val
          FROM ({source}) s JOIN (SELECT {pick}min({c}) AS lo, max({c}) AS hi FROM ({source}) WHERE {train} {group}) m ON {match},
          ({axis_sql(c, dim)})""")
    for c in categorical:
        parts.append(f"""SELECT s.{key}, i, p AS val FROM ({source}) s JOIN ({points_sql(f"SELECT {c} AS v FROM ({source})", c, dim)}) z ON s.{c} = z.v""")
        parts.append(f"""SELECT {key}, i, 0.0 AS val FROM ({source}), range(0,{dim}) r(i) WHERE {c} IS NULL""")
    return f"SELECT {key}, i, sum(val)/{total} AS e FROM ({' UNION ALL '.join(parts)}) GROUP BY {key}, i"


def wide_sql(long: str, key: str, dim: int = DIM) -> str:
    return f"SELECT {key}, " + ", ".join(f"round(max(e) FILTER (i={i}),6) AS e{i}" for i in range(dim)) + f" FROM ({long}) GROUP BY {key}"


ORDER_SOURCE = """SELECT o_orderkey, CASE WHEN o_custkey%13<>0 THEN o_totalprice END AS o_totalprice, epoch(o_orderdate)::DOUBLE AS o_orderdate,
  CASE WHEN o_custkey%17<>0 THEN o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders"""


def order_features(t):
    from ..operators.encoding import resolve_kinds
    rows = t.wide("orders").select("o_orderkey", F.when(F.col("o_custkey") % 13 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
                           F.when(F.col("o_custkey") % 17 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus")
    kinds = resolve_kinds(rows, rows.columns[1:], ["o_orderstatus"])
    return kinds.apply(rows, ["o_orderkey"]), kinds


@query("sphere_embedding", wide_sql(sphere_sql(ORDER_SOURCE, "o_orderkey", ["o_totalprice", "o_orderdate"], ["o_orderpriority", "o_orderstatus"]), "o_orderkey"))
def sphere_embedding(t):
    rows, kinds = order_features(t)
    model = sph.fit_sphere(rows, kinds.order, kinds.categorical, DIM, SEED)
    return spread(model.transform(rows, keep=["o_orderkey"]), "embedding", DIM)


_BY_SEGMENT = "SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey::VARCHAR AS c_nationkey FROM customer"


@query("sphere_embedding_per_dataset", wide_sql(sphere_sql(_BY_SEGMENT, "c_custkey", ["c_acctbal"], ["c_nationkey"], by="c_mktsegment"), "c_custkey"))
def sphere_embedding_per_dataset(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    model = sph.fit_sphere(rows, ["c_acctbal", "c_nationkey"], ["c_nationkey"], DIM, SEED, by="c_mktsegment")
    return spread(model.transform(rows, keep=["c_custkey"]), "embedding", DIM)


@query("sphere_embedding_by_join", wide_sql(sphere_sql(_BY_SEGMENT, "c_custkey", ["c_acctbal"], ["c_nationkey"], by="c_mktsegment",
                                                        train="c_custkey % 5 <> 0"), "c_custkey"))
def sphere_embedding_by_join(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    got = sph.sphere_by_join(rows, ["c_acctbal", "c_nationkey"], ["c_nationkey"], "c_mktsegment", DIM, SEED, rows.filter("c_custkey % 5 <> 0"))
    return spread(got.select("c_custkey", "embedding"), "embedding", DIM)


@query("sphere_category_points", f"SELECT v AS p_brand, i::INT AS i, round(p,6) AS x FROM ({points_sql('SELECT p_brand AS v FROM part', 'p_brand', 16)})")
def sphere_category_points(t):
    pts = sph.category_points(t.part, "p_brand", 16, SEED)
    return rounded(pts.select("p_brand", F.posexplode_outer("point").alias("i", "x")), "x")


@query("sphere_numeric_arc", wide_sql(sphere_sql("SELECT s_suppkey, CASE WHEN s_nationkey<>3 THEN s_acctbal END AS s_acctbal FROM supplier",
                                                 "s_suppkey", ["s_acctbal"], [], 7), "s_suppkey", 7))
def sphere_numeric_arc(t):
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") != 3, F.col("s_acctbal")).alias("s_acctbal"))
    span = rows.agg(F.min("s_acctbal"), F.max("s_acctbal")).first()
    return spread(rows.select("s_suppkey", sph.numeric_vector("s_acctbal", 7, span[0], span[1], SEED).alias("v")), "v", 7)


def _views(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.posexplode_outer(F.array(*[F.slice(v, 1 + 16 * i, 16) for i in range(4)])).alias("view", "embedding"))


@query("mean_of_views", "SELECT vec_id, " + ", ".join(f"round((v[{i + 1}]+v[{i + 17}]+v[{i + 33}]+v[{i + 49}])/4,6) AS e{i}" for i in range(16)) + f" FROM ({EMB})")
def mean_of_views(t):
    return spread(emb.aggregate_views(_views(t), "mean", ["vec_id"]), "embedding", 16)


@query("first_view", "SELECT vec_id, " + ", ".join(f"round(v[{i + 1}],6) AS e{i}" for i in range(16)) + f" FROM ({EMB})")
def first_view(t):
    return spread(emb.aggregate_views(_views(t), "first_element", ["vec_id"]), "embedding", 16)


@query("concatenated_views", "SELECT vec_id, " + ", ".join(f"round(v[{i + 1}],6) AS e{i}" for i in range(64)) + f" FROM ({EMB})")
def concatenated_views(t):
    return spread(emb.aggregate_views(_views(t), "concat", ["vec_id"]), "embedding", 64)


@query("leave_one_column_out")
def leave_one_column_out(t):
    from ..operators.gram import ColumnPredictors
    rows = t.wide("lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"))
    model = ColumnPredictors(rows)
    return spread(spread(model.views(model.predict(rows)).drop("features"), "embedding", 4), "predicted", 4, "p")


_U = u_sql("('42|target|0|'||o_orderkey)")
_BINOMIAL = np.cumsum([math.comb(10, k) * 0.5 ** k * 0.5 ** (10 - k) for k in range(11)])[:-1]
_POISSON = np.cumsum([math.exp(-1.0 - math.lgamma(k + 1)) for k in range(43)])[:-1]


def _steps(cdf):
    return "len(list_filter([" + ",".join(repr(float(c)) for c in cdf) + "], lambda c: u >= c))::DOUBLE"


@query("random_targets", f"""SELECT o_orderkey, 0.0::DOUBLE AS constant, round({g_sql("('42|target|0|'||o_orderkey)")},6) AS standard_normal,
  floor(u*10)::DOUBLE AS integers, (floor(ln(u)/ln(0.5))+1)::DOUBLE AS geometric, {_steps(_BINOMIAL)} AS binomial, {_steps(_POISSON)} AS poisson
  FROM (SELECT o_orderkey, {_U} AS u FROM orders)""")
def random_targets(t):
    kinds = ("standard_normal", *emb.DISCRETE)
    rows = t.wide("orders").select("o_orderkey", emb.constant_target().alias("constant"),
                           *[emb.random_target(k, "o_orderkey", seed=SEED).alias(k) for k in kinds])
    return rounded(rows, "standard_normal")


_ROLE = role_sql(42, "vec_id")


@query("cluster_distance_targets", f"""WITH e AS (SELECT *, {_ROLE} AS role FROM ({EMB})), c AS (SELECT label, n, list(x ORDER BY i) AS m FROM
  (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM e, range(1,65) r(i) WHERE role='train' GROUP BY label, i) GROUP BY label, n),
  d AS (SELECT vec_id, list_distance(v,m) AS d, n/sum(n) OVER (PARTITION BY vec_id) AS w FROM e, c)
  SELECT vec_id, round(-min(d),6) AS e0, round(-sum(d*w),6) AS e1, round(stddev_pop(d),6) AS e2 FROM d GROUP BY vec_id""")
def cluster_distance_targets(t):
    rows = t.embeddings.withColumn("role", role_by_hash("vec_id"))
    got = emb.cluster_distance_targets(rows.filter("role = 'train'"), rows, ("min", "mean", "std"), cluster="label")
    return spread(got.select("vec_id", "targets"), "targets", 3)


@query("inductive_cluster_labels")
def inductive_cluster_labels(t):
    rows = t.embeddings.withColumn("role", role_by_hash("vec_id"))
    train = emb.fit_clusters(rows.filter("role = 'train'"), k=10, far_share=0.05)
    train = stage(train.select("vec_id", "embedding", "cluster"), "clusters")
    return emb.assign_clusters(train, rows.filter("role = 'test'"), "vec_id", "embedding")


@query("inductive_vote", f"""SELECT q, label::INT AS cluster FROM (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY count(*) FILTER (d=0) DESC,
  coalesce(sum(1/nullif(d,0)),0) DESC, label) AS r FROM (SELECT a.vec_id AS q, b.label, list_distance(a.v,b.v) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v,b.v), b.vec_id) AS rank
  FROM (SELECT *, {_ROLE} AS role FROM ({EMB})) a, (SELECT *, {_ROLE} AS role FROM ({EMB})) b WHERE a.role='test' AND b.role='train')
  WHERE rank <= 15 GROUP BY q, label) WHERE r = 1""")
def inductive_vote(t):
    rows = t.embeddings.withColumn("role", role_by_hash("vec_id"))
    return emb.assign_clusters(rows.filter("role = 'train'"), rows.filter("role = 'test'"), "vec_id", "embedding", "label").withColumnRenamed(
        "label", "cluster")


def _merge_sql(labels: int, keep: int) -> str:
    """Ward's criterion on the label centroids, a join at a time."""
    cost = "list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) * a.n * b.n / (a.n + b.n)"
    steps = [f"""c0 AS MATERIALIZED (SELECT label AS id, 1.0::DOUBLE AS n, list(x ORDER BY i) AS v, [label] AS members FROM
      (SELECT label, i, avg(v[i]) AS x FROM ({EMB}), range(1,65) r(i) GROUP BY label, i) GROUP BY label)"""]
    for k in range(labels - keep):
        steps.append(f"p{k} AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM c{k} a, c{k} b WHERE a.id < b.id ORDER BY {cost}, a.id, b.id LIMIT 1)")
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT id, n, v, members FROM c{k}, p{k} WHERE id NOT IN (i, j) UNION ALL
          SELECT a.id, a.n + b.n, list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] * a.n + b.v[i] * b.n) / (a.n + b.n)), list_concat(a.members, b.members)
          FROM c{k} a, c{k} b, p{k} WHERE a.id = p{k}.i AND b.id = p{k}.j)""")
    return f"""WITH {', '.join(steps)}, named AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS merged, unnest(members) AS label FROM c{labels - keep})
      SELECT vec_id, merged FROM embeddings JOIN named USING (label)"""


@query("merged_clusters", _merge_sql(10, 4))
def merged_clusters(t):
    return emb.merge_clusters(t.embeddings, cluster="label", max_clusters=4).select("vec_id", "merged")


_POOL = [("customer", "c_custkey", "c_acctbal", "c_mktsegment"), ("supplier", "s_suppkey", "s_acctbal", None), ("part", "p_partkey", "p_retailprice", "p_type")]


@query("pooled_embeddings", " UNION ALL ".join(
    f"SELECT {i}::INT AS label, row_id, " + ", ".join(f"e{j}" for j in range(4)) + " FROM (" + wide_sql(sphere_sql(
        f"SELECT {k} AS row_id, {n} AS num{', ' + c + ' AS cat' if c else ''} FROM {tab}", "row_id", ["num"], ["cat"] if c else [], 4), "row_id", 4) + ")"
    for i, (tab, k, n, c) in enumerate(_POOL)))
def pooled_embeddings(t):
    parts = []
    for tab, k, n, c in _POOL:
        rows = getattr(t, tab).select(F.col(k).alias("row_id"), F.col(n).alias("num"), *([F.col(c).alias("cat")] if c else []))
        cols = ["num", "cat"] if c else ["num"]
        parts.append(sph.fit_sphere(rows, cols, cols[1:], 4, SEED).transform(rows, keep=["row_id"]))
    return spread(emb.pool_embeddings(parts), "embedding", 4)


@query("pca_reduction")
def pca_reduction(t):
    return spread(emb.reduce_pca(t.embeddings, k=3).select("vec_id", "reduced"), "reduced", 3)


@query("kernel_pca_reduction")
def kernel_pca_reduction(t):
    return spread(emb.reduce_kernel_pca(t.embeddings, k=2).select("vec_id", "reduced"), "reduced", 2)


@query("table_vectorizer")
def table_vectorizer(t):
    cols = ["o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus"]
    rows = t.orders.select("o_orderkey", *cols)
    got = emb.TableVectorizer(cols).fit(rows).transform(rows)
    return got.select("o_orderkey", F.size("embedding").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("table_vectorizer_text")
def table_vectorizer_text(t):
    rows = t.wide("documents").select("doc_id", "text", "lang")
    got = emb.TableVectorizer(["text", "lang"]).fit(rows).transform(rows)
    return got.select("doc_id", F.size("embedding").alias("dim"))
