"""Admission, projection, typing and encoding over the driver tables."""

from pyspark.sql import functions as F

from ..operators import admission as adm, encoding as enc, projections as prj
from ..operators.aggregates import profile_datasets
from ..operators.joins import missing_names, stack_results
from .registry import EMB, RESULT_LINES, query, result_lines, rounded

# ---- admission ---------------------------------------------------------------------------------------------------

_ORDER_PROFILE = """SELECT o_custkey AS dataset, count(*) AS num_samples, count(DISTINCT o_orderpriority) AS num_classes,
  (1 + max(o_custkey % 7))::INT AS num_features, count(*) FILTER (o_custkey % 11 = 0) AS missing_values
  FROM orders GROUP BY o_custkey"""


def order_profile(t):
    return t.orders.groupBy(F.col("o_custkey").alias("dataset")).agg(
        F.count("*").alias("num_samples"), F.count_distinct("o_orderpriority").alias("num_classes"),
        (1 + F.max(F.col("o_custkey") % 7)).cast("int").alias("num_features"),
        F.count_if(F.col("o_custkey") % 11 == 0).alias("missing_values"))


@query("dataset_admission", f"""SELECT dataset, concat_ws(' | ',
  CASE WHEN num_samples > 12 THEN 'too many samples: '||num_samples||' > 12' END,
  CASE WHEN num_features > 4 THEN 'too many features: '||num_features||' > 4' END) AS reason FROM ({_ORDER_PROFILE})""")
def dataset_admission(t):
    return adm.admit_datasets(order_profile(t), 12, 4).select("dataset", "reason")


@query("model_size_gate", f"""SELECT dataset, num_samples <= 10 AND num_features <= 5 AS fits FROM ({_ORDER_PROFILE})""")
def model_size_gate(t):
    return order_profile(t).select("dataset", adm.model_fits(F.lit(10), F.lit(5)).alias("fits"))


@query("missing_value_gate", f"""SELECT dataset, num_samples FROM ({_ORDER_PROFILE}) WHERE missing_values = 0""")
def missing_value_gate(t):
    kept, _ = adm.split_admitted(adm.admit_datasets(order_profile(t), 10**9, 10**9, skip_missing=True))
    return kept.select("dataset", "num_samples")


@query("allow_and_deny_lists", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def allow_and_deny_lists(t):
    name = F.col("c_custkey").alias("o_custkey")
    kept = adm.keep_listed(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])
    kept = adm.drop_listed(kept, "o_custkey", t.customer.filter("c_mktsegment = 'BUILDING'").select(name))
    return adm.keep_listed(kept, "o_custkey", t.customer.filter("c_acctbal > 0").select(name)).select("o_orderkey", "o_custkey")


@query("embedding_validity", f"""SELECT label, count(*) AS num_rows, min(len(v))::INT AS min_dim, max(len(v))::INT AS max_dim,
  count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS bad_rows,
  min(len(v)) = max(len(v)) AND count(*) FILTER (len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) = 0 AS valid
  FROM (SELECT label, CASE WHEN label = 3 AND vec_id % 2 = 0 THEN v[1:60] ELSE
        list_transform(v, lambda x: CASE WHEN label = 5 THEN x / (CASE WHEN x > 0.2 THEN 0.0 ELSE 1.0 END) ELSE x END) END AS v FROM ({EMB}))
  GROUP BY label""")
def embedding_validity(t):
    v = F.col("embedding").cast("array<double>")
    inf = F.lit(float("inf"))
    spoiled = F.when((F.col("label") == 3) & (F.col("vec_id") % 2 == 0), F.slice(v, 1, 60)).when(
        F.col("label") == 5, F.transform(v, lambda x: F.when(x > 0.2, inf).otherwise(x))).otherwise(v)
    return adm.embedding_report(t.embeddings.withColumn("embedding", spoiled), by=["label"])


@query("keep_models", f"""SELECT embedding_model, count(*) AS n FROM ({RESULT_LINES})
  WHERE embedding_model IN ('model_A','model_R') GROUP BY embedding_model""")
def keep_models(t):
    return adm.keep_listed(result_lines(t), "embedding_model", ["model_A", "model_R"]).groupBy("embedding_model").agg(
        F.count("*").alias("n"))


@query("split_by_task_type", f"""SELECT task, count(*) AS n, round(max(auc_score),6) AS best FROM ({RESULT_LINES})
  GROUP BY task""")
def split_by_task_type(t):
    parts = adm.split_by_task(result_lines(t))
    return rounded(stack_results([p.groupBy("task").agg(F.count("*").alias("n"), F.max("auc_score").alias("best"))
                                  for p in parts.values()]), "best")


@query("null_tolerant_parameter_filter", f"""SELECT algorithm, count(*) AS n, count(algorithm_metric) AS with_metric
  FROM ({RESULT_LINES}) WHERE (algorithm_metric = 'euclidean' OR algorithm_metric IS NULL)
  AND (algorithm_weights = 'distance' OR algorithm_weights IS NULL) GROUP BY algorithm""")
def null_tolerant_parameter_filter(t):
    kept = adm.equals_or_missing(result_lines(t), {"algorithm_metric": "euclidean", "algorithm_weights": "distance"})
    return kept.groupBy("algorithm").agg(F.count("*").alias("n"), F.count("algorithm_metric").alias("with_metric"))


@query("finite_input_check", "SELECT vec_id, label FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND label IS NOT NULL")
def finite_input_check(t):
    return adm.require_finite(t.embeddings, "embedding", "label").select("vec_id", "label")


# ---- projections -------------------------------------------------------------------------------------------------


@query("feature_projection", """SELECT p_partkey, p_brand, p_type, p_size FROM part""")
def feature_projection(t):
    return prj.select_features(t.part.drop("p_name"), "p_retailprice", ["p_partkey"])


_SPREAD = [("l_quantity", "l_quantity"), ("flag", "CASE WHEN l_linenumber > 1 THEN 'x' END"), ("fixed", "1"),
           ("none", "CAST(NULL AS DOUBLE)"), ("l_tax", "l_tax")]


@query("constant_column_detection", "SELECT l_returnflag, column_name AS \"column\", k <= 1 AS is_constant FROM (" + " UNION ALL ".join(
    f"SELECT l_returnflag, '{n}' AS column_name, count(DISTINCT {e}) AS k FROM lineitem GROUP BY l_returnflag" for n, e in _SPREAD) + ")")
def constant_column_detection(t):
    rows = t.lineitem.select("l_returnflag", *[F.expr(e).cast("string").alias(n) for n, e in _SPREAD])
    return prj.column_spread(rows, [n for n, _ in _SPREAD], ["l_returnflag"])


@query("drop_constant_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  CASE WHEN l_linenumber > 3 THEN 'x' ELSE 'y' END AS kind FROM lineitem""")
def drop_constant_columns(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", F.lit(1).alias("fixed"),
                             F.lit(None).cast("double").alias("none"),
                             F.when(F.col("l_linenumber") > 3, "x").otherwise("y").alias("kind"))
    kept, kinds = prj.drop_constant_columns(rows, {"l_quantity": False, "fixed": False, "none": False, "kind": True})
    assert list(kinds) == ["l_quantity", "kind"]
    return kept


@query("rename_models", f"""SELECT CASE embedding_model WHEN 'model_A' THEN 'alpha' WHEN 'model_N' THEN 'nu' ELSE embedding_model END
  AS embedding_model, count(*) AS n FROM ({RESULT_LINES}) GROUP BY 1""")
def rename_models(t):
    return prj.rename_values(result_lines(t), "embedding_model", {"model_A": "alpha", "model_N": "nu"}).groupBy(
        "embedding_model").agg(F.count("*").alias("n"))


@query("result_column_order", f"""SELECT embedding_model, count(*) AS n, algorithm FROM ({RESULT_LINES}) GROUP BY ALL""")
def result_column_order(t):
    return prj.order_result_columns(result_lines(t).groupBy("algorithm", "embedding_model").agg(F.count("*").alias("n")))


@query("positive_class_probability", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round([1-l_discount, l_discount][2], 6) AS prediction FROM lineitem""")
def positive_class_probability(t):
    rows = t.lineitem.withColumn("proba", F.array(1 - F.col("l_discount"), F.col("l_discount")))
    return rounded(rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                               prj.positive_probability().alias("prediction")), "prediction")


@query("outlier_ratio_bins", f"""SELECT CASE WHEN outlier_ratio < 0.05 THEN '<0.05' WHEN outlier_ratio < 0.1 THEN '[0.05,0.1)'
  WHEN outlier_ratio < 0.25 THEN '[0.1,0.25)' WHEN outlier_ratio >= 0.25 THEN '>=0.25' END AS bin, count(*) AS n
  FROM (SELECT CASE WHEN outlier_ratio <> 0.3 THEN outlier_ratio END AS outlier_ratio FROM ({RESULT_LINES})) GROUP BY 1""")
def outlier_ratio_bins(t):
    rows = result_lines(t).withColumn("outlier_ratio", F.when(F.col("outlier_ratio") != 0.3, F.col("outlier_ratio")))
    return rows.groupBy(prj.edge_label("outlier_ratio", [0.05, 0.1, 0.25]).alias("bin")).agg(F.count("*").alias("n"))


@query("derive_task_type", f"""SELECT dataset, num_classes, CASE WHEN num_classes > 2 THEN 'Supervised Multiclass Classification'
  ELSE 'Supervised Binary Classification' END AS task_type FROM ({_ORDER_PROFILE})""")
def derive_task_type(t):
    return order_profile(t).select("dataset", "num_classes", prj.classification_type().alias("task_type"))


@query("flatten_parameters", f"""SELECT embedding_model, algorithm, algorithm_metric, algorithm_weights, count(*) AS n
  FROM ({RESULT_LINES}) GROUP BY ALL""")
def flatten_parameters(t):
    lines = result_lines(t)
    packed = lines.select("embedding_model", "algorithm", F.map_filter(
        F.create_map(F.lit("metric"), F.col("algorithm_metric"), F.lit("weights"), F.col("algorithm_weights")),
        lambda k, v: v.isNotNull()).alias("params"))
    flat = prj.flatten_params(packed, ["metric", "weights"])
    return flat.groupBy(*flat.columns).agg(F.count("*").alias("n"))


# ---- typing and encoding -----------------------------------------------------------------------------------------

_MIXED = """CASE WHEN p_size % 5 = 0 THEN 'inf' WHEN p_size % 7 = 0 THEN p_type WHEN p_size % 11 = 0 THEN 'NaN'
  WHEN p_size % 13 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) || '.5' END"""


def mixed_text():
    return F.expr(_MIXED.replace("VARCHAR", "STRING"))


@query("coerce_values_to_number", f"""SELECT p_partkey, CASE WHEN isfinite(x) THEN x END AS x FROM
  (SELECT p_partkey, TRY_CAST({_MIXED} AS DOUBLE) AS x FROM part)""")
def coerce_values_to_number(t):
    return t.part.select("p_partkey", mixed_text().alias("x")).withColumn("x", enc.to_number("x"))


_KINDS = [("key_text", "CAST(o_orderkey AS VARCHAR)"), ("priority", "o_orderpriority"),
          ("level", "substr(o_orderpriority,1,1)"), ("late", "CASE WHEN o_orderstatus='F' THEN '0.25' END"),
          ("almost", "CASE WHEN o_orderkey=17 THEN 'bad' ELSE '3' END")]


@query("resolve_column_kinds", " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", count(x) AS present, count(*) FILTER (x IS NOT NULL AND TRY_CAST(x AS DOUBLE) IS NULL) AS failed "
    f"FROM (SELECT {e} AS x FROM orders)" for n, e in _KINDS))
def resolve_column_kinds(t):
    rows = t.orders.select(*[F.expr(e.replace("VARCHAR", "STRING")).alias(n) for n, e in _KINDS])
    return enc.cast_failures(rows, [n for n, _ in _KINDS])


@query("apply_column_kinds", """SELECT o_orderkey, epoch(o_orderdate)::DOUBLE AS o_orderdate, o_totalprice,
  substr(o_orderpriority,1,1)::DOUBLE AS level, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""")
def apply_column_kinds(t):
    rows = t.orders.withColumn("level", F.substring("o_orderpriority", 1, 1))
    kinds = enc.resolve_kinds(rows, ["o_orderdate", "o_totalprice", "level", "o_orderpriority", "o_custkey"], ["o_custkey"])
    return kinds.apply(rows, ["o_orderkey"])


@query("datetime_to_epoch_seconds", """SELECT event_id, floor(epoch_us(ts)/1000000)::DOUBLE AS seconds FROM events""")
def datetime_to_epoch_seconds(t):
    rows = t.events
    return rows.select("event_id", enc.epoch_seconds("ts", rows.schema["ts"].dataType).alias("seconds"))


@query("factorize_first_seen", """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code
  FROM part WHERE p_size < 25 AND p_partkey % 10 < 7 GROUP BY p_brand)
  SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN c USING (p_brand)""")
def factorize_first_seen(t):
    codes = enc.fit_first_seen_codes(t.part.filter("p_size < 25 and p_partkey % 10 < 7"), "p_brand", "p_partkey")
    return enc.apply_codes(t.part, codes, "p_brand").select("p_partkey", "code")


@query("label_encode", """SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer""")
def label_encode(t):
    codes = enc.fit_label_codes(t.customer, "c_mktsegment")
    return enc.apply_label_codes(t.customer, codes, "c_mktsegment").select("c_custkey", "code")


@query("label_encode_per_dataset", """SELECT c_custkey, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) - 1 AS code
  FROM customer""")
def label_encode_per_dataset(t):
    codes = enc.fit_label_codes(t.customer, "c_nationkey", ["c_mktsegment"])
    return enc.apply_label_codes(t.customer, codes, "c_nationkey", ["c_mktsegment"]).select("c_custkey", "code")


@query("one_hot_targets", """SELECT vec_id, """ + ", ".join(f"(label={i})::INT AS c{i}" for i in range(10)) + " FROM embeddings")
def one_hot_targets(t):
    hot = t.embeddings.select("vec_id", enc.one_hot("label", 10).alias("h"))
    return hot.select("vec_id", *[F.col("h")[i].alias(f"c{i}") for i in range(10)])


_CARD = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_partkey"]


@query("infer_categorical_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values, count(*) > 100 AND count(DISTINCT {c}) < 4 AS is_categorical "
    "FROM lineitem" for c in _CARD))
def infer_categorical_columns(t):
    return enc.infer_categorical(t.lineitem, _CARD)


@query("identifier_join", """SELECT l_orderkey||'_'||l_partkey||'_'||l_suppkey||'_'||l_linenumber AS ids, count(*) AS n FROM lineitem GROUP BY 1""")
def identifier_join(t):
    ids = t.lineitem.select(F.array("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint")).alias("ids"))
    return ids.groupBy(enc.join_ids("ids").alias("ids")).agg(F.count("*").alias("n"))


# ---- set operations, sorts ---------------------------------------------------------------------------------------


@query("stack_result_shapes", """SELECT 'customer' AS source, count(*) AS n, round(sum(c_acctbal),2) AS balance, count(NULL) AS sizes FROM customer
  UNION ALL SELECT 'part', count(*), NULL, count(p_size) FROM part""")
def stack_result_shapes(t):
    a = t.customer.select(F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"))
    b = t.part.select(F.lit("part").alias("source"), F.col("p_size").alias("size"))
    return stack_results([a, b]).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"),
                                                        F.count("size").alias("sizes"))


@query("customers_without_urgent_orders", """SELECT c_custkey FROM customer EXCEPT
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def customers_without_urgent_orders(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return missing_names(t.customer, urgent, "c_custkey")


@query("distinct_texts", """SELECT lang, count(*) AS n FROM (SELECT DISTINCT lang, text FROM documents) GROUP BY lang""")
def distinct_texts(t):
    return t.documents.select("lang", "text").distinct().groupBy("lang").agg(F.count("*").alias("n"))


@query("report_order", f"""SELECT embedding_model, algorithm, row_number() OVER (ORDER BY embedding_model, algorithm) AS line FROM
  (SELECT DISTINCT embedding_model, algorithm FROM ({RESULT_LINES}))""")
def report_order(t):
    from ..operators.ranks import number_rows
    lines = result_lines(t).select("embedding_model", "algorithm").distinct()
    return number_rows(lines, ["embedding_model", "algorithm"], "line").withColumn("line", F.col("line") + 1)


@query("dataset_profile", """SELECT l_returnflag AS dataset, count(*) AS num_samples, 6::INT AS num_features,
  (sum((l_linenumber=1)::INT))::BIGINT AS missing_values, count(DISTINCT l_linestatus) AS num_classes,
  round(100.0*5/6, 6) AS pct_numeric, round(6.0/count(*), 9) AS features_per_sample FROM lineitem GROUP BY l_returnflag""")
def dataset_profile(t):
    rows = t.lineitem.withColumn("dataset", F.col("l_returnflag")).withColumn(
        "gap", F.when(F.col("l_linenumber") != 1, F.col("l_tax")))
    got = profile_datasets(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gap", "l_linenumber"],
                           "l_linestatus", ["dataset"], ["l_linenumber"])
    return got.withColumn("pct_numeric", F.round("pct_numeric", 6)).withColumn(
        "features_per_sample", F.round("features_per_sample", 9))
