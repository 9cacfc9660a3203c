"""Metrics over predictions derived from the driver tables."""

from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators import gram, metrics as met
from .registry import EMB, ORACLES, auc_sql, query, rounded, u_sql

# Binary: is the line finished; a continuous and a heavily tied score.
_BINARY = """SELECT l_returnflag, l_linestatus, (l_linestatus='F')::INT AS y, l_extendedprice*(1-l_discount) AS price,
  l_discount AS tied FROM lineitem"""


def _binary(t):
    return t.wide("lineitem").select("l_returnflag", "l_linestatus", (F.col("l_linestatus") == "F").cast("int").alias("y"),
                             (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"), F.col("l_discount").alias("tied"))


@query("auc_binary", auc_sql(_BINARY, "l_returnflag", "y", "price"))
def auc_binary(t):
    return rounded(met.roc_auc(_binary(t), ["l_returnflag"], "y", "price"), "auc_score")


@query("auc_binary_ties", auc_sql(_BINARY, "l_returnflag", "y", "tied"))
def auc_binary_ties(t):
    return rounded(met.roc_auc(_binary(t), ["l_returnflag"], "y", "tied"), "auc_score")


@query("auc_one_class_groups", auc_sql(_BINARY, "l_linestatus", "y", "price"))
def auc_one_class_groups(t):
    return rounded(met.roc_auc(_binary(t), ["l_linestatus"], "y", "price"), "auc_score")


@query("auc_per_user_events", auc_sql("SELECT user_id, (event_type='error')::INT AS y, value FROM events", "user_id", "y", "value"))
def auc_per_user_events(t):
    rows = t.events.select("user_id", (F.col("event_type") == "error").cast("int").alias("y"), "value")
    return rounded(met.roc_auc(rows, ["user_id"], "y", "value"), "auc_score")


# Multiclass: three return flags with normalised pseudo-probabilities.
_MULTI = """SELECT l_linestatus, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS y,
  [a/(a+b+c), b/(a+b+c), c/(a+b+c)] AS proba FROM (SELECT *, l_quantity AS a, l_extendedprice/2000 AS b, 1+(l_discount+l_tax)*200 AS c FROM lineitem)"""


def _multi(t):
    a, b, c = F.col("l_quantity"), F.col("l_extendedprice") / 2000, 1 + (F.col("l_discount") + F.col("l_tax")) * 200
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t.wide("lineitem").select("l_linestatus", y.alias("y"), F.array(a / (a + b + c), b / (a + b + c), c / (a + b + c)).alias("proba"))


_OVR = f"""SELECT l_linestatus, c, auc_score, n FROM ({auc_sql(
    f"SELECT l_linestatus||'|'||c AS key, (y=c)::INT AS hit, proba[c+1] AS s FROM ({_MULTI}), range(0,3) r(c)", "key", "hit", "s")
    .replace("round(", "(").replace(", 6) AS", ") AS")})
  JOIN (SELECT l_linestatus, y AS c, l_linestatus||'|'||y AS key, count(*) AS n FROM ({_MULTI}) GROUP BY ALL) USING (key)"""


@query("auc_one_vs_rest", f"SELECT l_linestatus, round(avg(auc_score),6) AS auc_score_ovr FROM ({_OVR}) GROUP BY l_linestatus")
def auc_one_vs_rest(t):
    return rounded(met.roc_auc_ovr(_multi(t), ["l_linestatus"]), "auc_score_ovr")


@query("auc_one_vs_rest_weighted", f"SELECT l_linestatus, round(sum(auc_score*n)/sum(n),6) AS auc_score_ovr FROM ({_OVR}) GROUP BY l_linestatus")
def auc_one_vs_rest_weighted(t):
    return rounded(met.roc_auc_ovr(_multi(t), ["l_linestatus"], average="weighted"), "auc_score_ovr")


@query("auc_one_vs_one", "SELECT split_part(key,'|',1) AS l_linestatus, round(avg(auc_score),6) AS auc_score_ovo FROM (" + auc_sql(
    f"SELECT l_linestatus||'|'||a||'|'||b AS key, (y=a)::INT AS hit, proba[a+1] AS s FROM ({_MULTI}), range(0,3) p(a), range(0,3) q(b) "
    "WHERE a<>b AND (y=a OR y=b)", "key", "hit", "s").replace("round(", "(").replace(", 6) AS", ") AS") + ") GROUP BY 1")
def auc_one_vs_one(t):
    return rounded(met.roc_auc_ovo(_multi(t), ["l_linestatus"]), "auc_score_ovo")


@query("multiclass_log_loss", f"""SELECT l_linestatus, round(avg(-ln(least(greatest(proba[y+1], 2.220446049250313e-16), 1-2.220446049250313e-16))),6)
  AS log_loss_score FROM ({_MULTI}) GROUP BY l_linestatus""")
def multiclass_log_loss(t):
    return rounded(_multi(t).groupBy("l_linestatus").agg(met.log_loss().alias("log_loss_score")), "log_loss_score")


_REG = f"""SELECT o_orderpriority, o_totalprice AS y, o_totalprice*(0.9+0.2*{u_sql("('7|'||o_orderkey)")}) AS prediction FROM orders"""


def _regression(t):
    return t.wide("orders").select("o_orderpriority", F.col("o_totalprice").alias("y"),
                           (F.col("o_totalprice") * (0.9 + 0.2 * uniform(7, F.col("o_orderkey")))).alias("prediction"))


@query("regression_metrics", f"""SELECT o_orderpriority, round(avg(abs(y-prediction)),4) AS mae_score,
  round(avg(abs(y-prediction)/greatest(abs(y),2.220446049250313e-16)),6) AS mape_score,
  round(1-sum((y-prediction)*(y-prediction))/(var_pop(y)*count(*)),6) AS r2_score,
  round(sqrt(avg((y-prediction)*(y-prediction))),4) AS rmse_score FROM ({_REG}) GROUP BY o_orderpriority""")
def regression_metrics(t):
    got = met.compute_metrics(_regression(t), met.REGRESSION, ["o_orderpriority"])
    return rounded(rounded(got, "mape_score", "r2_score"), "mae_score", "rmse_score", places=4)


@query("constant_target_r2", """SELECT o_orderpriority, CASE WHEN sum(pow(y-m,2)) > 0 THEN 1-sum(pow(y-prediction,2))/sum(pow(y-m,2))
  WHEN sum(pow(y-prediction,2)) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS r2_score FROM (SELECT *, avg(y) OVER (PARTITION BY o_orderpriority) AS m
  FROM (SELECT o_orderpriority, 2.0::DOUBLE AS y, (CASE o_orderpriority WHEN '5-LOW' THEN 1.0 ELSE 2.0 END)::DOUBLE AS prediction FROM orders)) GROUP BY o_orderpriority""")
def constant_target_r2(t):
    rows = t.orders.select("o_orderpriority", F.lit(2.0).alias("y"),
                           F.when(F.col("o_orderpriority") == "5-LOW", 1.0).otherwise(2.0).alias("prediction"))
    return rows.groupBy("o_orderpriority").agg(met.r2().alias("r2_score"))


@query("negative_mse", f"SELECT o_orderpriority, round(-avg((y-prediction)*(y-prediction)),2) AS score FROM ({_REG}) GROUP BY o_orderpriority")
def negative_mse(t):
    return rounded(_regression(t).groupBy("o_orderpriority").agg(met.neg_mse().alias("score")), "score", places=2)


_CALLED = """SELECT l_linestatus, (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)::INT AS y,
  (CASE WHEN l_quantity < 10 THEN 0 WHEN l_discount < 0.05 THEN 1 ELSE 2 END)::INT AS prediction FROM lineitem"""


@query("f1_weighted", f"""SELECT l_linestatus, round(sum(s * CASE WHEN s + c = 0 THEN 0 ELSE 2.0*r/(s+c) END)/sum(s),6) AS f1_weighted FROM (
  SELECT l_linestatus, k, count(*) FILTER (y=k) AS s, count(*) FILTER (prediction=k) AS c, count(*) FILTER (y=k AND prediction=k) AS r
  FROM ({_CALLED}), range(0,3) x(k) GROUP BY l_linestatus, k) GROUP BY l_linestatus""")
def f1_weighted(t):
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    p = F.when(F.col("l_quantity") < 10, 0).when(F.col("l_discount") < 0.05, 1).otherwise(2)
    rows = t.wide("lineitem").select("l_linestatus", y.alias("y"), p.alias("prediction"))
    return rounded(met.f1_weighted(rows, ["l_linestatus"]), "f1_weighted")


@query("multiclass_metric_set", f"""SELECT l_linestatus, auc_score_ovr, auc_score_ovo, log_loss_score FROM ({ORACLES['auc_one_vs_rest']})
  JOIN ({ORACLES['auc_one_vs_one']}) USING (l_linestatus) JOIN ({ORACLES['multiclass_log_loss']}) USING (l_linestatus)""")
def multiclass_metric_set(t):
    got = met.compute_metrics(_multi(t), met.MULTICLASS, ["l_linestatus"])
    return rounded(got, "auc_score_ovr", "auc_score_ovo", "log_loss_score")


@query("custom_metric_registry", f"""SELECT o_orderpriority, round(max(abs(y-prediction)),4) AS worst FROM ({_REG}) GROUP BY o_orderpriority""")
def custom_metric_registry(t):
    worst = {met.REGRESSION: {"worst": lambda y="y", p="prediction": F.max(F.abs(F.col(y) - F.col(p)))}}
    return rounded(met.compute_metrics(_regression(t), met.REGRESSION, ["o_orderpriority"], worst), "worst", places=4)


@query("rank_me")
def rank_me(t):
    both = t.embeddings.select(F.explode(F.array(F.lit("all"), F.concat(F.lit("label_"), F.col("label").cast("string")))).alias("part"), "embedding")
    return rounded(gram.rank_me(both, by=["part"]), "rank_me")


@query("alpha_req")
def alpha_req(t):
    return rounded(gram.alpha_req(t.embeddings), "alpha_req")


@query("gram_matrix", f"""SELECT label, count(*) AS n, round(sum(list_sum(list_transform(v, lambda x: x*x))),6) AS trace,
  round(sum(v[1]*v[2]),6) AS g01, round(sum(v[64]*v[1]),6) AS g63 FROM ({EMB}) GROUP BY label""")
def gram_matrix(t):
    import numpy as np
    import pandas as pd

    def facts(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = np.frombuffer(r.gram).reshape(r.dim, r.dim)
                rows.append((r.label, r.n, round(float(np.trace(g)), 6), round(float(g[0, 1]), 6), round(float(g[63, 0]), 6)))
            yield pd.DataFrame(rows, columns=["label", "n", "trace", "g01", "g63"])

    return gram.gram_matrices(t.embeddings, by=["label"]).mapInPandas(facts, "label int, n bigint, trace double, g01 double, g63 double")
