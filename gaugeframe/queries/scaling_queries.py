"""Scaling, splits and samples over the driver tables."""

from pyspark.sql import functions as F

from ..operators import scaling as scl, splits as spl
from .frame_queries import order_profile, _ORDER_PROFILE
from .registry import query, role_sql, rounded, u_sql

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_K = ", ".join(_KEYS)


def _slim(t):
    return t.wide("lineitem").select(*_KEYS, *_COLS)


@query("standard_scaling", "SELECT " + _K + ", " + ", ".join(
    f"round((l.{c}-m_{c})/CASE WHEN s_{c}=0 THEN 1 ELSE s_{c} END, 6) AS {c}" for c in _COLS) + " FROM lineitem l, (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _COLS) + " FROM lineitem)")
def standard_scaling(t):
    rows = _slim(t)
    return rounded(scl.fit_standard(rows, _COLS).apply(rows), *_COLS)


@query("standard_scaling_per_dataset", "SELECT " + _K + ", " + ", ".join(
    f"round(({c}-avg({c}) OVER w)/coalesce(nullif(stddev_pop({c}) OVER w,0),1), 6) AS {c}" for c in _COLS) +
    " FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def standard_scaling_per_dataset(t):
    rows = t.lineitem.select(*_KEYS, "l_returnflag", *_COLS)
    return rounded(scl.standardise_by_group(rows, _COLS, ["l_returnflag"]).drop("l_returnflag"), *_COLS)


@query("robust_scaling", "SELECT " + _K + ", " + ", ".join(
    f"round((l.{c}-m_{c})/coalesce(nullif(s_{c},0),1), 6) AS {c}" for c in _COLS) + " FROM lineitem l, (SELECT " + ", ".join(
    f"quantile_cont({c},0.5) AS m_{c}, (quantile_cont({c},0.75)-quantile_cont({c},0.25))/1.3489795003921634 AS s_{c}" for c in _COLS)
    + " FROM lineitem)")
def robust_scaling(t):
    rows = _slim(t)
    return rounded(scl.fit_robust(rows, _COLS).apply(rows), *_COLS)


@query("quantiles_by_counted_bins", " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", round(quantile_cont({c},0.25),6) AS q0, round(quantile_cont({c},0.5),6) AS q1, "
    f"round(quantile_cont({c},0.99),6) AS q2 FROM lineitem GROUP BY l_returnflag" for c in _COLS))
def quantiles_by_counted_bins(t):
    from ..operators.ranks import exact_quantiles
    got = exact_quantiles(t.lineitem.select("l_returnflag", *_COLS), _COLS, (0.25, 0.5, 0.99), ["l_returnflag"], one_task_rows=5000)
    return rounded(got, "q0", "q1", "q2")


_MARKS = "[" + ",".join(repr(i / 999) for i in range(1000)) + "]"


@query("quantile_landmarks", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", unnest(range(1000))::INT AS place, round(unnest(quantile_cont({c},{_MARKS})),6) AS value FROM lineitem" for c in _COLS))
def quantile_landmarks(t):
    """Every landmark of the quantile map."""
    from ..operators.ranks import quantile_arrays
    got = quantile_arrays(t.lineitem.select(*_COLS), _COLS, [i / 999 for i in range(1000)])
    return rounded(got.select("column", F.posexplode("q").alias("place", "value")), "value")


@query("clip_to_train_range", "SELECT " + _K + ", " + ", ".join(
    f"greatest(least({c}, h_{c}), l_{c}) AS {c}" for c in _COLS) + " FROM lineitem, (SELECT " + ", ".join(
    f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in _COLS) + " FROM lineitem WHERE l_returnflag = 'A' AND l_quantity BETWEEN 10 AND 40)")
def clip_to_train_range(t):
    fitted = scl.fit_clip(t.lineitem.filter("l_returnflag = 'A' and l_quantity between 10 and 40"), _COLS)
    return fitted.apply(_slim(t))


@query("power_scaling")
def power_scaling(t):
    rows = _slim(t)
    return rounded(scl.fit_outlier_scaling(rows, _COLS, "power").apply(rows), *_COLS)


@query("quantile_normal_scaling")
def quantile_normal_scaling(t):
    rows = _slim(t)
    return rounded(scl.fit_outlier_scaling(rows, _COLS, "quantile").apply(rows), *_COLS)


@query("smoothed_quantile_scaling")
def smoothed_quantile_scaling(t):
    rows = t.wide("orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    return rounded(scl.fit_outlier_scaling(rows, ["o_totalprice", "o_custkey"], "quantile_rtdl", "o_orderkey").apply(rows),
                   "o_totalprice", "o_custkey")


# ---- splits ------------------------------------------------------------------------------------------------------


@query("split_by_column", """SELECT o_orderkey, CASE WHEN s = 'test' THEN 'test' ELSE 'train' END AS role FROM
  (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'test' WHEN 'O' THEN 'train' END AS s FROM orders)""")
def split_by_column(t):
    rows = t.orders.withColumn("set", F.when(F.col("o_orderstatus") == "F", "test").when(F.col("o_orderstatus") == "O", "train"))
    return rows.select("o_orderkey", spl.role_by_column().alias("role"))


@query("split_at_random", f"SELECT o_orderkey, {role_sql(42, 'o_orderkey')} AS role FROM orders")
def split_at_random(t):
    return t.orders.select("o_orderkey", spl.role_by_hash("o_orderkey").alias("role"))


_REPEATS = "CASE WHEN num_samples < 2500 THEN 10 WHEN num_samples > 250000 THEN 1 ELSE 3 END"


@query("split_by_index_list", f"""SELECT o_custkey AS dataset, o_orderkey AS row_id, r::INT AS repeat, f::INT AS fold,
  CASE WHEN floor({u_sql("(r||'|'||f||'|'||o_orderkey)")}*3) < 1 THEN 'test' ELSE 'train' END AS role, o_totalprice
  FROM orders, range(0,2) a(r), range(0,3) b(f)""")
def split_by_index_list(t):
    from ..functions.hashing import bucket
    features = t.orders.select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("row_id"), "o_totalprice")
    lists = features.select("dataset", "row_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("repeat")).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(2))))
    lists = lists.withColumn("role", F.when(bucket(3, F.col("repeat"), F.col("fold"), F.col("row_id")) < 1, "test").otherwise("train"))
    return spl.join_splits(features, lists).select("dataset", "row_id", "repeat", "fold", "role", "o_totalprice")


@query("repeats_and_folds", f"""SELECT dataset, r::INT AS repeat, f::INT AS fold FROM (SELECT o_orderpriority AS dataset,
  count(*) AS num_samples FROM orders GROUP BY o_orderpriority) t, range(0,10) a(r), range(0,3) b(f)
  WHERE r < {_REPEATS}""")
def repeats_and_folds(t):
    tasks = t.orders.groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count("*").alias("num_samples")).withColumn("folds", F.lit(3))
    return spl.expand_folds(tasks).select("dataset", "repeat", "fold")


@query("stratified_cv_folds", f"""SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY
  {u_sql("('42|'||o_orderkey)")}, o_orderkey) - 1) % 5)::INT AS fold FROM orders""")
def stratified_cv_folds(t):
    return spl.stratified_folds(t.orders, "o_orderkey", 5, "o_orderpriority").select("o_orderkey", "fold")


@query("stratified_cv_folds_sliced", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, fold FROM (SELECT *, ((row_number() OVER
  (PARTITION BY l_returnflag ORDER BY {u_sql("('42|'||k)")}, k) - 1) % 4)::INT AS fold FROM
  (SELECT *, l_orderkey||'-'||l_partkey||'-'||l_suppkey||'-'||l_linenumber AS k FROM lineitem))""")
def stratified_cv_folds_sliced(t):
    rows = t.lineitem.select(*_KEYS, "l_returnflag", F.concat_ws("-", *_KEYS).alias("k"))
    return spl.stratified_folds(rows, "k", 4, "l_returnflag", one_task_rows=5000).select(*_KEYS, "fold")


_COLLECTIONS = f"""WITH task AS (SELECT dataset AS task_id, row_number() OVER (ORDER BY dataset) - 1 AS slot FROM ({_ORDER_PROFILE})
    WHERE NOT (num_samples > 14 OR num_features > 6 OR missing_values > 0)),
  n AS (SELECT count(*) AS total FROM task),
  p AS (SELECT total, (SELECT min(c) FROM range(1000000) x(c) WHERE c >= greatest(2,total) AND c < total + 300 AND NOT EXISTS
    (SELECT 1 FROM range(2, 1100) y(d) WHERE d*d <= c AND c % d = 0)) AS prime FROM n),
  draw AS (SELECT number, least(2 + floor({u_sql("('42|size|'||number)")}*8), total) AS size,
    1 + floor({u_sql("('42|a|'||number)")}*(prime-1)) AS a, floor({u_sql("('42|b|'||number)")}*prime) AS b, total, prime
    FROM p, range(0,20) r(number)),
  walk AS (SELECT number, x, size, (a::BIGINT*x + b::BIGINT) % prime AS slot, total FROM draw, range(0, 400) s(x)
    WHERE x <= least(size - 1 + prime - total, prime - 1)),
  pick AS (SELECT 'collection_'||number AS collection, row_number() OVER (PARTITION BY number ORDER BY x) AS position, slot, size
    FROM walk WHERE slot < total)
  SELECT collection, position::INT AS position, task_id FROM pick JOIN task USING (slot) WHERE position <= size"""


def drawn_collections(t):
    tasks = order_profile(t).filter("not (num_samples > 14 or num_features > 6 or missing_values > 0)")
    return spl.random_collections(tasks.withColumnRenamed("dataset", "task_id"))


@query("random_collections", _COLLECTIONS)
def random_collections(t):
    return drawn_collections(t)


@query("collection_table", f"""SELECT collection, string_agg(task_id::VARCHAR, '_' ORDER BY position) AS selected_task_ids_str,
  count(*) AS n FROM ({_COLLECTIONS}) GROUP BY collection""")
def collection_table(t):
    return spl.collection_table(drawn_collections(t)).select(
        "collection", "selected_task_ids_str", F.size("selected_task_ids").cast("bigint").alias("n"))


@query("seeded_shuffle", f"""SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY {u_sql("('42|shuffle|'||o_orderkey)")}, o_orderkey) - 1
  AS place FROM orders""")
def seeded_shuffle(t):
    from ..operators.ranks import number_rows
    rows = t.orders.select("o_orderkey", "o_orderpriority", spl.shuffle_key("o_orderkey").alias("u"))
    return number_rows(rows, ["u", "o_orderkey"], "place", one_task_rows=0).select("o_orderkey", "o_orderpriority", "place")
