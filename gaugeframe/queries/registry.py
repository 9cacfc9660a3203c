"""Query registry, table access and SQL text shared by the oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from ..sources.tables import widen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables by name, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """The table for work that is heavy per row, spread over all cores."""
        return widen(getattr(self, name))


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, sf_dir.rstrip("/")))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def spread(df: DataFrame, vec: str, dim: int, prefix: str = "e") -> DataFrame:
    """A vector as rounded columns ``e0 … e{dim-1}``."""
    rest = [c for c in df.columns if c != vec]
    return df.select(*rest, *[F.round(F.col(vec)[i], 6).alias(f"{prefix}{i}") for i in range(dim)])


# ---- SQL text ----------------------------------------------------------------------------------------------------


def u_sql(key: str) -> str:
    """Keyed uniform; ``key`` is an SQL text expression."""
    return f"((('0x'||substr(md5({key}),1,8))::UBIGINT + 0.5)/4294967296.0)"


def g_sql(key: str) -> str:
    """Keyed standard normal."""
    return f"(sqrt(-2.0*ln({u_sql(f'''('a|'||{key})''')}))*cos(2.0*pi()*{u_sql(f'''('b|'||{key})''')}))"


def auc_sql(source: str, by: str, label: str, score: str, out: str = "auc_score") -> str:
    """Mid-rank AUC per group of a sub-select."""
    return f"""SELECT {by}, round((sum(r) FILTER ({label}=1) - p*(p+1)/2.0)/nullif(p*n,0), 6) AS {out} FROM (
      SELECT {by}, {label}, rank() OVER w + (count(*) OVER t - 1)/2.0 AS r,
             sum({label}) OVER (PARTITION BY {by})::DOUBLE AS p, sum(1-{label}) OVER (PARTITION BY {by})::DOUBLE AS n
      FROM ({source}) WINDOW w AS (PARTITION BY {by} ORDER BY {score}), t AS (PARTITION BY {by}, {score}))
      GROUP BY {by}, p, n"""


EMB = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"


def role_sql(seed: int, key: str, per_mille: int = 200) -> str:
    return f"CASE WHEN floor({u_sql(f'''('{seed}|'||{key})''')}*1000) < {per_mille} THEN 'test' ELSE 'train' END"


def result_lines(t: Tables) -> DataFrame:
    """Benchmark result lines derived from ``lineitem``: one line per order line."""
    part = F.col("l_partkey")
    return t.wide("lineitem").select(
        F.concat(F.lit("model_"), F.col("l_returnflag")).alias("embedding_model"),
        F.concat(F.lit("d"), part.cast("string")).alias("dataset_name"),
        F.concat(F.lit("algo_"), F.col("l_linenumber").cast("string")).alias("algorithm"),
        F.when(F.col("l_suppkey") % 3 == 0, "euclidean").when(F.col("l_suppkey") % 3 == 1, "cosine").alias("algorithm_metric"),
        F.when(F.col("l_orderkey") % 3 == 0, "distance").when(F.col("l_orderkey") % 3 == 1, "uniform").alias("algorithm_weights"),
        F.when(part % 3 == 0, "Supervised Binary Classification").when(part % 3 == 1, "Supervised Multiclass Classification")
        .otherwise("Supervised Regression").alias("task"),
        (0.5 + 4 * F.col("l_discount") + F.col("l_tax")).alias("auc_score"),
        (F.col("l_extendedprice") / 123457).alias("mape_score"),
        ((part % 97) / 10).alias("time_to_compute_embedding"),
        (100 + part % 1000).alias("dataset_size"), (5 + part % 40).alias("num_features"),
        ((part % 50) / 100).alias("outlier_ratio"),
        (F.col("l_suppkey") % 3).alias("fold"), (F.col("l_linenumber") % 2).alias("repeat"))


RESULT_LINES = """SELECT 'model_'||l_returnflag AS embedding_model, 'd'||l_partkey AS dataset_name,
  'algo_'||l_linenumber AS algorithm,
  CASE l_suppkey%3 WHEN 0 THEN 'euclidean' WHEN 1 THEN 'cosine' END AS algorithm_metric,
  CASE l_orderkey%3 WHEN 0 THEN 'distance' WHEN 1 THEN 'uniform' END AS algorithm_weights,
  CASE l_partkey%3 WHEN 0 THEN 'Supervised Binary Classification' WHEN 1 THEN 'Supervised Multiclass Classification'
       ELSE 'Supervised Regression' END AS task,
  0.5::DOUBLE+4*l_discount+l_tax AS auc_score, l_extendedprice/123457 AS mape_score,
  (l_partkey%97)::DOUBLE/10 AS time_to_compute_embedding, 100+l_partkey%1000 AS dataset_size, 5+l_partkey%40 AS num_features,
  (l_partkey%50)::DOUBLE/100 AS outlier_ratio, l_suppkey%3 AS fold, l_linenumber%2 AS repeat FROM lineitem"""
