"""Readers: CSV datasets, labelled-matrix archives, task catalogues and collection files."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..staging import stage

COLLECTION_SCHEMA = "map<string,struct<selected_task_ids_str:string,selected_task_ids:array<bigint>>>"
_ARCHIVE_ROWS = 4096


def widen(scan: DataFrame) -> DataFrame:
    """Spread a scan over all cores, by its first column, when its files hold fewer splits than there are cores; a no-op
    on large tables.

    Meant for plain scans: counting the splits of anything with a shuffle in it would run that shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, scan.columns[0])


def read_csv_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                     key: str | None = None, row_id: str = "row_id") -> DataFrame:
    """A headed CSV file or folder with a ``row_id``: the named key column, or numbers fixed by staging the rows once.

    Without a schema the types are inferred, which reads the file one more time.
    """
    reader = spark.read.option("header", True).option("nullValue", "")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    rows = reader.csv(path)
    if key is not None:
        return rows.withColumn(row_id, F.col(key))
    return stage(rows.withColumn(row_id, F.monotonically_increasing_id()), "csv")


def read_matrix_archives(spark: SparkSession, path: str, exclude: Sequence[str] = ()) -> DataFrame:
    """``(dataset, row_id, features, y)`` from ``.npz`` files holding ``X`` and ``y``; one task per file, rows streamed.

    The dataset is the file name without extension. Pickled content is refused.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("dataset"), "content")
    if exclude:
        files = files.filter(~F.col("dataset").isin(list(exclude)))

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["dataset"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    x, y = np.asarray(archive["X"], dtype=np.float64), np.asarray(archive["y"]).ravel()
                if x.ndim != 2 or len(x) != len(y):
                    raise ValueError(f"archive {name}: X must be a matrix with one row per label")
                for s in range(0, len(x), _ARCHIVE_ROWS):
                    part = x[s:s + _ARCHIVE_ROWS]
                    yield pd.DataFrame({"dataset": name, "row_id": np.arange(s, s + len(part), dtype=np.int64),
                                        "features": list(part), "y": y[s:s + len(part)].astype(np.int32)})

    return files.mapInPandas(parse, "dataset string, row_id bigint, features array<double>, y int")


def read_catalogue(spark: SparkSession, tasks_path: str, splits_path: str) -> tuple[DataFrame, DataFrame]:
    """Task and split tables; both are written partitioned or sorted by ``dataset`` so that joins prune files."""
    tasks = spark.read.parquet(tasks_path)
    splits = spark.read.parquet(splits_path).select("dataset", "repeat", "fold", "row_id", "role")
    return tasks, splits


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """``(collection, selected_task_ids_str, selected_task_ids)`` from a JSON object file.

    A missing file, malformed JSON and a wrong schema raise three different errors.
    """
    try:
        text = spark.read.text(path, wholetext=True)
        text.head(1)
    except AnalysisException as e:
        raise FileNotFoundError(f"no collections at {path}") from e
    valid = text.select(F.count_if(F.try_parse_json("value").isNull()).alias("bad")).first()["bad"]
    if valid:
        raise ValueError(f"{path} is not JSON")
    parsed = text.select(F.from_json("value", COLLECTION_SCHEMA).alias("m"))
    rows = parsed.select(F.explode_outer("m").alias("collection", "c")).select("collection", "c.*")
    lacking = F.col("collection").isNull() | F.col("selected_task_ids_str").isNull() | F.col("selected_task_ids").isNull() \
        | F.exists("selected_task_ids", lambda x: x.isNull())
    bad = rows.filter(lacking).limit(1).collect()
    if bad:
        raise ValueError(f"collection {bad[0]['collection']} of {path} lacks a field or has one of a wrong type")
    return rows
