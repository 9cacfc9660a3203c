"""Writers: result tables, incremental appends, collections and reports. Any Hadoop path works as a target."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f.name)
                       for f in df.schema.fields])


def save_table(df: DataFrame, folder: str, name: str, timestamp: str) -> tuple[str, str]:
    """Write ``{name}_{timestamp}`` as Parquet and as CSV; returns both paths."""
    base = f"{folder.rstrip('/')}/{name}_{timestamp}"
    parquet, csv = f"{base}.parquet", f"{base}.csv"
    df.write.mode("overwrite").parquet(parquet)
    written = df.sparkSession.read.schema(df.schema).parquet(parquet)
    flat_for_csv(written).write.mode("overwrite").option("header", True).csv(csv)
    return parquet, csv


def append_results(df: DataFrame, folder: str, benchmark: str, run_ts: str, step: str | None = None) -> None:
    """Add the result lines of one step of a run.

    Lines that name their ``step`` replace what the same step of the same run wrote before, so a job that is repeated, or retried after
    it stopped half-way, leaves every line once; other steps and runs are not read or rewritten. Without a name lines are
    only ever added.
    """
    tagged = df.withColumn("benchmark", F.lit(benchmark)).withColumn("run_ts", F.lit(run_ts))
    if step is None:
        tagged.write.mode("append").partitionBy("benchmark", "run_ts").parquet(folder)
        return
    tagged.withColumn("step", F.lit(step)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "benchmark", "run_ts", "step").parquet(folder)


def step_name(*parts) -> str:
    """A name for a step, of its parts; equal parts name the same step."""
    return "step-" + hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def save_matrix_archives(df: DataFrame, folder: str) -> None:
    """``(dataset, row_id, features, y)`` as ``{dataset}.npz`` files with ``X`` and ``y`` in order of ``row_id``, values uncompressed.

    An archive is made in one task, so it has to fit one; what is meant are the moderate tables of a benchmark.
    """
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, buffer = pdf.sort_values("row_id"), io.BytesIO()
        np.savez(buffer, X=np.stack(pdf["features"].to_numpy()).astype(np.float64), y=pdf["y"].to_numpy())
        return pd.DataFrame({"dataset": [str(pdf["dataset"].iloc[0])], "value": [buffer.getvalue()]})

    packed = df.groupBy("dataset").applyInPandas(pack, "dataset string, value binary")
    raw = f"{folder}/raw"
    packed.select("dataset", F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("dataset").text(raw)
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = at(folder).getFileSystem(conf)
    for found in store.globStatus(at(f"{raw}/dataset=*/part-*")):
        store.rename(found.getPath(), at(f"{folder}/{found.getPath().getParent().getName().removeprefix('dataset=')}.npz"))
    store.delete(at(raw), True)


def save_collections(collections: DataFrame, path: str) -> None:
    """``(collection, selected_task_ids_str, selected_task_ids)`` as one JSON object; a small configuration table."""
    entry = F.struct("collection", F.struct("selected_task_ids_str", "selected_task_ids"))
    whole = collections.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def save_report(df: DataFrame, path: str) -> None:
    """A report (one line per model and algorithm) as a single headed CSV file."""
    flat_for_csv(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
