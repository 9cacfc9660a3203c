"""Intermediate tables that cut lineage and outlive lost executors.

A staged table is ordinary Parquet in the shared folder that ``spark.checkpoint.dir`` names. Everything read from it
twice is the same rows twice, which the range-partitioned and iterative operators rely on.
"""

from __future__ import annotations

import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_written: list = []  # paths, and the lists of the jobs that began inside
_job: contextvars.ContextVar[list] = contextvars.ContextVar("job", default=_written)


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables; a private temporary folder is used only in local mode when none is set."""
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="gaugeframe-")
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the staged tables."""
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    _job.get().append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return a frame that reads the written rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> list:
    """Begin a job: what this thread (or one that runs in a copy of its context) stages from now on is the job's, until another
    begins. For :func:`settle`."""
    own: list = []
    _job.get().append(own)
    _job.set(own)
    return own


def settle(spark: SparkSession, job: list, *frames: DataFrame | None) -> list[DataFrame | None]:
    """Stage what a job returns and delete everything else staged in it. Jobs of other threads are not touched."""
    old = list(job)
    _job.set(job)
    out = [None if df is None else stage(df, "outcome") for df in frames]
    _delete(spark, _paths(old))
    del job[: len(old)]
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete one staged table that nothing reads any more, as a loop does with those of its earlier rounds."""
    _delete(spark, [path])
    if path in _job.get():
        _job.get().remove(path)


def _paths(entries: list) -> list[str]:
    return [p for e in entries for p in (_paths(e) if isinstance(e, list) else [e])]


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    targets = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(bool(t.getFileSystem(conf).delete(t, True)) for t in targets)


def release_staged(spark: SparkSession) -> int:
    """Delete the tables this process staged; call it when no frame built on them is needed any more."""
    done = _delete(spark, _paths(_written))
    _written.clear()
    _job.set(_written)
    return done
