"""Labelled-matrix archives (``.npz`` with ``X`` and ``y``) as a Spark data source.

An archive's directory tells where its stored members lie. Rows of a fixed width then have fixed places, so partitions are row ranges
that read their own bytes: an archive of any size is read by many tasks and never held whole. Compressed members and such
in column order have no such places; their archive is one partition.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES, BATCH_ROWS = 16 << 20, 4096
MOST_PARTITIONS = 512  # smaller row ranges than this asks for would cost a task each and nothing else
SCHEMA = "dataset string, row_id bigint, features array<double>, y int"


@dataclass(frozen=True)
class Member:
    """An array in an archive; ``offset`` is where its first value lies, or None if it must be unpacked."""

    name: str
    dtype: str
    shape: tuple[int, ...]
    offset: int | None


def _header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    shape, by_column, dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](stream)
    if dtype.hasobject:
        raise ValueError("archives with pickled content are refused (allow_pickle is off)")
    return shape, by_column, dtype


def members(file) -> dict[str, Member]:
    """The arrays ``X`` and ``y`` of an open archive."""
    out = {}
    with zipfile.ZipFile(file) as archive:
        for name in ("X", "y"):
            info = archive.getinfo(f"{name}.npy")
            with archive.open(info) as stream:
                shape, by_column, dtype = _header(stream)
                values = stream.tell()
            offset = None
            if info.compress_type == zipfile.ZIP_STORED and not (by_column and len(shape) > 1):
                file.seek(info.header_offset + 26)
                names, extra = struct.unpack("<HH", file.read(4))
                offset = info.header_offset + 30 + names + extra + values
            out[name] = Member(name, dtype.str, tuple(shape), offset)
    return out


@dataclass
class RowRange(InputPartition):
    path: str
    dataset: str
    first: int
    rows: int
    x: Member
    y: Member

    def __init__(self, path: str, dataset: str, first: int, rows: int, x: Member, y: Member):
        super().__init__((path, first))
        self.path, self.dataset, self.first, self.rows, self.x, self.y = path, dataset, first, rows, x, y


def _values(file, member: Member, first: int, rows: int) -> np.ndarray:
    """Rows of a stored member, from their own bytes."""
    dtype, width = np.dtype(member.dtype), int(np.prod(member.shape[1:], dtype=np.int64))
    file.seek(member.offset + first * width * dtype.itemsize)
    return np.frombuffer(file.read(rows * width * dtype.itemsize), dtype).reshape(rows, *member.shape[1:])


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, exclude: frozenset[str], partition_bytes: int):
        self.path, self.exclude, self.partition_bytes = path, exclude, partition_bytes

    def partitions(self) -> list[RowRange]:
        """Row ranges of about ``partition_bytes``, or more where that made over ``MOST_PARTITIONS`` of them; only the archives'
        directories are read here."""
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        held = []
        for info in sorted(found, key=lambda i: i.path):
            name = info.base_name.removesuffix(".npz")
            if info.base_name == name or name in self.exclude:
                continue
            with store.open_input_file(info.path) as file:
                got = members(file)
            x, y = got["X"], got["y"]
            if len(x.shape) != 2 or x.shape[0] != int(np.prod(y.shape)):
                raise ValueError(f"archive {name}: X must be a matrix with one row per label")
            held.append((info.path, name, x, y))
        width = lambda x: max(1, x.shape[1] * np.dtype(x.dtype).itemsize)
        most = max(self.partition_bytes, sum(x.shape[0] * width(x) for _, _, x, _ in held) // MOST_PARTITIONS)
        out: list[RowRange] = []
        for path, name, x, y in held:
            step = max(1, most // width(x))
            if x.offset is None or y.offset is None:
                step = max(1, x.shape[0])
            y = Member("y", y.dtype, (x.shape[0],), y.offset)
            out += [RowRange(path, name, at, min(step, x.shape[0] - at), x, y) for at in range(0, x.shape[0], step)]
        return out or [RowRange("", "", 0, 0, Member("X", "<f8", (0, 0), 0), Member("y", "<f8", (0,), 0))]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        with store.open_input_file(part.path) as file:
            whole = None
            if part.x.offset is None or part.y.offset is None:
                with np.load(file, allow_pickle=False) as archive:
                    whole = archive["X"], archive["y"].ravel()
            for at in range(part.first, part.first + part.rows, BATCH_ROWS):
                many = min(BATCH_ROWS, part.first + part.rows - at)
                x, y = (v[at: at + many] for v in whole) if whole else (_values(file, m, at, many) for m in (part.x, part.y))
                flat = pa.array(np.ascontiguousarray(x, np.float64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(many + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array([part.dataset] * many), pa.array(np.arange(at, at + many)), lists,
                                                  pa.array(np.asarray(y).astype(np.int32))], names=["dataset", "row_id", "features", "y"])


class MatrixArchives(DataSource):
    """``spark.read.format("matrix_archives").load(folder)``; options ``exclude`` (names, by comma) and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "matrix_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        exclude = frozenset(x for x in self.options.get("exclude", "").split(",") if x)
        return ArchiveReader(self.options["path"], exclude, int(self.options.get("partition_bytes", PARTITION_BYTES)))


def scan_matrix_archives(spark: SparkSession, path: str, exclude: tuple[str, ...] = (), partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``(dataset, row_id, features, y)`` of the archives in a folder that ``pyarrow`` can open (local, S3, GCS, HDFS), by row ranges.

    For folders that only Spark's own readers reach, :func:`~.tables.read_matrix_archives` takes whole files.
    """
    spark.dataSource.register(MatrixArchives)
    return spark.read.format("matrix_archives").option("exclude", ",".join(exclude)).option("partition_bytes", partition_bytes).load(path)
