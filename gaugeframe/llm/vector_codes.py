"""Product codes of vectors, with candidates remembered per cell of a coarse grid.

A vector of grid integers is cut into parts; each part position has its own codebook, learned by rounds of assignment and
integer means. Only few entries can be nearest to any point of a small box: an entry whose least distance to the box is
greater than some other entry's greatest distance to it loses everywhere in the box. So a worker hashes the coarse cell of
each part, works out once per cell which entries are left, and compares a part with those alone, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..staging import stage
from .common import broadcast_if_small
from .grids import common_width, matrix, on_grid, summed

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LIMIT = 1 << 26  # grid integers beyond this count as this; a part's squared distance then fits a long
SIDE_BITS = 4  # cells are 16 grid units wide
CELLS = 200_000  # cells a worker remembers for a part; others are worked out each time they are met


class CellMemory:
    """Nearest entries of one codebook, ties to the lower index, through remembered cells."""

    def __init__(self, entries: np.ndarray, side_bits: int = SIDE_BITS, room: int = CELLS):
        self.entries, self.side_bits, self.room = entries, side_bits, room
        self.known: dict[bytes, np.ndarray] = {}
        self.compared = 0  # exact distances so far

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """Per cell the entries that no other entry beats at every point of the cell's box."""
        out = []
        step = max(1, (1 << 20) // max(1, self.entries.size))
        for at in range(0, len(cells), step):
            low = (cells[at: at + step] << self.side_bits)[:, None, :]
            high = low + ((1 << self.side_bits) - 1)
            gap = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
            reach = np.maximum(np.abs(self.entries - low), np.abs(high - self.entries))
            least, greatest = (gap * gap).sum(2), (reach * reach).sum(2)
            keep = least <= greatest.min(axis=1, keepdims=True)
            out += [np.flatnonzero(row) for row in keep]
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance to it, per row of ``x``."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells = np.ascontiguousarray(x >> self.side_bits)
        names = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        _, first, which = np.unique(names, return_index=True, return_inverse=True)
        hashed = [name.tobytes() for name in names[first]]
        found = [self.known.get(name) for name in hashed]
        new = [k for k, f in enumerate(found) if f is None]
        if new:
            for k, left in zip(new, self.undominated(cells[first[new]])):
                found[k] = left
                if len(self.known) < self.room:
                    self.known[hashed[k]] = left
        sizes = np.array([len(f) for f in found])
        starts = np.cumsum(sizes) - sizes
        every = np.concatenate(found)
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, (1 << 22) // max(1, self.entries.shape[1] * int(sizes.max())))
        for at in range(0, len(x), step):
            cell = which[at: at + step]
            many = sizes[cell]
            begin = np.cumsum(many) - many
            row = np.repeat(np.arange(len(cell)), many)
            entry = every[np.arange(len(row)) - begin[row] + starts[cell][row]]
            apart = x[at + row] - self.entries[entry]
            distance = (apart * apart).sum(1)
            self.compared += len(distance)
            least = np.minimum.reduceat(distance, begin)
            best = np.flatnonzero(distance == least[row])
            best = best[np.concatenate([[True], row[best][1:] != row[best][:-1]])]  # the first of each row
            code[at: at + step], error[at: at + step] = entry[best], least
        return code, error


def part_bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts of equal length; if ``parts`` does not divide ``width``, the first ones are one longer."""
    edges = np.concatenate([[0], np.cumsum([width // parts + (p < width % parts) for p in range(parts)])])
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


@dataclass(frozen=True)
class Codebooks:
    """One table of entries per part position."""

    tables: tuple[np.ndarray, ...]

    @property
    def bounds(self) -> list[tuple[int, int]]:
        return part_bounds(sum(t.shape[1] for t in self.tables), len(self.tables))

    def sha256(self) -> str:
        """Digest of all components as decimal text, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for t in self.tables for v in t.ravel().tolist()).encode()).hexdigest()


_memories: dict[str, list[CellMemory]] = {}


def _memory(books: Codebooks, name: str) -> list[CellMemory]:
    """The worker's cells for these codebooks, kept between batches and tasks."""
    if name not in _memories:
        _memories.clear()
        _memories[name] = [CellMemory(t) for t in books.tables]
    return _memories[name]


def assign(x: np.ndarray, books: Codebooks, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and the squared distances summed over the parts."""
    codes, error = np.zeros((len(x), len(books.tables)), np.int64), np.zeros(len(x), np.int64)
    for part, (memory, (a, b)) in enumerate(zip(_memory(books, name), books.bounds)):
        codes[:, part], apart = memory.nearest(x[:, a:b])
        error += apart
    return codes, error


def fit_codebooks(rows: DataFrame, key: str, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of staged grid rows ``(key, x)``, all ``width`` long.

    They begin as the parts of the rows with the smallest keys (equal keys by their vectors). Each round assigns every part and
    replaces each entry by the floor of the mean of its parts; an entry without parts stays.
    """
    begin = rows.select(key, "x").orderBy(key, "x").limit(entries).collect()
    seed = np.array([r["x"] for r in begin], np.int64).reshape(len(begin), width)
    bounds = part_bounds(width, parts)
    books = Codebooks(tuple(np.ascontiguousarray(seed[:, a:b]) for a, b in bounds))
    for _ in range(rounds if len(seed) else 0):
        name, k = books.sha256(), len(seed)

        def read(columns, books=books, name=name):
            x = matrix(columns[0])
            codes, _ = assign(x, books, name)
            sums = []
            for part, (a, b) in enumerate(bounds):
                code = codes[:, part]
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                total = np.zeros((k, b - a), np.int64)
                total[used] = np.add.reduceat(x[order, a:b], first, axis=0)
                sums += [np.bincount(code, minlength=k), total.ravel()]
            return np.concatenate(sums)

        total, at, tables = summed(rows.select("x"), read, np.int64), 0, []
        for table in books.tables:
            many, at = total[at: at + k], at + k
            sums, at = total[at: at + table.size].reshape(table.shape), at + table.size
            tables.append(np.where(many[:, None] > 0, sums // np.maximum(many, 1)[:, None], table))
        books = Codebooks(tuple(tables))
    return books


def encode(rows: DataFrame, books: Codebooks, carry: Sequence[str] = ()) -> DataFrame:
    """``(*carry, code array<int>, error long)`` of grid rows."""
    carry, name = list(carry), books.sha256()
    shape = T.StructType([rows.schema[c] for c in carry] + [
        T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in carry]

    def work(batches):
        for batch in batches:
            codes, error = assign(matrix(batch.column(len(carry))), books, name)
            offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(k) for i, k in enumerate(kinds)], lists, pa.array(error)],
                                             names=shape.names)

    return rows.select(*carry, "x").mapInArrow(work, shape)


def compress(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``(key, label, code, error, label_error)`` per vector, and the codebooks.

    Vectors that are null, empty or hold null or non-finite components are left out, as are those of another length than
    most (of equally frequent lengths the greatest counts). Repeated keys and rows are coded each; null keys come first among the
    smallest. ``label_error`` sums ``error`` over equal labels, nulls together. Other columns are ignored; an empty table gives
    an empty result and empty codebooks.
    """
    slim = on_grid(vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vec}`").alias("vec")),
                   "vec", ["key", "label"], SCALE, LIMIT)
    rows = stage(slim, "grid")
    width = common_width(rows)
    rows = rows.filter(F.size("x") == width)
    books = fit_codebooks(rows, "key", width, parts, entries, rounds)
    coded = stage(encode(rows, books, ["key", "label"]), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    found = coded.join(broadcast_if_small(stage(sums, "label-errors"), 64), F.col("label").eqNullSafe(F.col("same")), "left").drop("same")
    return found.withColumnsRenamed({"key": key, "label": label}), books
