"""Many boosted regressors at once: all trials and folds of a search grow their trees from the same binned blocks of rows.

Features are cut once at quantiles of all rows. A tree grows level by level from sums of residuals by node, feature and bin. With up to
some million rows a task grows all trees of a model; with more, a pass over the blocks gives the sums of all models for a level, and
when a tree is done the blocks are written anew with every model's predictions, so no pass walks old trees again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import uniform
from ..functions.vectors import as_double, stack_vectors
from ..staging import discard, scratch_path, stage
from .many_models import _summed
from .ranks import quantile_arrays

BINS = 32
BLOCK_BYTES = 16 << 20  # bins of a block, and of all rows that a task takes whole
BLOCK_ROWS = 32_768  # rows of a block: predictions of all models that share passes stay beside its bins
TOLD_BYTES = 16 << 20  # predictions of a block
TASK_ROWS = 8 << 20  # rows that a task takes whole, at some 40 bytes each
FILE_BLOCKS = 4  # blocks of a file, which is read whole
SUM_BYTES = 48 << 20  # sums of the models that share passes


@dataclass(frozen=True)
class BoostTask:
    """One model; rows of ``fold`` are held out (-1: none)."""

    fold: int
    depth: int
    rounds: int
    step: float


@dataclass
class Tree:
    """Nodes in level order, the children of ``i`` at ``2 i + 1`` and ``2 i + 2``; ``feature`` is -1 at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def place(self, bins: np.ndarray, levels: int, at: np.ndarray | None = None) -> np.ndarray:
        """Node of each row after at most ``levels`` steps from the root, or from ``at``."""
        at, flat = np.zeros(len(bins), np.int64) if at is None else at, bins.ravel()
        row = np.arange(len(bins)) * bins.shape[1]
        for _ in range(levels):
            feature = self.feature.take(at)
            if not len(at) or feature.max() < 0:
                break
            goes = flat.take(row + feature, mode="clip") <= self.cut.take(at)
            at = np.where(feature < 0, at, 2 * at + 2 - goes)
        return at


def level_sums(bins: np.ndarray, node: np.ndarray, residual: np.ndarray, level: int) -> np.ndarray:
    """(node of the level, feature, bin, residual and rows) sums; rows that stopped above the level do not count."""
    first, many, width = 2 ** level - 1, 2 ** level, bins.shape[1]
    here = node >= first
    if not here.all():
        bins, node, residual = bins[here], node[here], residual[here]
    start, out = (node - first) * BINS, np.empty((many, width, BINS, 2))
    for f in range(width):  # feature by feature, so that no array has more values than rows
        place = start + bins[:, f]
        out[:, f, :, 0] = np.bincount(place, residual, many * BINS).reshape(many, BINS)
        out[:, f, :, 1] = np.bincount(place, minlength=many * BINS).reshape(many, BINS)
    return out


def split_level(tree: Tree, sums: np.ndarray, level: int, depth: int) -> bool:
    """Give the nodes of a level their means and, above the last level, their best cuts; equal gains go to the first feature and bin."""
    first, open_ = 2 ** level - 1, False
    for k in range(2 ** level):
        total, rows = sums[k, 0].sum(axis=0)
        if not rows:
            continue
        tree.value[first + k] = total / rows
        if level == depth:
            continue
        left = sums[k].cumsum(axis=1)[:, :-1]
        right = np.array([total, rows]) - left
        some = (left[..., 1] > 0) & (right[..., 1] > 0)
        gain = np.where(some, left[..., 0] ** 2 / np.maximum(left[..., 1], 1) + right[..., 0] ** 2 / np.maximum(right[..., 1], 1), -np.inf)
        best = int(gain.argmax())
        if gain.flat[best] > total * total / rows + 1e-12 * max(1.0, abs(total * total / rows)):
            tree.feature[first + k], tree.cut[first + k] = divmod(best, BINS - 1)
            open_ = True
    return open_


def grow(parts: list[np.ndarray], residuals: list[np.ndarray], depth: int) -> tuple[Tree, list[np.ndarray]]:
    """A tree from the bins and residuals of rows held here in parts, and the node of each row."""
    tree, nodes = Tree.empty(depth), [np.zeros(len(p), np.int64) for p in parts]
    for level in range(depth + 1):
        if level:
            nodes = [tree.place(p, 1, at) for p, at in zip(parts, nodes)]
        if not split_level(tree, sum(level_sums(p, at, r, level) for p, at, r in zip(parts, nodes, residuals)), level, depth):
            break
    return tree, nodes


@dataclass(frozen=True)
class Boosted:
    """A fitted model: what it starts from and its trees, whose values carry the step."""

    start: float
    trees: tuple[Tree, ...]
    edges: tuple[np.ndarray, ...]

    def __call__(self, m: np.ndarray) -> np.ndarray:
        bins = binned(m, self.edges)
        return self.start + sum((t.value[t.place(bins, len(t.value).bit_length() - 1)] for t in self.trees), np.zeros(len(m)))


def binned(m: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many edges lie below it."""
    return np.column_stack([np.searchsorted(e, m[:, f], "left") for f, e in enumerate(edges)]).astype(np.uint8) if len(m) else np.zeros(
        (0, len(edges)), np.uint8)


def _staged(blocks: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like :func:`stage`, and the path; a bounded number of blocks to a file: a reader holds some thousand rows of a file at once."""
    path = scratch_path(blocks.sparkSession, name)
    blocks.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path), path


@dataclass
class BoostedMany:
    """Rows packed for boosting: staged ``(block, bins, y, fold)``, and the cuts between bins."""

    blocks: DataFrame
    count: int
    edges: tuple[np.ndarray, ...]
    rows: int = 0  # of a block, about
    whole: bool = True  # a task takes a model through all its trees

    @classmethod
    def pack(cls, rows: DataFrame, row_id: str, vec: str, label: str, seed: int = 42, block_bytes: int = BLOCK_BYTES,
             block_rows: int = BLOCK_ROWS, task_rows: int = TASK_ROWS) -> BoostedMany:
        """From rows ``(row_id, vec, label, fold)``; a feature has at most ``BINS - 1`` cuts, at its quantiles."""
        slim = stage(rows.select(F.col(row_id).alias("_id"), as_double(vec).alias("_v"), F.col(label).cast("double").alias("_y"), "fold",
                                 uniform(seed, "order", F.col(row_id)).alias("_u")), "boost-rows")
        known = slim.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("d")).first()
        names = [f"_{i}" for i in range(known["d"])]
        cuts = quantile_arrays(slim.select(*[F.col("_v")[i].alias(c) for i, c in enumerate(names)]), names, [k / BINS for k in range(1, BINS)])
        found = {r["column"]: r["q"] for r in cuts.collect()}
        edges = tuple(np.unique(found.get(c, [])) for c in names)
        count = max(1, -(-known["n"] * known["d"] // block_bytes), -(-known["n"] // block_rows))

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_u", "_id"])
            return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bins": [binned(stack_vectors(pdf["_v"]), edges).tobytes()],
                                 "y": [pdf["_y"].to_numpy(float).tobytes()], "fold": [pdf["fold"].to_numpy(np.int32).tobytes()]})

        packed = slim.withColumn("block", F.floor(F.col("_u") * count).cast("int")).groupBy("block").applyInPandas(
            pack, "block int, bins binary, y binary, fold binary")
        return cls(_staged(packed, "boost-blocks")[0], count, edges, -(-known["n"] // count),
                   known["n"] * known["d"] <= block_bytes and known["n"] <= task_rows)

    def _arrays(self, pdf: pd.DataFrame):
        for row in pdf.itertuples(index=False):
            yield np.frombuffer(row.bins, np.uint8).reshape(-1, len(self.edges)), np.frombuffer(row.y), np.frombuffer(row.fold, np.int32), row

    def __getstate__(self):  # tasks need the cuts, not the frame
        return {**self.__dict__, "blocks": None}

    def fit(self, tasks: list[BoostTask], keep: bool = False) -> tuple[list[Boosted], np.ndarray]:
        """The models (if ``keep``), and the squared errors and rows of what each held out."""
        if self.whole:
            return self._fit_in_tasks(tasks, keep)
        models, sums = [], []
        while tasks:
            size, many = 0, 0
            while many < len(tasks) and (not many or (size + self._bytes(tasks[many]) <= SUM_BYTES and 8 * many * self.rows < TOLD_BYTES)):
                size, many = size + self._bytes(tasks[many]), many + 1
            got, held = self._fit_in_passes(tasks[:many])
            models, tasks = models + (got if keep else []), tasks[many:]
            sums.append(held)
        return models, np.concatenate(sums)

    def _bytes(self, task: BoostTask) -> int:
        return 2 ** task.depth * len(self.edges) * BINS * 16

    def _fit_in_tasks(self, tasks: list[BoostTask], keep: bool):
        units = self.blocks.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1))))
        units = units.repartitionByRange(len(tasks), "model").sortWithinPartitions("model", "block")
        me = self

        def learn(model, held):
            task, sides = tasks[model], []
            for inside in (lambda fold: fold != task.fold, lambda fold: fold == task.fold):
                sides.append([(bins[inside(fold)], y[inside(fold)]) for bins, y, fold in held])
            (train, own), (rest, away) = (list(zip(*side)) for side in sides)
            some = sum(map(len, own))
            start, trees = float(np.concatenate(own).mean()) if some else 0.0, []
            told, guess = ([np.full(len(y), start) for y in part] for part in (own, away))
            for _ in range(task.rounds if some else 0):
                tree, nodes = grow(train, [y - t for y, t in zip(own, told)], task.depth)
                tree.value *= task.step
                for t, at in zip(told, nodes):
                    t += tree.value[at]
                for t, bins in zip(guess, rest):
                    t += tree.value[tree.place(bins, task.depth)]
                trees.append(tree)
            error = sum(((t - y) ** 2).sum() for t, y in zip(guess, away))
            kept = [np.concatenate([t.feature, t.cut, t.value]).tobytes() for t in trees] if keep else []
            return pd.DataFrame({"model": [model], "start": [start], "error": [error], "rows": [float(sum(map(len, away)))], "trees": [kept]})

        def work(batches):
            model, held = None, []
            for pdf in batches:
                for bins, y, fold, row in me._arrays(pdf):
                    if held and row.model != model:
                        yield learn(model, held)
                        held = []
                    model = row.model
                    held.append((bins, y, fold))
            if held:
                yield learn(model, held)

        found = sorted(units.mapInPandas(work, "model int, start double, error double, rows double, trees array<binary>").collect())
        models = []
        for r in found if keep else []:
            parts = [np.split(np.frombuffer(t), 3) for t in r["trees"]]
            models.append(Boosted(r["start"], tuple(Tree(f.astype(np.int64), c.astype(np.int64), v) for f, c, v in parts), self.edges))
        return models, np.array([[r["error"], r["rows"]] for r in found])

    def _fit_in_passes(self, tasks: list[BoostTask]):
        me, many = self, len(tasks)
        folds = np.array([t.fold for t in tasks])

        def starts(pdf):
            return sum(np.concatenate([((fold[:, None] != folds) * y[:, None]).sum(0), (fold[:, None] != folds).sum(0).astype(float)])
                       for _, y, fold, _ in me._arrays(pdf))

        total, rows = _summed(self.blocks, starts).reshape(2, many)
        start = total / np.maximum(rows, 1)
        grown: list[list[Tree]] = [[] for _ in tasks]
        blocks, old = self.blocks.withColumn("told", F.lit(None).cast("binary")), None

        def told_of(row, n):
            return np.repeat(start[:, None], n, 1) if row.told is None else np.frombuffer(row.told).reshape(many, n)

        for number in range(max(t.rounds for t in tasks)):
            trees = {k: Tree.empty(t.depth) for k, t in enumerate(tasks) if number < t.rounds}
            live = list(trees)
            for level in range(max(tasks[k].depth for k in live) + 1):
                shape = (2 ** level, len(self.edges), BINS, 2)
                size = int(np.prod(shape))

                def read(pdf, live=live, trees=trees, level=level, size=size):
                    out = np.zeros((len(live), size))
                    for bins, y, fold, row in me._arrays(pdf):
                        told, parts = told_of(row, len(y)), {}
                        for at, k in enumerate(live):
                            if tasks[k].fold not in parts:
                                inside = np.flatnonzero(fold != tasks[k].fold)
                                parts[tasks[k].fold] = inside, bins[inside], y[inside]
                            inside, part, own = parts[tasks[k].fold]
                            out[at] += level_sums(part, trees[k].place(part, level), own - told[k].take(inside), level).ravel()
                    return out.ravel()

                sums = _summed(blocks, read).reshape(len(live), *shape)
                live = [k for at, k in enumerate(live) if split_level(trees[k], sums[at], level, tasks[k].depth)]
                if not live:
                    break
            for k, tree in trees.items():
                tree.value *= tasks[k].step
                grown[k].append(tree)

            def tell(batches, trees=trees):
                for pdf in batches:
                    new = []
                    for bins, y, _, row in me._arrays(pdf):
                        told = told_of(row, len(y)).copy()
                        for k, tree in trees.items():
                            told[k] += tree.value[tree.place(bins, tasks[k].depth)]
                        new.append(told.tobytes())
                    yield pdf.assign(told=new)

            blocks, new = _staged(blocks.mapInPandas(tell, blocks.schema), "boost-told")
            if old:
                discard(blocks.sparkSession, old)
            old = new

        def held(pdf):
            out = np.zeros((many, 2))
            for _, y, fold, row in me._arrays(pdf):
                own = fold[None] == folds[:, None]
                out += np.column_stack([(((told_of(row, len(y)) - y) ** 2) * own).sum(1), own.sum(1)])
            return out.ravel()

        sums = _summed(blocks, held).reshape(many, 2)
        if old:
            discard(blocks.sparkSession, old)
        return [Boosted(float(start[k]), tuple(grown[k]), self.edges) for k in range(many)], sums
