"""Evaluation metrics as grouped aggregations over a ``predictions`` table; all groups in one job."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

EPS = 2.220446049250313e-16  # fixed value: double machine epsilon
WALK_ROWS = 200_000

REGRESSION = "Supervised Regression"
BINARY = "Supervised Binary Classification"
MULTICLASS = "Supervised Multiclass Classification"
OUTLIER = "Outlier Detection"


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _auc_slices(counts: DataFrame, by: list[str]) -> DataFrame:
    """One row per (group, range slice): positives, negatives and the pairs won inside the slice.

    ``counts`` has one row per (group, score), so a tie never straddles two slices. State is one running count.
    """
    schema = T.StructType([counts.schema[c] for c in by] + [
        T.StructField("slice", T.IntegerType()), T.StructField("pos", T.DoubleType()),
        T.StructField("neg", T.DoubleType()), T.StructField("won", T.DoubleType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            code = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            pos, neg = pdf["pos"].to_numpy(float), pdf["neg"].to_numpy(float)
            below = np.cumsum(neg) - neg
            below -= np.repeat(below[starts], np.diff(np.r_[starts, len(pdf)]))
            out = pdf.iloc[starts][by].reset_index(drop=True)
            out["pos"], out["neg"] = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
            out["won"] = np.add.reduceat(pos * (below + 0.5 * neg), starts)
            rows = out.to_dict("records")
            if held is not None:
                if all(held[c] == rows[0][c] or (pd.isna(held[c]) and pd.isna(rows[0][c])) for c in by):
                    rows[0]["won"] += held["won"] + rows[0]["pos"] * held["neg"]
                    rows[0]["pos"] += held["pos"]
                    rows[0]["neg"] += held["neg"]
                else:
                    rows.insert(0, held)
            held = rows.pop()
            if rows:
                yield pd.DataFrame(rows).assign(slice=part)[schema.names]
        if held is not None:
            yield pd.DataFrame([held]).assign(slice=part)[schema.names]

    ranged = counts.repartitionByRange(*by, "score").sortWithinPartitions(*by, "score")
    return ranged.mapInPandas(walk, schema)


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "y", score: str = "prediction",
            out: str = "auc_score") -> DataFrame:
    """Area under the ROC curve per group, ties averaged; null when a group has one class only."""
    base, keys = _keyed(df, by)
    hit = (F.col(label) == 1).cast("bigint")
    counts = base.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    slices = _auc_slices(counts, keys)
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    res = slices.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("won") + F.col("pos") * F.col("below")), F.sum("pos") * F.sum("neg")).alias(out))
    return res if by else res.drop("_all")


def _exploded(df: DataFrame, keys, label, proba) -> DataFrame:
    # the outer form, because Spark turns the inner one into a second evaluation of the probabilities as a filter
    return df.select(*keys, F.col(label).cast("int").alias("_y"), F.posexplode_outer(proba).alias("_class", "score")).filter(
        F.col("_class").isNotNull())


def roc_auc_ovr(df: DataFrame, by: Sequence[str] = (), label: str = "y", proba: str = "proba",
                average: str = "macro", out: str = "auc_score_ovr") -> DataFrame:
    """One-vs-rest AUC averaged over classes; ``average='weighted'`` weighs a class by its rows."""
    base, keys = _keyed(df, by)
    long = _exploded(base, keys, label, proba).withColumn("hit", (F.col("_y") == F.col("_class")).cast("int"))
    per = roc_auc(long, keys + ["_class"], "hit", "score", "_auc")
    if average == "macro":
        res = per.groupBy(*keys).agg(F.avg("_auc").alias(out))
    elif average == "weighted":
        support = base.groupBy(*keys, F.col(label).cast("int").alias("_class")).agg(F.count("*").alias("_n"))
        res = per.join(support, keys + ["_class"]).groupBy(*keys).agg(
            (F.sum(F.col("_auc") * F.col("_n")) / F.sum("_n")).alias(out))
    else:
        raise ValueError(f"unknown average {average!r}")
    return res if by else res.drop("_all")


def _turns(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether each row differs from the one before it in any column; nulls are equal, NaNs too. The first row does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[0] = True
    for column in columns:
        code = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= code[1:] != code[:-1]
    return out


def _pair_wins(base: DataFrame, keys: list[str], label: str, proba: str) -> DataFrame:
    """``(*keys, _class, _y, n, own, won)``: the rows labelled ``_y``, the rows of ``_class``, and the pairs of the two that the latter
    win by the probability of ``_class``, ties counting half.

    Equal (class, probability, label) collapse to one counted row; the counted rows are ordered by range and walked in slices, and
    one row per (class, label, slice) is combined at the end. One walk serves one-vs-one and one-vs-rest: what a class wins
    against the rest is what it wins against each of the others.
    """
    group = [*keys, "_class"]
    counts = _exploded(base, keys, label, proba).filter(F.col("_y").isNotNull())
    counts = counts.groupBy(*group, F.col("score").cast("double").alias("score"), "_y").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(*group, "score").sortWithinPartitions(*group, "score")
    schema = T.StructType([ranged.schema[c] for c in group] + [
        T.StructField("slice", T.LongType()), T.StructField("_y", T.IntegerType()),
        T.StructField("n", T.DoubleType()), T.StructField("won", T.DoubleType())])

    def wins(table: pa.Table, number: int) -> pa.RecordBatch:
        rows = {c: table.column(c).combine_chunks() for c in table.column_names}
        turn, step = _turns([rows[c] for c in group]), _turns([rows[c] for c in [*group, "score"]])
        first, starts = np.flatnonzero(step), np.flatnonzero(turn)
        at = np.searchsorted(first, starts)
        lengths = np.diff(np.r_[at, len(first)])
        cls, y, n = rows["_class"].to_numpy(), rows["_y"].to_numpy(), rows["n"].to_numpy().astype(float)
        hits = np.add.reduceat(np.where(y == cls, n, 0.0), first)
        found = []
        for other in np.unique(y):
            many = np.add.reduceat(np.where(y == other, n, 0.0), first)
            below = np.cumsum(many) - many
            below -= np.repeat(below[at], lengths)
            total, won = np.add.reduceat(many, at), np.add.reduceat(hits * (below + 0.5 * many), at)
            some = np.flatnonzero(total)
            found.append((starts[some], np.full(len(some), other, dtype=np.int32), total[some], won[some]))
        place, other, total, won = (np.concatenate(c) for c in zip(*found))
        made = [pa.array(np.full(len(place), number)), pa.array(other), pa.array(total), pa.array(won)]
        return pa.RecordBatch.from_arrays([*(rows[c].take(pa.array(place)) for c in group), *made], schema.names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= WALK_ROWS:
                table = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(_turns([table.column(c).combine_chunks() for c in [*group, "score"]]))[-1])
                if cut:  # the last score may go on in the next batch
                    yield wins(table.slice(0, cut), number)
                held = table.slice(cut).to_batches()
                number, size = number + 1, len(table) - cut
        if size:
            yield wins(pa.Table.from_batches(held), number)

    lines = ranged.mapInArrow(walk, schema)
    own = F.when(F.col("_y") == F.col("_class"), F.col("n")).otherwise(0.0)
    above = W.partitionBy(*group).orderBy("slice").rangeBetween(1, W.unboundedFollowing)
    lines = lines.withColumn("above", F.coalesce(F.sum(own).over(above), F.lit(0.0))).withColumn("own", F.sum(own).over(W.partitionBy(*group)))
    return lines.groupBy(*group, "_y").agg(F.sum("n").alias("n"), F.max("own").alias("own"),
                                           F.sum(F.col("won") + F.col("n") * F.col("above")).alias("won"))


def _against_one() -> Column:
    return F.when(F.col("_y") != F.col("_class"), F.try_divide(F.col("won"), F.col("own") * F.col("n")))


def _against_rest() -> Column:
    rest = F.col("_y") != F.col("_class")
    return F.try_divide(F.sum(F.when(rest, F.col("won"))), F.max("own") * F.sum(F.when(rest, F.col("n"))))


def _labelled(df: DataFrame, label: str, proba: str) -> DataFrame:
    """Rows whose label has no probability are an error."""
    y = F.col(label).cast("int")
    wrong = F.col(proba).isNotNull() & ((y < 0) | (y >= F.size(proba)))
    return df.withColumn(label, F.when(wrong, F.raise_error(F.format_string("label %d has no probability", y)).cast("int")).otherwise(y))


def roc_auc_ovo(df: DataFrame, by: Sequence[str] = (), label: str = "y", proba: str = "proba",
                out: str = "auc_score_ovo") -> DataFrame:
    """Mean one-vs-one AUC over ordered class pairs; each row meets k - 1 other classes, never other rows."""
    base, keys = _keyed(df, by)
    pairs = _pair_wins(_labelled(base, label, proba), keys, label, proba).filter(F.col("_y") != F.col("_class"))
    res = pairs.groupBy(*keys).agg(F.avg(_against_one()).alias(out))
    return res if by else res.drop("_all")


def roc_auc_multiclass(df: DataFrame, by: Sequence[str] = (), label: str = "y", proba: str = "proba",
                       ovr: str = "auc_score_ovr", ovo: str = "auc_score_ovo") -> DataFrame:
    """Macro one-vs-rest and one-vs-one AUC from the same walk over the scores."""
    base, keys = _keyed(df, by)
    per = _pair_wins(_labelled(base, label, proba), keys, label, proba).groupBy(*keys, "_class").agg(
        _against_rest().alias("_auc"), F.sum(_against_one()).alias("_sum"), F.count(_against_one()).alias("_n"))
    res = per.groupBy(*keys).agg(F.avg("_auc").alias(ovr), F.try_divide(F.sum("_sum"), F.sum("_n")).alias(ovo))
    return res if by else res.drop("_all")


def log_loss_term(label: str = "y", proba: str = "proba") -> Column:
    p = F.element_at(F.col(proba), F.col(label).cast("int") + 1)
    return -F.ln(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS)))


def log_loss(label: str = "y", proba: str = "proba") -> Column:
    return F.avg(log_loss_term(label, proba))


def mae(label: str = "y", pred: str = "prediction") -> Column:
    return F.avg(F.abs(F.col(label) - F.col(pred)))


def mape(label: str = "y", pred: str = "prediction") -> Column:
    return F.avg(F.abs(F.col(label) - F.col(pred)) / F.greatest(F.abs(F.col(label)), F.lit(EPS)))


def mse(label: str = "y", pred: str = "prediction") -> Column:
    return F.avg((F.col(label) - F.col(pred)) * (F.col(label) - F.col(pred)))


def rmse(label: str = "y", pred: str = "prediction") -> Column:
    return F.sqrt(mse(label, pred))


def neg_mse(label: str = "y", pred: str = "prediction") -> Column:
    return -mse(label, pred)


def r2(label: str = "y", pred: str = "prediction") -> Column:
    """1 - residual over total variance; a constant target scores 1 when hit exactly and 0 otherwise."""
    err = F.sum((F.col(label) - F.col(pred)) * (F.col(label) - F.col(pred)))
    total = F.var_pop(label) * F.count(label)
    return F.when(total == 0, F.when(err == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - F.try_divide(err, total))


def f1_weighted(df: DataFrame, by: Sequence[str] = (), label: str = "y", pred: str = "prediction",
                out: str = "f1_weighted") -> DataFrame:
    """Support-weighted F1 from the confusion counts."""
    base, keys = _keyed(df, by)
    cells = base.groupBy(*keys, F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("prediction")).agg(
        F.count("*").alias("n"))
    res = f1_from_counts(cells, keys, out)
    return res if by else res.drop("_all")


def f1_from_counts(counts: DataFrame, by: Sequence[str], out: str = "f1_weighted") -> DataFrame:
    """Weighted F1 of a confusion table ``(*by, y, prediction, n)``."""
    zero = F.lit(0).cast("bigint")
    per = counts.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), zero.alias("called"),
                 F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(zero).alias("hits")),
        F.struct(F.col("prediction").alias("c"), zero.alias("support"), F.col("n").alias("called"), zero.alias("hits")),
    )).alias("s")).select(*by, "s.*")
    per = per.groupBy(*by, "c").agg(*[F.sum(x).alias(x) for x in ("support", "called", "hits")])
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("called"))
    return per.groupBy(*by).agg((F.sum(f1 * F.col("support")) / F.sum("support")).alias(out))


# name -> aggregate Column, or function (df, by, out) -> DataFrame for metrics that need their own grouping; names of metrics that
# share one are a tuple
DEFAULT_METRICS: dict[str, dict[str | tuple[str, ...], Callable]] = {
    REGRESSION: {"mae_score": mae, "mape_score": mape, "r2_score": r2, "rmse_score": rmse},
    BINARY: {"auc_score": lambda df, by, out: roc_auc(df, by, out=out)},
    MULTICLASS: {
        ("auc_score_ovr", "auc_score_ovo"): lambda df, by, out: roc_auc_multiclass(df, by, ovr=out[0], ovo=out[1]),
        "log_loss_score": log_loss,
    },
    OUTLIER: {"auc_score": lambda df, by, out: roc_auc(df, by, out=out)},
}


def compute_metrics(predictions: DataFrame, task_type: str, by: Sequence[str],
                    registry: dict[str, dict[str, Callable]] | None = None) -> DataFrame:
    """All registered metrics of one task type, one row per group.

    ``registry`` entries replace the defaults of their task type. A metric is a zero-argument-callable aggregate
    Column, or a three-argument function ``(predictions, by, name) -> DataFrame``.
    """
    chosen = {**DEFAULT_METRICS, **(registry or {})}.get(task_type)
    if not chosen:
        raise ValueError(f"no metrics registered for task type {task_type!r}")
    by = list(by)
    plain, framed = {}, {}
    for name, fn in chosen.items():
        required = [p for p in inspect.signature(fn).parameters.values() if p.default is inspect.Parameter.empty]
        (framed if required else plain)[name] = fn
    res = predictions.groupBy(*by).agg(*[fn().alias(n) for n, fn in plain.items()]) if plain else \
        predictions.select(*by).distinct()
    for name, fn in framed.items():
        res = res.join(fn(predictions, by, name), by, "left")
    return res
