"""End-to-end benchmarks: admit, split, embed, judge, measure. Runs share jobs instead of a driver loop over datasets.

The only loops are over models and evaluators, which are configuration.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.admission import admit_datasets, embedding_report, split_admitted
from ..operators.aggregates import outlier_ratio, profile_datasets
from ..operators.encoding import apply_label_codes, fit_label_codes, one_hot
from ..operators.gram import rank_me
from ..operators.joins import stack_results, work_plan
from ..operators.metrics import (BINARY, MULTICLASS, OUTLIER, REGRESSION, compute_metrics, log_loss, mape, roc_auc_ovr)
from ..operators.projections import classification_type, order_result_columns
from ..operators.splits import expand_folds, join_splits, role_by_column, role_by_hash
from ..sources.sinks import append_results, step_name
from ..sources.tables import read_csv_dataset
from ..staging import mark, settle, stage
from .plugins import KEPT, PARAMS, Embedder, Evaluator, TableSpec

RUN = "run"


@dataclass
class Outcome:
    """Result lines, embedding metadata and skipped datasets of one benchmark."""

    results: DataFrame | None
    metadata: DataFrame | None = None
    skipped: DataFrame | None = None
    errors: DataFrame | None = None


class _Failures:
    """Runs that cannot be judged, gathered as (run, stage, reason) tables."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def add(self, bad: DataFrame, part: str, reason: str | Column) -> None:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        self.tables.append(bad.select(F.col(RUN).cast("string").alias("run"), F.lit(part).alias("stage"), reason.alias("reason")))

    def told(self, spark: SparkSession, plugin, part: str) -> None:
        """What a plug-in that fits run by run has noted."""
        noted = getattr(plugin, "failed", [])
        if noted:
            self.tables.append(spark.createDataFrame([(run, part, why) for run, why in noted], "run string, stage string, reason string"))
            noted.clear()

    def table(self) -> DataFrame | None:
        return _union(self.tables)


def _params(evaluator: Evaluator) -> list:
    return [F.lit(None if v is None else str(v)).cast("string").alias(f"algorithm_{k}")
            for k, v in evaluator.parameters().items()]


def _run_params(scores: DataFrame, line: DataFrame) -> DataFrame:
    """Add a searched evaluator's parameters, which differ from run to run, to its result lines."""
    if PARAMS not in scores.columns:
        return line
    per_run = stage(scores.groupBy(RUN).agg(F.first(PARAMS).alias(PARAMS)), "run-params")
    names = sorted({k for r in per_run.select(F.map_keys(PARAMS).alias("k")).distinct().collect() for k in r["k"]})
    return line.join(per_run.select(RUN, *[F.col(PARAMS)[n].alias(f"algorithm_{n}") for n in names]), RUN, "left")


def _embedded(model: Embedder, rows: DataFrame, spec: TableSpec, measure_rank: bool, failures: _Failures):
    """Vectors of one model, staged, with one metadata line per run; runs with an invalid vector are failures and left out."""
    began = time.time()
    vectors = model.embed(rows, spec, RUN)
    keep = [c for c in (RUN, spec.dataset, spec.row_id, "role", "y") if c in vectors.columns]
    vectors = stage(vectors.select(*dict.fromkeys(keep), "embedding"), "vectors")
    bad = stage(embedding_report(vectors, by=[RUN]).filter("not valid"), "invalid-runs")
    if bad.head(1):
        failures.add(bad, model.name, F.format_string("invalid vectors: %d of %d rows, lengths %d to %d", "bad_rows", "num_rows", "min_dim", "max_dim"))
        vectors = vectors.join(bad.select(RUN), RUN, "left_anti")
    spent = time.time() - began
    meta = vectors.groupBy(RUN).agg(F.count("*").alias("num_rows"), F.max(F.size("embedding")).alias("embedding_dim"))
    meta = meta.withColumn("embedding_model", F.lit(model.name)).withColumn("time_to_compute_embedding", F.lit(spent))
    if measure_rank:
        meta = meta.join(rank_me(vectors, by=[RUN]), RUN)
    return vectors, meta


def _union(frames: Sequence[DataFrame]) -> DataFrame | None:
    return stack_results(frames) if frames else None


def outlier_benchmark(data: DataFrame, spec: TableSpec, models: Sequence[Embedder], evaluators: Sequence[Evaluator], *,
                      max_samples: int = 10_000, max_features: int = 500, exclude: Sequence[str] = (),
                      registry: dict | None = None, measure_rank: bool = False, save_to: str | None = None,
                      run_ts: str = "now") -> Outcome:
    """Embed all rows of every admitted dataset, score them, and compare the scores with ``y`` (1 = outlier)."""
    began = mark()
    data = data.withColumn("y", F.col(spec.target).cast("int"))
    profile = profile_datasets(data, spec.features, "y", [spec.dataset], spec.categorical)
    ratio = data.groupBy(spec.dataset).agg(outlier_ratio("y").alias("outlier_ratio"))
    marked = stage(admit_datasets(profile.join(ratio, spec.dataset), max_samples, max_features, deny=exclude or None,
                                  dataset=spec.dataset), "profile")
    admitted, skipped = split_admitted(marked)
    plan = stage(work_plan(admitted.withColumn("task_type", F.lit(OUTLIER)),
                           [dict(name=m.name, max_samples=m.max_samples, max_features=m.max_features) for m in models],
                           [dict(name=e.name, task_types=e.task_types) for e in evaluators]), "plan")
    lines, metas, failures = [], [], _Failures()
    for model in models:
        mine = plan.filter(F.col("embedding_model") == model.name).select(spec.dataset).distinct()
        rows = data.join(mine, spec.dataset, "left_semi").withColumn(RUN, F.col(spec.dataset))
        vectors, meta = _embedded(model, rows, spec, measure_rank, failures)
        metas.append(meta)
        for ev in evaluators:
            if not ev.compatible(OUTLIER):
                continue
            scores = ev.score(vectors, spec, RUN, OUTLIER, 2).join(vectors.select(RUN, spec.row_id, "y"), [RUN, spec.row_id])
            got = compute_metrics(scores, OUTLIER, [RUN], registry)
            line = got.withColumnRenamed(RUN, "dataset_name").select(
                F.lit(model.name).alias("embedding_model"), "dataset_name", F.lit(ev.name).alias("algorithm"),
                F.lit(OUTLIER).alias("task"), *[c for c in got.columns if c != RUN], *_params(ev))
            line = stage(line, "result-line")
            if save_to:
                append_results(line, save_to, "outlier", run_ts, step_name(model.name, ev.name, ev.parameters()))
            lines.append(line)
    results = _union(lines)
    if results is not None:
        facts = admitted.select(F.col(spec.dataset).alias("dataset_name"), F.col("num_samples").alias("dataset_size"),
                                "num_features", "outlier_ratio")
        results = order_result_columns(results.join(facts, "dataset_name"))
    return Outcome(*settle(data.sparkSession, began, results, _union(metas), skipped, failures.table()))


def _mask_constants(data: DataFrame, spec: TableSpec) -> DataFrame:
    """Null out, dataset by dataset, features with at most one distinct value there; ``KEPT`` counts the others."""
    ds = spec.dataset
    flat = {c: F.min(c).eqNullSafe(F.max(c)) for c in spec.features}
    found = stage(data.groupBy(ds).agg(*[f.alias(f"_flat_{c}") for c, f in flat.items()]), "constant-columns")
    kept = sum((F.when(F.col(f"_flat_{c}"), 0).otherwise(1) for c in spec.features), F.lit(0))
    out = data.join(found, ds).withColumn(KEPT, kept)
    return out.withColumns({c: F.when(~F.col(f"_flat_{c}"), F.col(c)) for c in spec.features}).drop(*[f"_flat_{c}" for c in flat])


def supervised_benchmark(data: DataFrame, splits: DataFrame, tasks: DataFrame, spec: TableSpec,
                         models: Sequence[Embedder], evaluators: Sequence[Evaluator], *, max_samples: int = 100_000,
                         max_features: int = 500, skip_missing: bool = False, allow: Sequence | None = None,
                         lite: bool = False, registry: dict | None = None, measure_rank: bool = False,
                         save_to: str | None = None, run_ts: str = "now") -> Outcome:
    """Every admitted dataset over its folds and repeats.

    ``splits`` is ``(dataset, repeat, fold, row_id, role)``; ``tasks`` is ``(dataset, task_type, folds)`` where the
    task type is the regression type or any classification type (binary and multiclass are told apart by counting).
    Labels are coded per run from the train rows; columns constant in a dataset do not count there. A run with a test label
    that its train rows lack, without train or test rows, or with an invalid vector goes to ``errors``; the others go on.
    Features are never copied per fold: a staged table of (row, run, role, label) joins them where they are read.
    """
    began = mark()
    ds = spec.dataset
    profile = profile_datasets(data, spec.features, spec.target, [ds], spec.categorical).join(tasks, ds)
    profile = profile.withColumn("task_type", F.when(F.col("task_type") == REGRESSION, F.lit(REGRESSION))
                                 .otherwise(classification_type("num_classes")))
    marked = stage(admit_datasets(profile, max_samples, max_features, skip_missing=skip_missing, allow=allow, dataset=ds),
                   "profile")
    admitted, skipped = split_admitted(marked)
    plan = stage(work_plan(admitted, [dict(name=m.name, max_samples=m.max_samples, max_features=m.max_features) for m in models],
                           [dict(name=e.name, task_types=e.task_types) for e in evaluators]
                           + [dict(name="", task_types=(BINARY, MULTICLASS, REGRESSION))]), "plan")
    wanted = expand_folds(admitted, lite=lite).select(ds, "repeat", "fold", "task_type", "num_classes")
    chosen = splits.join(wanted, [ds, "repeat", "fold"]).withColumn(
        RUN, F.concat_ws("|", ds, F.col("repeat").cast("string"), F.col("fold").cast("string")))
    runs = stage(join_splits(data.select(ds, spec.row_id, spec.target), chosen, [ds, spec.row_id]), "runs")
    data = _mask_constants(data, spec).drop(*([spec.target] if spec.target not in spec.features else []))
    lines, metas, failures = [], [], _Failures()
    for task in (BINARY, MULTICLASS, REGRESSION):
        keys = runs.filter(F.col("task_type") == task)
        facts = keys.agg(F.max("num_classes").alias("k"), F.count("*").alias("n")).first()
        if not facts["n"]:
            continue
        classes = int(facts["k"]) if task != REGRESSION else 0
        if task == REGRESSION:
            keys = keys.withColumn("y", F.col(spec.target).cast("double"))
        else:
            codes = fit_label_codes(keys.filter("role = 'train'"), spec.target, [RUN], "y")
            keys = apply_label_codes(keys, codes, spec.target, [RUN], "y", check=False)
        keys = stage(keys.select(ds, spec.row_id, RUN, "role", "y"), "run-labels")
        odd = stage(keys.groupBy(RUN).agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"),
                                          F.count_if(F.col("y").isNull()).alias("unseen")).filter("train = 0 or test = 0 or unseen > 0"), "odd-runs")
        if odd.head(1):
            failures.add(odd, task, F.format_string("%d train rows, %d test rows, %d labels missing from the train rows", "train", "test", "unseen"))
            keys = keys.join(odd.select(RUN), RUN, "left_anti")
        part = data.join(keys, [ds, spec.row_id])
        for model in models:
            mine = plan.filter((F.col("embedding_model") == model.name) & (F.col("task_type") == task))
            keep = part.join(mine.select(ds).distinct(), ds, "left_semi")
            jobs: list[tuple[str | None, Evaluator | None]] = []
            if model.end_to_end:
                jobs.append((None, None))
                vectors = None
            else:
                vectors, meta = _embedded(model, keep, spec, measure_rank, failures)
                metas.append(meta.withColumn("task", F.lit(task)))
                jobs += [(model.name, e) for e in evaluators if e.compatible(task)]
            for emb, ev in jobs:
                if ev is None:
                    scores = model.predict(keep, spec, RUN, task, classes)
                else:
                    truth = vectors.filter("role = 'test'").select(RUN, spec.row_id, "y")
                    scores = ev.score(vectors, spec, RUN, task, classes).join(truth, [RUN, spec.row_id])
                failures.told(data.sparkSession, ev or model, (ev or model).name)
                if task == BINARY:
                    scores = scores.withColumn("prediction", F.element_at("proba", 2))
                scores = stage(scores, "scores")
                got = _run_params(scores, compute_metrics(scores.drop(PARAMS), task, [RUN], registry))
                bits = F.split(RUN, r"\|")
                line = got.select(
                    F.lit(emb).cast("string").alias("embedding_model"), bits[0].alias("dataset_name"),
                    bits[1].cast("int").alias("repeat"), bits[2].cast("int").alias("fold"),
                    F.lit(ev.name if ev else model.name).alias("algorithm"), F.lit(task).alias("task"),
                    *[c for c in got.columns if c != RUN], *(_params(ev) if ev else []))
                line = stage(line, "result-line")
                if save_to:
                    append_results(line, save_to, "supervised", run_ts, step_name(emb, (ev or model).name, ev.parameters() if ev else {}, task))
                lines.append(line)
    results = _union(lines)
    if results is not None:
        facts = admitted.select(F.col(ds).cast("string").alias("dataset_name"), F.col("num_samples").alias("dataset_size"),
                                "num_features")
        results = order_result_columns(results.join(facts, "dataset_name"))
    return Outcome(*settle(data.sparkSession, began, results, _union(metas), skipped, failures.table()))


def separation_benchmark(data: DataFrame, members: DataFrame, spec: TableSpec, models: Sequence[Embedder],
                         evaluators: Sequence[Evaluator], *, test_size: float = 0.2, seed: int = 42,
                         save_to: str | None = None, run_ts: str = "now", registry: dict | None = None) -> Outcome:
    """Can a classifier tell which dataset a row's vector came from?

    ``members`` is ``(collection, position, dataset)`` with positions from 1. A dataset is embedded once, whatever
    number of collections it belongs to; a collection's label is the member's position.
    """
    began = mark()
    ds = spec.dataset
    wanted = members.select(ds).distinct()
    rows = data.join(wanted, ds, "left_semi").withColumn(RUN, F.col(ds)).withColumn(
        "role", role_by_hash(spec.row_id, test_size, seed))
    sizes = stage(members.groupBy("collection").agg(F.count("*").alias("size")), "sizes")
    names = members.groupBy("collection").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", F.col(ds).cast("string").alias("d")))), lambda m: m["d"]).alias("d"))
    names = names.select("collection", F.array_join("d", "_").alias("task_ids"))
    lines, failures = [], _Failures()
    for model in models:
        vectors, _ = _embedded(model, rows, spec, False, failures)
        pooled = vectors.join(members, ds).withColumn("y", (F.col("position") - 1).cast("int")).withColumn(RUN, F.col("collection"))
        pooled = pooled.withColumn("key", F.concat_ws("|", F.col(ds).cast("string"), F.col(spec.row_id).cast("string")))
        pooled = stage(pooled.select(RUN, "key", "role", "y", "embedding").join(
            sizes.withColumnRenamed("collection", RUN), RUN), "pooled")
        keyed = TableSpec(spec.features, spec.categorical, "key", "y", ds)
        for task in (BINARY, MULTICLASS):
            part = pooled.filter((F.col("size") > 2) if task == MULTICLASS else (F.col("size") <= 2))
            facts = part.agg(F.max("size")).first()[0]
            if not facts:
                continue
            for ev in evaluators:
                if not ev.compatible(task):
                    continue
                scores = ev.score(part, keyed, RUN, task, int(facts)).join(
                    part.filter("role = 'test'").select(RUN, "key", "y", "size"), [RUN, "key"])
                if task == BINARY:
                    scores = scores.withColumn("prediction", F.element_at("proba", 2))
                else:
                    scores = scores.withColumn("proba", F.slice("proba", F.lit(1), F.col("size").cast("int")))
                got = compute_metrics(stage(scores, "scores"), task, [RUN], registry)
                line = got.withColumnRenamed(RUN, "collection").select(
                    F.lit(model.name).alias("embedding_model"), "collection", F.lit(ev.name).alias("algorithm"),
                    F.lit(task).alias("task"), *[c for c in got.columns if c != RUN], *_params(ev)).join(names, "collection")
                line = stage(line, "result-line")
                if save_to:
                    append_results(line, save_to, "separation", run_ts, step_name(model.name, ev.name, ev.parameters(), task))
                lines.append(line)
    results, errors = settle(data.sparkSession, began, _union(lines), failures.table())
    return Outcome(results, errors=errors)


def single_dataset_benchmark(spark: SparkSession, path: str, target: str, task: str, models: Sequence[Embedder],
                             evaluators: Sequence[Evaluator], *, schema=None, key: str | None = None,
                             features: Sequence[str] | None = None, categorical: Sequence[str] = (),
                             split_column: str = "set", test_size: float = 0.2, seed: int = 42) -> Outcome:
    """One CSV dataset: split by its ``set`` column, or at random; weighted AUC and log loss, AUC, or MAPE."""
    began = mark()
    data = read_csv_dataset(spark, path, schema, key)
    skip = {target, "row_id", split_column, key}
    chosen = list(features or [c for c in data.columns if c not in skip])
    role = role_by_column(split_column) if split_column in data.columns else role_by_hash("row_id", test_size, seed)
    data = data.withColumn("role", role).withColumn(RUN, F.lit("single"))
    spec = TableSpec(tuple(chosen), tuple(categorical), "row_id", target, RUN)
    if task == REGRESSION:
        data, classes = data.withColumn("y", F.col(target).cast("double")), 0
        registry = {REGRESSION: {"mape_score": mape}}
    else:
        codes = stage(fit_label_codes(data.filter("role = 'train'"), target, (), "y"), "codes")
        classes = codes.count()
        data = apply_label_codes(data, codes, target, (), "y")
        task = MULTICLASS if classes > 2 else BINARY
        if task == MULTICLASS:
            data = data.withColumn("y_one_hot", one_hot("y", classes))
        registry = {MULTICLASS: {"auc_score": lambda df, by, out: roc_auc_ovr(df, by, average="weighted", out=out),
                                 "log_loss_score": log_loss}}
    data = stage(data, "single")
    lines, failures = [], _Failures()
    for model in models:
        vectors, _ = _embedded(model, data, spec, False, failures)
        for ev in evaluators:
            if not ev.compatible(task):
                continue
            truth = vectors.filter("role = 'test'").select(RUN, "row_id", "y")
            scores = ev.score(vectors, spec, RUN, task, classes).join(truth, [RUN, "row_id"])
            if task == BINARY:
                scores = scores.withColumn("prediction", F.element_at("proba", 2))
            got = compute_metrics(stage(scores, "scores"), task, [RUN], registry)
            lines.append(got.select(F.lit(model.name).alias("embedding_model"), F.lit(ev.name).alias("algorithm"),
                                    F.lit(task).alias("task"), *[c for c in got.columns if c != RUN], *_params(ev)))
    results, errors = settle(data.sparkSession, began, _union(lines), failures.table())
    return Outcome(results, errors=errors)


def run_suite(spark: SparkSession, parts: dict[str, Callable[[], Outcome]]) -> tuple[dict[str, Outcome], DataFrame]:
    """Run each part on its own; a failing part yields an empty outcome and a line in the errors table."""
    outcomes, errors = {}, []
    for name, part in parts.items():
        try:
            outcomes[name] = part()
        except Exception as e:  # one part must never take the others down
            outcomes[name] = Outcome(None)
            errors.append((name, type(e).__name__, str(e)[:2000]))
    return outcomes, spark.createDataFrame(errors, "part string, error string, message string")
