"""Extension surface: embedders and evaluators, all keyed so that many runs go through one job.

``run`` is the list of columns that name one independent unit (dataset, or dataset, repeat and fold).
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.embed import hashed_table_vectors
from ..operators.metrics import BINARY, MULTICLASS, OUTLIER, REGRESSION
from ..operators.neighbors import knn_classify, knn_regress, local_outlier_factor
from ..operators.outliers import centre_distance, isolation_forest, tree_samples
from ..operators.scaling import standardise_by_group
from ..operators.sphere import sphere_by_join
from ..operators.tuned import TunedEvaluator
from ..staging import scratch_path, stage

KEPT, PARAMS = "_kept_features", "params"


@dataclass(frozen=True)
class TableSpec:
    """How to read a feature table: its keys, feature columns and which of them are categorical."""

    features: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    row_id: str = "row_id"
    target: str = "y"
    dataset: str = "dataset"


class Embedder:
    """Turns rows into vectors. ``embed`` fits on the train rows of each run and transforms all of its rows."""

    name = "embedder"
    max_samples: int | None = None
    max_features: int | None = None
    end_to_end = False

    def embed(self, rows: DataFrame, spec: TableSpec, run: str) -> DataFrame:
        """``rows`` has ``run``, ``row_id``, ``role`` and the features; returns it with ``embedding``."""
        raise NotImplementedError

    def predict(self, rows: DataFrame, spec: TableSpec, run: str, task_type: str, num_classes: int) -> DataFrame:
        raise NotImplementedError(f"{self.name} is not an end-to-end model")


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("role") == "train") if "role" in rows.columns else rows


@dataclass
class SphereEmbedder(Embedder):
    dim: int = 64
    seed: int = 42
    name: str = "Sphere"
    max_samples: int | None = None
    max_features: int | None = None

    def embed(self, rows, spec, run):
        made = sphere_by_join(rows, spec.features, spec.categorical, run, self.dim, self.seed, _train(rows))
        if KEPT not in rows.columns:
            return made
        # features that are constant in a dataset are null there: the mean is over its other columns
        share = F.lit(float(len(spec.features))) / F.greatest(F.col(KEPT), F.lit(1))
        return made.withColumn("embedding", F.transform("embedding", lambda x: x * share))


@dataclass
class ScaledEmbedder(Embedder):
    """The standardised numeric columns as they are."""

    name: str = "Scaled"
    max_samples: int | None = None
    max_features: int | None = None

    def embed(self, rows, spec, run):
        numeric = [c for c in spec.features if c not in spec.categorical]
        scaled = standardise_by_group(rows, numeric, [run], _train(rows))
        return scaled.withColumn("embedding", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric]))


@dataclass
class VectorizerEmbedder(Embedder):
    """Numbers, unfolded dates and projected trigrams of texts. Nothing is fitted, so no run learns from another."""

    name: str = "TableVectorizer"
    max_samples: int | None = None
    max_features: int | None = None

    def embed(self, rows, spec, run):
        return hashed_table_vectors(rows, spec.features)


@dataclass
class ExternalEmbedder(Embedder):
    """Any user model that embeds rows in the light of train rows: ``fn(context, rows) -> vectors of rows``, both pandas.

    ``context_rows`` is the model's own bound on its context, which the caller states: a run with more train rows gives it
    those with the smallest keyed hash. All rows are embedded, in slices of about ``slice_rows`` that each get the run's context,
    so a run of any size is many tasks.
    """

    fn: Callable
    context_rows: int
    name: str = "External"
    seed: int = 42
    slice_rows: int = 10_000
    max_samples: int | None = None
    max_features: int | None = None

    def embed(self, rows, spec, run):
        fn, cols = self.fn, list(spec.features)
        context = stage(tree_samples(_train(rows).select(run, spec.row_id, *cols), spec.row_id, 1, self.context_rows, self.seed, [run]), "context")
        slices = stage(rows.groupBy(run).agg(F.ceil(F.count("*") / self.slice_rows).cast("int").alias("_slices")), "slices")
        cut = rows.join(slices, run).withColumn("_slice", F.pmod(F.xxhash64(spec.row_id), F.col("_slices")).cast("int"))
        copies = context.select(run, *cols, F.col("_rank")).join(slices, run).withColumn(
            "_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
        schema = T.StructType(rows.schema.fields + [T.StructField("embedding", T.ArrayType(T.DoubleType()))])

        def apply(known: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            out = part.drop(columns=["_slice", "_slices"])
            if len(part):
                vectors = fn(known.sort_values("_rank")[cols].reset_index(drop=True), part[cols].reset_index(drop=True))
                out["embedding"] = [list(map(float, v)) for v in vectors]
            return out.reindex(columns=schema.names)

        return copies.groupBy(run, "_slice").cogroup(cut.groupBy(run, "_slice")).applyInPandas(apply, schema)


@dataclass
class PipelinePredictor(Embedder):
    """End-to-end model: a Spark ML pipeline factory that predicts the target without an embedding in between."""

    make: Callable[[list[str], str], Pipeline] = None
    name: str = "Pipeline"
    task_types: tuple = (BINARY, MULTICLASS, REGRESSION)
    max_samples: int | None = None
    max_features: int | None = None
    end_to_end = True
    failed: list = field(default_factory=list)

    def predict(self, rows, spec, run, task_type, num_classes):
        if task_type not in self.task_types:
            raise ValueError(f"{self.name} does not support {task_type}")
        label = [] if task_type == REGRESSION else [vector_to_array("probability").alias("proba")]

        def one(name, part):
            model = self.make(list(spec.features), task_type).fit(part.filter("role = 'train'"))
            return model.transform(part.filter("role = 'test'")).select(
                F.lit(name).alias(run), spec.row_id, "y", F.col("prediction").cast("double"), *label)

        return _each_run(rows, run, one, self.failed)


class Evaluator:
    """Judges vectors. ``score`` returns ``(run, row_id, prediction[, proba])`` for the rows to be judged."""

    name = "evaluator"
    task_types: tuple = ()

    def parameters(self) -> dict:
        return {}

    def score(self, rows: DataFrame, spec: TableSpec, run: str, task_type: str, num_classes: int) -> DataFrame:
        raise NotImplementedError

    def compatible(self, task_type: str) -> bool:
        return task_type in self.task_types


@dataclass
class KNNClassifier(Evaluator):
    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    name: str = "KNNClassifier"
    task_types: tuple = (BINARY, MULTICLASS)

    def parameters(self):
        return {"k": self.k, "weights": self.weights, "metric": self.metric}

    def score(self, rows, spec, run, task_type, num_classes):
        return knn_classify(rows.filter("role = 'train'"), rows.filter("role = 'test'"), num_classes, self.k,
                            self.weights, self.metric, row_id=spec.row_id, label="y", by=[run])


@dataclass
class KNNRegressor(Evaluator):
    k: int = 5
    weights: str = "uniform"
    metric: str = "euclidean"
    name: str = "KNNRegressor"
    task_types: tuple = (REGRESSION,)

    def parameters(self):
        return {"k": self.k, "weights": self.weights, "metric": self.metric}

    def score(self, rows, spec, run, task_type, num_classes):
        return knn_regress(rows.filter("role = 'train'"), rows.filter("role = 'test'"), self.k, self.weights,
                           self.metric, row_id=spec.row_id, target="y", by=[run])


@dataclass
class LocalOutlierFactor(Evaluator):
    k: int = 20
    metric: str = "euclidean"
    name: str = "LocalOutlierFactor"
    task_types: tuple = (OUTLIER,)

    def parameters(self):
        return {"k": self.k, "metric": self.metric}

    def score(self, rows, spec, run, task_type, num_classes):
        return local_outlier_factor(rows, self.k, self.metric, row_id=spec.row_id, by=[run])


@dataclass
class IsolationForest(Evaluator):
    trees: int = 100
    max_samples: int = 256
    seed: int = 42
    name: str = "IsolationForest"
    task_types: tuple = (OUTLIER,)

    def parameters(self):
        return {"trees": self.trees, "max_samples": self.max_samples}

    def score(self, rows, spec, run, task_type, num_classes):
        return isolation_forest(rows, row_id=spec.row_id, trees=self.trees, max_samples=self.max_samples,
                                seed=self.seed, by=[run])


@dataclass
class CentreDistance(Evaluator):
    contamination: float = 0.1
    fourier: int | None = None
    name: str = "CentreDistance"
    task_types: tuple = (OUTLIER,)

    def parameters(self):
        return {"contamination": self.contamination, "fourier": self.fourier}

    def score(self, rows, spec, run, task_type, num_classes):
        return centre_distance(rows, row_id=spec.row_id, contamination=self.contamination, fourier=self.fourier,
                               by=[run]).drop("is_outlier")


@dataclass
class Tuned(Evaluator):
    """A searched Spark ML evaluator. Every run is a search of its own, made of distributed fits; its parameters are columns of
    its rows (``params``), and a run whose search fails is noted in ``failed`` and left out."""

    make: Callable[[], TunedEvaluator] = None
    name: str = "Tuned"
    task_types: tuple = (BINARY, MULTICLASS)
    failed: list = field(default_factory=list)

    def score(self, rows, spec, run, task_type, num_classes):
        def one(name, part):
            tuned = self.make()
            tuned.row_id, tuned.label = spec.row_id, "y"
            tuned.fit(part.filter("role = 'train'"))
            chosen = [F.lit(x) for k, v in tuned.parameters().items() for x in (k, str(v))]
            return tuned.predict(part.filter("role = 'test'")).withColumns({run: F.lit(name), PARAMS: F.create_map(*chosen)})

        return _each_run(rows, run, one, self.failed)


def _each_run(rows: DataFrame, run: str, one: Callable[[object, DataFrame], DataFrame], failed: list, parallelism: int = 8) -> DataFrame:
    """``one(name, rows of the run)`` for every run, ``parallelism`` runs at a time, each in a scheduler pool of its own.

    For models that are fitted one at a time: every run writes its part of one table, which is read as a whole, so the plan
    does not grow with the runs. Only their names come to the driver, and a run that fails is appended to ``failed`` as (name,
    message).
    """
    spark = rows.sparkSession
    path, context = scratch_path(spark, "runs"), contextvars.copy_context()

    def fit(task):
        number, name = task
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"run-{number % parallelism}")
        one(name, rows.filter(F.col(run) == F.lit(name))).write.parquet(f"{path}/run_number={number}")

    def tried(task):
        try:
            context.copy().run(fit, task)
        except Exception as e:  # one run must never take the others down
            return str(task[1]), f"{type(e).__name__}: {str(e)[:500]}"

    names = (r[0] for r in rows.select(run).distinct().orderBy(run).toLocalIterator())
    done = 0
    with ThreadPool(parallelism) as pool:
        for told in pool.imap(inheritable_thread_target(spark)(tried), enumerate(names)):
            failed.extend([told] if told else [])
            done += told is None
    if not done:
        raise ValueError(f"no run succeeded: {failed[:3]}")
    return spark.read.option("mergeSchema", True).parquet(path).drop("run_number")

