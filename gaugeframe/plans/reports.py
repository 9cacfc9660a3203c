"""Report tables over benchmark results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators.admission import equals_or_missing, keep_listed, split_by_task
from ..operators.aggregates import best_score, clean_results, describe_by_outlier_ratio, describe_results
from ..operators.metrics import BINARY, MULTICLASS, REGRESSION
from ..operators.projections import rename_values
from ..sources.sinks import save_report

_KEYS = ["algorithm", "embedding_model", "dataset_name", "dataset_size", "num_features"]


def _chosen(results: DataFrame, name_mapping: Mapping[str, str] | None, models_to_keep: Sequence[str] | None) -> DataFrame:
    if name_mapping:
        results = rename_values(results, "embedding_model", name_mapping)
    if models_to_keep is not None:
        results = keep_listed(results, "embedding_model", models_to_keep)
    return results


def outlier_report(results: DataFrame, name_mapping: Mapping[str, str] | None = None,
                   models_to_keep: Sequence[str] | None = None, bin_edges: Sequence[float] | None = None,
                   folder: str | None = None) -> dict[str, DataFrame]:
    """Best AUC per configuration, evenly covered datasets only, described per model and per outlier-ratio bin."""
    results = _chosen(results, name_mapping, models_to_keep)
    keys = _KEYS + ["outlier_ratio", "time_to_compute_embedding"]
    if "algorithm_metric" in results.columns:
        results = equals_or_missing(results, {"algorithm_metric": "euclidean"})
        keys = keys + ["algorithm_metric"]
    best, _ = clean_results(best_score(results, keys, "auc_score"))
    tables = {"outlier_descriptive": describe_results(best, "auc_score")}
    if bin_edges:
        tables["outlier_ratio"] = describe_by_outlier_ratio(best, bin_edges, "auc_score")
    if folder:
        for name, table in tables.items():
            save_report(table, f"{folder.rstrip('/')}/{name}.csv")
    return tables


def supervised_report(results: DataFrame, name_mapping: Mapping[str, str] | None = None,
                      models_to_keep: Sequence[str] | None = None, folder: str | None = None,
                      multiclass_metric: str = "auc_score_ovr",
                      tasks: Sequence[str] = ("binary", "multiclass", "regression")) -> dict[str, DataFrame]:
    """Per task type: coverage cleaning, best score per configuration, description."""
    results = _chosen(results, name_mapping, models_to_keep)
    keys = _KEYS + ["time_to_compute_embedding"]
    if "algorithm_metric" in results.columns and "algorithm_weights" in results.columns:
        results = equals_or_missing(results, {"algorithm_metric": "euclidean", "algorithm_weights": "distance"})
        keys = keys + ["algorithm_metric"]
    parts = split_by_task(results)
    tables = {}
    for name, task, metric, lower in (("binary", BINARY, "auc_score", False),
                                      ("multiclass", MULTICLASS, multiclass_metric, False),
                                      ("regression", REGRESSION, "mape_score", True)):
        if name not in tasks or metric not in results.columns:
            continue
        kept, _ = clean_results(parts[task])
        tables[f"{name}_descriptive"] = describe_results(best_score(kept, keys, metric, lower), metric)
    if folder:
        for name, table in tables.items():
            save_report(table, f"{folder.rstrip('/')}/{name}.csv")
    return tables
