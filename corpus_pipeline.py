"""A training corpus from ``documents``: good, identified, deduplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and rereads it
as the next stage's documents. All stages but the last return the columns of ``documents``.

Every stage takes an empty table to an empty one, keeps columns it does not know, whatever they are called, and judges repeated rows
alike. Rows with a null key are judged by what needs no key (quality) and otherwise kept; null texts are empty texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeframe.llm import decontam, langid, packing, quality, simhash
from gaugeframe.llm.common import drop_ids, prepare
from gaugeframe.staging import mark, settle, stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; empty texts have a score like others, a score of exactly 0.3 stays."""
    prepare(spark)
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified. Empty texts have none; a key that repeats goes if one of its rows has none."""
    prepare(spark)
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of each near-duplicate group that has the smallest doc_id; of repeated rows, all with that id.

    Empty texts are one group. Rows with a null key stay.
    """
    prepare(spark)
    found = simhash.near_duplicates(docs, words=4, radius=4)
    return drop_ids(docs, stage(found.filter("doc_id <> component_id").select("doc_id"), "copies"), "doc_id")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty texts hold none, of a key that repeats one row that holds one drops all."""
    prepare(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents with the check sum of its ids and its place in a sequence.

    An empty text is a piece of one id; repeated rows and rows with a null key are packed each.
    """
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), payload=F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; none of an empty table. A stage's result is written before what it was made of is deleted."""
    sf_dir, began = sf_dir.rstrip("/"), mark()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        (docs,) = settle(spark, began, step(spark, docs, sf_dir))
    return docs
