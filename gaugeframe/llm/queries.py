"""The operators of this package as queries over the driver tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..queries.registry import Tables
from ..staging import scratch_path
from . import (chat, decontam, html_text, langid, licenses, packing, quality, simhash, token_files, vector_codes, vectors, warc,
               whitening)
from .common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(Tables(spark, sf_dir.rstrip("/")))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_warc_revisits")
def _warc_revisits(t):
    """Pages to archives and back; everything returned is read from the archives."""
    path = scratch_path(t.spark, "warc")
    pages = t.pages.select(F.col("page_id").alias("key"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    warc.write_deduplicated(pages, path)
    found = warc.resolve_revisits(warc.read_archives(t.spark, path))
    name = lambda c: F.regexp_extract(c, r"^<urn:record:(-?\d+)>$", 1).try_cast("long")
    return found.select(name(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        name(F.col("refers_to_id")).alias("refers_to"), F.col("target_uri").alias("url"))


@query("op2_language_id")
def _language_id(t):
    """Documents (declared language and source as host) and pages (markup, address) fused as one body of evidence."""
    docs = t.documents.select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text",
                              F.col("lang").alias("declared"), F.col("source").alias("host"))
    pages = t.pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id",
                           langid.visible_text(F.col("html")).alias("text"), langid.markup_language(F.col("html")).alias("declared"),
                           langid.host_of(F.col("url")).alias("host"))
    found = langid.identify(docs.union(pages), carry=["kind", "doc_id", "page_id"])
    return found.withColumn("prob", F.round("prob", 6))


@query("op3_best_fit_packing")
def _best_fit_packing(t):
    return packing.pack(t.documents, public_tokenizers.path(WORD_BPE), payload=F.crc32("ids").alias("ids_crc32"))


@query("op4_simhash_near_dedup")
def _simhash_near_dedup(t):
    found = simhash.near_duplicates(t.documents, words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_embedding_near_dedup")
def _embedding_near_dedup(t):
    return vectors.near_duplicates(t.embeddings, threshold=0.95)


@query("op6_license_scan")
def _license_scan(t):
    return licenses.find_licenses(t.documents).withColumn("containment", F.round("containment", 6))


@query("op7_html_extraction")
def _html_extraction(t):
    pages = t.pages.select("page_id", "url", html_text.extract(F.col("html")).alias("x"))
    return pages.select("page_id", "url", F.col("x.text").alias("text"), F.col("x.n_chars").alias("n_chars"))


@query("op8_decontamination")
def _decontamination(t):
    return decontam.find_leaks(t.documents, t.benchmark)


@query("op9_chat_format")
def _chat_format(t):
    said = "</s>[INST] ok [/INST]"
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    extra = t.spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    formatted = chat.format_conversations(turns.union(extra), public_tokenizers.path(BYTE_BPE))
    return chat.digest(formatted, in_order=True)


@query("op10_quality_classifier")
def _quality_classifier(t):
    docs = t.documents
    return quality.scores(docs, quality.fit(docs, t.labels))


def codes_sql(parts: int = 16, width: int = 64, entries: int = 64, rounds: int = 2) -> str:
    """Product codes in SQL: every part against every entry of its codebook, round after round."""
    w = width // parts
    apart = "list_sum(list_transform(range(1, {w} + 1), lambda j: (p.x[j] - b.x[j]) * (p.x[j] - b.x[j])))".format(w=w)
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    numbered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) - 1 AS r, * FROM kept),
    pieces AS MATERIALIZED (SELECT r, part, x[part * {w} + 1 : part * {w} + {w}] AS x FROM numbered, range({parts}) t(part)),
    book0 AS MATERIALIZED (SELECT part, r AS entry, x FROM pieces WHERE r < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, entry := entry)) AS best FROM (
          SELECT p.r, p.part, b.entry, {apart} AS d FROM pieces p JOIN book{k} b USING (part)) GROUP BY r, part)""")
        if k < rounds:
            mean = ", ".join(f"floor(sum(x[{j}])::DOUBLE / count(*))::BIGINT" for j in range(1, w + 1))
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (
              SELECT part, n.best.entry AS entry, [{mean}] AS x FROM pieces p JOIN near{k} n USING (r, part) GROUP BY ALL) m USING (part, entry))""")
    return f"""WITH {', '.join(steps)},
    coded AS (SELECT r, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
      FROM near{rounds} GROUP BY r),
    digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
    FROM numbered JOIN coded USING (r), digest"""


@query("op11_vector_codes", codes_sql())
def _vector_codes(t):
    found, books = vector_codes.compress(t.embeddings)
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op12_embedding_whitening")
def _embedding_whitening(t):
    return whitening.whiten(t.embeddings)


@query("op13_token_files")
def _token_files(t):
    """Documents to files of token ids and back; everything returned is read from the files."""
    docs, path = t.documents, scratch_path(t.spark, "tokens")
    token_files.write_sequences(docs, path, public_tokenizers.path(BYTE_BPE))
    return token_files.read_documents(t.spark, path, docs.schema["doc_id"].dataType)
