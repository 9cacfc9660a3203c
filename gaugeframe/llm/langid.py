"""Language identification by Bayesian evidence fusion.

The evidence of a row is its text (a byte-trigram likelihood per language, counted over all rows with a known declared
language), the declared language (how often each language is declared as each, counted against the text's own best
guess), the address suffix (how often each language uses it) and a prior of the host. The host's language shares are smoothed towards
those of its registered domain and those towards all rows'; a row's own guess is left out of its host's. All of it is counted by grouped
aggregation; a row meets its host in one join that carries no text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import stage
from .common import LOWER, broadcast_if_small, chunks, drop_ids, flat, give_back, thrifty

BUCKETS = 1 << 15
BLOCK = 64  # languages whose trigrams a worker holds at once


def primary(code: Column) -> Column:
    """The primary subtag of a language code, lower case; null if it is none."""
    tag = F.lower(F.regexp_extract(F.trim(code.cast("string")), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.when(tag != "", tag)


def host_of(url: Column) -> Column:
    """Host of an address, lower case, without port and user; null if there is none."""
    host = F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def markup_language(html: Column) -> Column:
    """Language declared by the root element or the content-language header of a page."""
    own = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    meta = F.regexp_extract(html, r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?content-language[^>]*content\s*=\s*["']?([A-Za-z_-]+)""", 1)
    return F.when(own != "", own).when(meta != "", meta)


def visible_text(html: Column) -> Column:
    """Markup, scripts and styles as spaces."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")


def _trigrams(column: pa.Array):
    """Per piece: ``(first row, rows, bucket per trigram, row per trigram)``; rows count from the first."""
    data, offs = flat(column)
    for a, b in chunks(offs):
        part = LOWER[data[offs[a]: offs[b]]].astype(np.uint32)
        if len(part) < 3:
            continue
        code = (part[:-2] * np.uint32(0x9E3779B1)) ^ (part[1:-1] * np.uint32(0x85EBCA77)) ^ (part[2:] * np.uint32(0xC2B2AE3D))
        code ^= code >> np.uint32(15)
        whole = np.ones(len(code), bool)
        for edge in (offs[a + 1: b + 1] - offs[a] - 2, offs[a + 1: b + 1] - offs[a] - 1):
            whole[edge[(edge >= 0) & (edge < len(code))]] = False
        row = np.repeat(np.arange(b - a), np.diff(offs[a: b + 1]))[: len(code)]
        yield a, b - a, (code & np.uint32(BUCKETS - 1)).astype(np.int64)[whole], row[whole]


def trigram_table(rows: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-probability of each trigram bucket by language, float32, from all rows ``(text, declared)`` that declare one of them."""
    place = {code: k for k, code in enumerate(languages)}

    def work(batches):
        total = np.zeros(len(place) * BUCKETS, np.int64)
        for batch in thrifty(batches):
            own = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()])
            for first, _, bucket, row in _trigrams(batch.column(0)):
                lang = own[first + row]
                known = lang >= 0
                total += np.bincount(lang[known] * BUCKETS + bucket[known], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(place)), pa.int32()),
                                          pa.array([p.tobytes() for p in total.reshape(len(place), -1)], pa.binary())], names=["lang", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(sums, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())],
                                         names=["lang", "sums"])

    shape = "lang int, sums binary"
    sums = rows.select("text", "declared").mapInArrow(work, shape)
    sums = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("lang", "salt").drop("salt")
    sums = sums.mapInArrow(add, shape).repartition(len(place), "lang").mapInArrow(add, shape)
    counts = np.zeros((len(place), BUCKETS))
    for k, part in sums.collect():
        counts[k] += np.frombuffer(part, np.int64)
    counts += 0.5
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _text_evidence(table, weight: float, most: int):
    def evidence(column: pa.Array) -> pa.Array:
        log_p = table.value
        out = np.zeros((len(column), len(log_p)))
        many = np.zeros(len(column), np.int64)
        for first, rows, bucket, row in _trigrams(column):
            many[first: first + rows] = np.bincount(row, minlength=rows)
            for k, own in enumerate(log_p):
                out[first: first + rows, k] = np.bincount(row, own[bucket], minlength=rows)
        out *= (weight * np.minimum(many, most) / np.maximum(many, 1))[:, None]
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
        give_back()
        return pa.StructArray.from_arrays([values, pa.array(many)], names=["ll", "trigrams"])

    return F.arrow_udf(evidence, "struct<ll:array<double>,trigrams:bigint>")


def _shares(counts: Column, total: Column, towards: Column, strength: float) -> Column:
    return F.zip_with(counts, towards, lambda c, p: (c + strength * p) / (total + strength))


def identify(rows: DataFrame, text: str = "text", declared: str = "declared", host: str = "host", carry: list[str] = (),
             languages: list[str] | None = None, min_prob: float = 0.5, strength: float = 4.0, text_weight: float = 0.3,
             most_trigrams: int = 200) -> DataFrame:
    """``(*carry, lang, prob, text_lang, declared, trigrams, accepted)`` per row.

    ``languages``: codes to tell apart; by default all declared ones. Their trigrams are counted and scored ``BLOCK`` languages
    at a time, with the scores written between blocks, so a worker's memory does not grow with them. ``prob`` is the
    probability of ``lang``, ties go to the first in the order of codes. A row without trigrams (null, empty, under three
    bytes) has language ``und`` by its text; it is told by the other evidence but not accepted. A row is accepted if
    ``prob`` reaches ``min_prob``. Null declared codes and hosts are no evidence. Rows of one host may be any share of all.
    With no declared language at all everything is ``und``. Columns not named are ignored.
    """
    spark, carry = rows.sparkSession, list(carry)
    rows = rows.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], F.col(text).cast("string").alias("text"),
                       primary(F.col(declared)).alias("declared"), F.lower(F.col(host).cast("string")).alias("host"))
    if languages is None:
        languages = sorted(r[0] for r in rows.select("declared").filter("declared is not null").distinct().collect())
    names = [F.col(f"c{k}").alias(c) for k, c in enumerate(carry)]
    if not languages:
        return rows.select(*names, F.lit("und").alias("lang"), F.lit(0.0).alias("prob"), F.lit("und").alias("text_lang"),
                           "declared", F.lit(0).cast("long").alias("trigrams"), F.lit(False).alias("accepted"))
    n = len(languages)
    codes = F.array(*[F.lit(c) for c in languages])
    base = rows
    for at in range(0, n, BLOCK):
        table = spark.sparkContext.broadcast(trigram_table(rows, languages[at: at + BLOCK]))
        base = base.withColumn("e", _text_evidence(table, text_weight, most_trigrams)("text"))
        score = F.concat("ll", "e.ll") if at else F.col("e.ll")
        if at + BLOCK < n:
            base = stage(base.select(*rows.columns, score.alias("ll")), "language-scores")
    base = base.select(*[f"c{k}" for k in range(len(carry))], "declared", "host", score.alias("ll"), F.col("e.trigrams").alias("trigrams"))
    guess = F.when(F.col("trigrams") > 0, F.array_position("ll", F.array_max("ll")).cast("int"))
    base = stage(base.withColumn("guess", guess), "language-evidence")

    # what each language declares: languages x (languages, others, none), a table of fixed size
    told = F.when(F.col("declared").isNull(), "none").when(F.array_contains(codes, F.col("declared")), F.col("declared")).otherwise("other")
    seen = {(g, d): c for g, d, c in base.filter("guess is not null").groupBy("guess", told.alias("d")).count().collect()}
    kinds = [*languages, "other"]
    told_as = {g: [seen.get((g, d), 0) for d in kinds] for g in range(1, n + 1)}
    whole = {g: sum(counts) + len(kinds) for g, counts in told_as.items()}
    declared_ll = F.from_json(F.lit(json.dumps({d: [float(np.log((told_as[g][k] + 1) / whole[g])) for g in range(1, n + 1)]
                                                for k, d in enumerate(kinds)})), "map<string,array<double>>")

    # hosts, their domains and suffixes
    each = [F.sum((F.col("guess") == g).cast("double")) for g in range(1, n + 1)]
    hosts = stage(base.filter("host is not null and guess is not null").groupBy("host").agg(F.array(*each).alias("c")), "hosts")
    add = [F.sum(F.col("c")[g]) for g in range(n)]
    total = hosts.agg(*add).first()
    total = np.array([x or 0.0 for x in total]) + 1.0
    everywhere = F.array(*[F.lit(float(x)) for x in total / total.sum()])
    parts = F.split("host", r"\.")
    hosts = hosts.withColumn("suffix", F.element_at(parts, -1)).withColumn(
        "domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))).otherwise(F.col("host")))
    amount = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    domains = hosts.groupBy("domain").agg(F.array(*add).alias("dc"))
    domains = domains.select("domain", _shares(F.col("dc"), amount(F.col("dc")), everywhere, strength).alias("domain_prior"))
    suffixes = hosts.filter(F.size(parts) > 1).groupBy("suffix").agg(F.array(*add).alias("sc"))
    share = amount(F.col("sc")) / float(total.sum())
    suffixes = suffixes.select("suffix", F.zip_with("sc", F.array(*[F.lit(float(x)) for x in total]), lambda c, t: F.log(
        (c + strength * share) / (t + strength))).alias("suffix_ll"))
    hosts = stage(hosts.join(domains, "domain").join(suffixes, "suffix", "left").select("host", "c", "domain_prior", "suffix_ll"), "host-priors")

    fused = base.join(broadcast_if_small(hosts, 64 + 32 * n), "host", "left")
    none = F.array_repeat(F.lit(0.0), n)
    own = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda g: F.coalesce((g == F.col("guess")).cast("double"), F.lit(0.0)))
    rest = F.zip_with(F.coalesce("c", none), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    prior = _shares(rest, amount(rest), F.coalesce("domain_prior", everywhere), strength)
    log_p = F.zip_with(F.col("ll"), prior, lambda a, p: a + F.log(p))
    log_p = F.zip_with(log_p, F.coalesce(declared_ll[F.when(F.col("declared").isNotNull(), told)], none), lambda a, b: a + b)
    log_p = F.zip_with(log_p, F.coalesce("suffix_ll", none), lambda a, b: a + b)
    fused = fused.withColumn("lp", log_p).withColumn("best", F.array_max("lp"))
    prob = 1 / F.aggregate("lp", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    fused = fused.withColumn("prob", prob)
    return fused.select(
        *names, F.element_at(codes, F.array_position("lp", F.col("best")).cast("int")).alias("lang"), "prob",
        F.when(F.col("guess").isNull(), "und").otherwise(F.element_at(codes, F.col("guess"))).alias("text_lang"), "declared", "trigrams",
        ((F.col("trigrams") > 0) & (F.col("prob") >= min_prob)).alias("accepted"))


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source", **options) -> DataFrame:
    """``docs`` without the documents whose language is not accepted; rows with a null key stay."""
    found = identify(docs, text, declared, host, [key], **options)
    return drop_ids(docs, stage(found.filter("not accepted").select(key).distinct(), "unidentified"), key)
