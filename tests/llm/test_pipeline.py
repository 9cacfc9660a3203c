"""The pipeline stage by stage on the small tables, and the operator queries' contracts."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from gaugeframe.staging import stage

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], FOLDER), name))
    return out


def ids(frame):
    return {r.doc_id for r in frame.select("doc_id").collect()}


def test_stages_keep_columns_and_whole_documents(stages):
    texts = {r.doc_id: r for r in stages[0].collect()}
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns
        assert all(texts[r.doc_id] == r for r in frame.collect())
    assert all(ids(b) <= ids(a) for a, b in zip(stages, stages[1:]))
    assert ids(stages[-1]) == ids(stages[-2])


def test_quality_stage_drops_junk(stages):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet'").fetchall())
    kept = ids(stages[1])
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert np.mean(right) > 0.97


def test_language_stage_keeps_texts_with_letters(stages):
    assert ids(stages[1]) - ids(stages[2]) <= {r.doc_id for r in stages[1].collect() if len(r.text or "") < 8}


def test_near_dedup_stage_leaves_one_of_each_group(spark, stages):
    from test_text_operators import plain_components, plain_simhash

    rows = sorted((r.doc_id, plain_simhash(r.text)) for r in stages[2].collect())
    fps = np.array([f for _, f in rows], np.uint64)
    near = [(a, int(b)) for a in range(len(rows)) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 4)]
    comp = plain_components(range(len(rows)), near)
    assert ids(stages[3]) == {rows[n][0] for n, c in comp.items() if n == c}


def test_decontamination_stage_drops_leaks_only(stages):
    items = [re.sub(r"\s+", " ", t.lower()) for t, in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    holds = lambda r: any(i in re.sub(r"\s+", " ", r.text.lower()) for i in items)
    exact = {r.doc_id for r in stages[3].collect() if holds(r)}
    gone = ids(stages[3]) - ids(stages[4])
    assert exact and exact <= gone and len(gone - exact) <= 3


def test_packing_stage_is_tight(stages):
    rows = stages[5].collect()
    total = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert max(total.values()) <= 4096 and len(total) <= -(-sum(total.values()) // 4096) + 2


def test_run_and_registration(spark):
    assert driver.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001/").count() > 0
    assert sorted(n for n in driver.queries() if re.match(r"op\d+_", n)) == sorted(set(
        n for n in driver.queries() if re.match(r"op([1-9]|1[0-3])_", n)))
    assert len([n for n in driver.queries() if re.match(r"op\d+_", n)]) == 13


@pytest.mark.parametrize("name,columns", [
    ("op1_", "page_id payload_bytes payload_digest record_type refers_to"), ("op3_", "doc_id piece start length ids_crc32 sequence_id offset"),
    ("op4_", "doc_id fingerprint component_id"), ("op5_", "vec_id n_links component_id kept"), ("op7_", "page_id url text n_chars"),
    ("op9_", "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"), ("op10_", "doc_id held_out score predicted"),
    ("op11_", "vec_id code error label_error codebooks_sha256"), ("op13_", "doc_id start n_tokens ids_crc32"),
    ("op12_", "vec_id component n deviation whitened explained identity_error")])
def test_contract_columns(spark, name, columns):
    query = next(q for n, q in driver.queries().items() if n.startswith(name))
    assert set(columns.split()) <= set(query(spark, "/root/testdata/sf0.001").columns)


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp int, component_id string, Quality_Score string"


def odd_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    long = " ".join(texts)[:200_000]
    rows = [(i, t, "en", "s", None, 0.5, 1, "c", "q") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None, None, None, None, None), (None, None, "de", "s", 3, 0.1, 2, "d", "r")]
    rows += [(900, None, "en", "s", 0, 0.5, 1, "c", "q"), (901, "", "en", None, 0, 0.5, 1, "c", "q"), (902, long, "fr", "t", 9, 0.5, 1, "c", "q")]
    return spark.createDataFrame(rows + rows[5:8] * 2, ODD_SCHEMA)


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, name, step):
    docs = stage(odd_documents(spark), "odd")
    got = step(spark, docs, FOLDER)
    if name != "best_fit_packing":
        assert got.columns == docs.columns
        before, after = [sorted(map(str, f.collect())) for f in (docs, got)]
        assert set(after) <= set(before) and all(after.count(r) == before.count(r) for r in set(after))
    else:
        pieces = got.groupBy("doc_id", "start").count().collect()
        assert sum(r["count"] for r in pieces if r.start == 0) == docs.count()
        assert got.filter("doc_id = 901").first().length == 1
    if name not in ("quality_classifier", "best_fit_packing"):
        assert got.filter("doc_id is null").count() == 2
    assert step(spark, docs.limit(0), FOLDER).count() == 0
