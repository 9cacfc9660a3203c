"""Vector codes, whitening and token files against plain versions, with the odd rows each must bear."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

from gaugeframe.llm import token_files, vector_codes, whitening
from gaugeframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, x string, code int, error string, n int, component string, key int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", 1, "e", 2, "c", 3) for i, v, c in rows], VECTORS)


def random_rows(seed, n, width=16, labels=3):
    draw = np.random.default_rng(seed)
    return [(i, [float(c) for c in draw.normal(0, 0.2, width).astype(np.float32)], int(draw.integers(labels))) for i in range(n)]


ODD = [(900, None, 1), (901, [None] + [0.1] * 15, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.0] * 15, 2), (904, [], None),
       (905, [0.5] * 7, 0)]


def plain_grid(rows, width=16):
    good = [(i, v, c) for i, v, c in rows if v and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), c) for i, v, c in good]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted(plain_grid(rows), key=lambda r: (r[0] is not None, r[0], r[1].tolist()))
    x = np.array([r[1] for r in rows])
    cut = np.split(x, parts, axis=1)
    books = [c[:entries].copy() for c in cut]

    def nearest():
        apart = [((c[:, None, :] - b[None]) ** 2).sum(2) for c, b in zip(cut, books)]
        return [a.argmin(1) for a in apart], [a.min(1) for a in apart]

    for _ in range(rounds):
        for c, b, code in zip(cut, books, nearest()[0]):
            for e in range(len(b)):
                if (code == e).any():
                    b[e] = c[code == e].sum(0) // (code == e).sum()
    codes, errors = nearest()
    error, by_label = np.sum(errors, axis=0), defaultdict(int)
    for r, e in zip(rows, error):
        by_label[r[2]] += int(e)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{c[k]:02x}" for c in codes), int(error[k]), by_label[r[2]]) for k, r in enumerate(rows)), digest


def got_codes(df):
    found, books = vector_codes.compress(df)
    return sorted((str(r.vec_id), "".join(f"{c:02x}" for c in r.code), r.error, r.label_error) for r in found.collect()), books.sha256()


@pytest.mark.parametrize("rows", [
    random_rows(1, 300) + ODD,
    random_rows(2, 20),  # fewer rows than entries
    [(k % 7, [0.25] * 16, None) for k in range(200)] + random_rows(3, 90) + [(None, [0.125] * 16, None)],  # repeats, ties, null keys
    [(k, [float(s * (k % 5)) * 1e4] * 16, 0) for k, s in zip(range(100), [1, -1] * 50)],  # far apart
])
def test_codes_equal_plain_codes(spark, rows):
    assert got_codes(vectors_of(spark, rows)) == plain_codes(rows)


def test_codes_of_nothing(spark):
    assert got_codes(vectors_of(spark, [])) == ([], hashlib.sha256(b"").hexdigest())
    assert got_codes(vectors_of(spark, ODD[:5])) == ([], hashlib.sha256(b"").hexdigest())


def test_codes_bound_far_components(spark):
    found, _ = vector_codes.compress(vectors_of(spark, [(k, [3e38 * (-1) ** k] * 16, 0) for k in range(4)] + random_rows(5, 80)))
    assert found.count() == 84 and found.filter("error < 0").count() == 0


@pytest.mark.parametrize("width", [1, 3, 4])
def test_cells_leave_out_no_nearest_entry(width):
    draw = np.random.default_rng(width)
    entries, x = draw.integers(-300, 300, (64, width)), draw.integers(-400, 400, (5000, width))
    entries[7] = entries[50]  # a tie wherever they are nearest
    apart = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    for room in (0, 10, 10_000):
        memory = vector_codes.CellMemory(entries, room=room)
        for _ in range(2):
            code, error = memory.nearest(x)
            assert (code == apart.argmin(1)).all() and (error == apart.min(1)).all()
        assert len(memory.known) <= room and memory.compared < 2 * len(x) * 20  # of 64 entries


def test_parts_that_do_not_divide_the_length():
    assert vector_codes.part_bounds(10, 4) == [(0, 3), (3, 6), (6, 8), (8, 10)]


# ---- whitening -----------------------------------------------------------------------------------------------------


def test_inertia_counts():
    draw = np.random.default_rng(4)
    for n in (1, 2, 3, 8, 31):
        for kind in range(6):
            a = draw.normal(size=(n, n))
            a = a + a.T
            if kind == 1:
                np.fill_diagonal(a, 0.0)  # needs two-rowed pivots
            if kind == 2:
                a = np.round(a)
            if kind == 3:
                a = a @ a
            if kind == 4:
                a = a * np.outer(10.0 ** draw.integers(-3, 3, n), 1) + 0
                a = a + a.T
            values = np.linalg.eigvalsh(a)
            if np.abs(values).min() > 1e-9 * np.abs(values).max():
                assert whitening.negative_count(a) == (values < 0).sum()


@pytest.mark.parametrize("values", [[9, 5, 3, 2, 1, 0.5], [4, 4, 4, 1, 1, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.3, 0.2, 0.1], [7, 0, 0, 0, 0, 0],
                                    [1e12, 1e6, 1, 1e-3, 0, 0], [0, 0, 0, 0, 0, 0], [3] * 6])
def test_spectrum_slices_find_the_leading_pairs(values):
    q, _ = np.linalg.qr(np.random.default_rng(6).normal(size=(6, 6)))
    a = (q * values) @ q.T
    spectrum = whitening.Spectrum(a)
    pairs = spectrum.leading(4)
    want = [v for v in sorted(values, reverse=True)[:4] if v > 1e-13 * max(values)]
    assert len(pairs) == len(want)
    axes = np.array([v for _, v in pairs]).reshape(len(pairs), 6)
    assert np.allclose([e for e, _ in pairs], want, rtol=0, atol=1e-13 * max(values))
    assert np.allclose(axes @ axes.T, np.eye(len(pairs)), atol=1e-12)
    for e, v in pairs:
        assert np.linalg.norm(spectrum.a @ v - e * v) <= 1e-13 * max(values)


def test_certificate_refuses_a_wrong_number():
    spectrum = whitening.Spectrum(np.diag([5.0, 3.0, 2.0]))
    assert spectrum.certified(2, 3.0) and not spectrum.certified(1, 3.0) and not spectrum.certified(2, 3.1)


def plain_whitening(rows, many=4):
    grid = plain_grid(rows)
    points = np.unique(np.array([x for _, x, _ in grid]), axis=0)
    n, sums = len(points), points.sum(0)
    centred = points - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for i, x, _ in grid:
        for k in range(many):
            out.append((i, k + 1, n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)),
                        float((x - sums / n) @ axes[:, k] / np.sqrt(values[k])), values[k] / values.sum()))
    return out


def test_whitening_equals_eigh(spark):
    rows = random_rows(8, 300) + ODD + [(5, [0.3] * 16, 1)] * 150 + [(None, [0.31] * 16, None)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    want = plain_whitening(rows)
    assert len(got) == len(want)
    order = lambda r: (r[0] is not None, r[0], r[3], r[1], abs(r[4]))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for k in range(1, 5):
        a, b = (np.array([r[4] for r in side if r[1] == k]) for side in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert np.allclose([r[5] for r in got if r[1] == k], [r[5] for r in want if r[1] == k], rtol=1e-10)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-10


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, ODD[:5])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(k, [0.5] * 16, 0) for k in range(9)])).count() == 0
    got = whitening.whiten(vectors_of(spark, [(k, [0.5 * (k % 2)] * 16, 0) for k in range(9)])).collect()
    assert [(r.vec_id, r.component, r.n) for r in sorted(got)] == [(k, 1, 2) for k in range(9)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.explained == pytest.approx(1) for r in got)


def test_deviations_are_exact_beyond_longs():
    x, n = np.array([[1 << 30, -(1 << 30)], [3, 4]]), 1 << 20
    sums = x.sum(0) * 5
    want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want]


# ---- token files ---------------------------------------------------------------------------------------------------


def plain_files(rows):
    tokenizer, at, out = Tokenizer.from_file(BYTE_BPE), 0, []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


TEXTS = [(3, "a plain line, it's short"), (-4, None), (8, ""), (9, " \n\t "), (12, "x <|endoftext|> y!"), (13, "é 日本 　 🎉  zwei  drei\r\n"),
         (20, "lorem ipsum dolor " * 4000), (21, "!")]


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, "s", 1, 2, 3) for k, t in rows], "doc_id long, text string, start string, slice int, key int, value int")


@pytest.mark.parametrize("length, file_ids", [(2048, 1 << 22), (16, 100), (7, 1), (5, 4096)])
def test_files_hold_every_document_in_order(spark, tmp_path, length, file_ids):
    path = f"{tmp_path}/files"
    token_files.write_sequences(docs_of(spark, TEXTS).repartition(5), path, BYTE_BPE, length=length, file_ids=file_ids)
    got = token_files.read_documents(spark, path, T.LongType())
    assert sorted(map(tuple, got.collect())) == plain_files(sorted(TEXTS))


def test_sequences_are_slices_of_the_mapped_file(spark, tmp_path):
    path, length = f"{tmp_path}/files", 16
    token_files.write_sequences(docs_of(spark, TEXTS).coalesce(1), path, BYTE_BPE, length=length, file_ids=1 << 20)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = [i for _, t in sorted(TEXTS) for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]]
    files = sorted((token_files.SequenceFile(str(f)) for f in (tmp_path / "files").glob("part-*") if f.stat().st_size), key=lambda f: f.order)
    got = []
    for file in files:
        for k in range(len(file)):
            ids, mask = file[k]
            assert len(ids) == len(mask) == length and ids.dtype == np.uint16
            assert not ids.flags.owndata and not ids.flags.writeable
            real = mask.true_count
            assert mask.slice(0, real).true_count == real and (real == length or k == len(file) - 1)
            got += ids[:real].tolist()
        with pytest.raises(IndexError):
            file[len(file)]
    assert got == want


def test_files_of_repeated_and_null_keys(spark, tmp_path):
    rows = [(None, "no key"), (None, "no key"), (1, "b c"), (1, "b c"), (1, "other text"), (0, "first")] + [(5, "same")] * 3000
    path = f"{tmp_path}/files"
    token_files.write_sequences(docs_of(spark, rows), path, BYTE_BPE, length=32, file_ids=1000)
    got = token_files.read_documents(spark, path, T.LongType()).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 2 + [0] + [1] * 3 + [5] * 3000
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0
    alone = {(t, n): c for (_, t), (_, _, n, c) in zip(rows, plain_files(rows))}
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((n, c) for (t, n), c in alone.items() for _ in range(sum(x[1] == t for x in rows)))


def test_files_of_nothing_and_of_text_keys(spark, tmp_path):
    token_files.write_sequences(docs_of(spark, []), f"{tmp_path}/none", BYTE_BPE)
    assert token_files.read_documents(spark, f"{tmp_path}/none", T.LongType()).count() == 0
    named = spark.createDataFrame([("b", "two"), ("a", "one")], "doc_id string, text string")
    token_files.write_sequences(named, f"{tmp_path}/text", BYTE_BPE)
    assert [(r.doc_id, r.start) for r in token_files.read_documents(spark, f"{tmp_path}/text", T.StringType()).orderBy("start").collect()] == [
        ("a", 0), ("b", 2)]


def test_chunks_give_the_ids_of_the_whole_text():
    with open(BYTE_BPE, encoding="utf-8") as file:
        spec = file.read()
    draw, ours, theirs = np.random.default_rng(9), token_files.ByteEncoder(spec), Tokenizer.from_str(spec)
    marks = [" ", "  ", "\n", "\t", "a", "Bc", "é", "1", "'s", "'", "!", "<|endoftext|>", " ", "　", "日", "🎉", "ж", "​", "\r", "\x1f",
             "\x85", "﻿", " a", " 1"]
    texts = ["".join(draw.choice(marks) for _ in range(draw.integers(0, 30))) for _ in range(3000)]
    want = [np.array(c.ids, "<u4").tobytes() for c in theirs.encode_batch_fast(texts, add_special_tokens=False)]
    assert ours.encode([t.encode() for t in texts]) == want
    assert ours.encode([t.encode() for t in texts]) == want  # from memory


def test_queries_cover_the_whole_tables(spark):
    docs, vectors = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/embeddings.parquet")
    files = QUERIES["op13_token_files"](spark, SMALL).collect()
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, files)) == plain_files(rows)
    assert QUERIES["op11_vector_codes"](spark, SMALL).count() == vectors.count()
    white = QUERIES["op12_embedding_whitening"](spark, SMALL)
    assert white.count() == 4 * vectors.count()
    assert white.agg(F.max("identity_error")).first()[0] < 1e-10
