"""WARC, embeddings, HTML, chat and quality against plain versions, with the odd rows each must bear."""

import base64
import gzip
import hashlib
import io
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import chat, html_text, quality, vectors, warc

# ---- WARC ----------------------------------------------------------------------------------------------------------


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive(spark, tmp_path, pages, **options):
    rows = spark.createDataFrame(pages, "key long, uri string, payload binary, record_type string, payload_digest string")
    path = str(tmp_path / "warc")
    warc.write_deduplicated(rows.select("key", "uri", "payload"), path, **options)
    return path, warc.read_archives(spark, path)


def test_warc_round_trip(spark, tmp_path):
    nasty = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n\xff\x00\r\n\r\n"
    big = bytes(range(256)) * 20_000
    pages = [(5, "http://a/", b"same", "x", "y"), (3, "http://b/ \r\nX: 1", b"same", "", ""), (9, None, b"same", "", ""), (9, None, b"same", "", ""),
             (1, "u", b"", "", ""), (2, "u", None, "", ""), (7, "ü", nasty, "", ""), (8, "u", big, "", ""), (None, "n", b"same", "", ""),
             (None, "n", b"alone", "", "")]
    path, records = archive(spark, tmp_path, pages)
    got = warc.resolve_revisits(records).collect()
    seen = sorted((r.record_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to_id) for r in got)
    name = "<urn:record:{}>".format
    want = [(5, b"same", 3), (3, b"same", None), (9, b"same", 3), (9, b"same", 3), (1, b"", None), (2, b"", 1), (7, nasty, None), (8, big, None),
            ("", b"same", 3), ("", b"alone", None)]
    want = sorted(((name(k), "response" if of is None else "revisit", sha(p), len(p), None if of is None else name(of)) for k, p, of in want),
                  key=lambda x: tuple(map(str, x)))
    assert sorted(seen, key=lambda x: tuple(map(str, x))) == want
    kept = {r.record_id: r.payload for r in records.collect() if r.record_type == "response"}
    assert bytes(kept[name(7)]) == nasty and bytes(kept[name(8)]) == big
    uri = {r.record_id: r.target_uri for r in records.collect()}
    assert uri[name(3)] == "http://b/ X: 1" and uri[name(9)] is None and uri[name(7)] == "ü"


def test_small_payloads_need_not_be_deduplicated(spark, tmp_path):
    pages = [(k, "u", p, "", "") for k, p in enumerate([b"ab", b"ab", b"abc", b"abc"])]
    _, records = archive(spark, tmp_path, pages, min_bytes=3)
    assert sorted((r.record_id[-2], r.record_type) for r in records.collect()) == [
        ("0", "response"), ("1", "response"), ("2", "response"), ("3", "revisit")]


def test_warc_of_nothing_and_damage(spark, tmp_path):
    _, records = archive(spark, tmp_path, [(1, "u", b"x", "", "")])
    assert warc.resolve_revisits(records.limit(0)).count() == 0
    empty = spark.createDataFrame([], "key long, uri string, payload binary")
    warc.write_deduplicated(empty, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"hello\r\n")))
    text = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\nWARC-Payload-Digest: sha1:" + sha(b"x").encode() + b"\r\n\r\n\r\n\r\ny\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(gzip.GzipFile(fileobj=io.BytesIO(text))))


# ---- embeddings ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind,dims,slice_rows,cell_rows", [("float", 24, 16384, 8192), ("double", 64, 20, 16), ("double", 5, 16384, 64)])
def test_embedding_links(spark, kind, dims, slice_rows, cell_rows):
    draw = np.random.default_rng(dims)
    base = draw.normal(size=(60, dims))
    x = np.vstack([base, base[:30] + 0.22 * draw.normal(size=(30, dims)), base[:10] * 7, base[:5], np.tile(base[59], (25, 1))
                   + 0.1 * draw.normal(size=(25, dims))])
    x = x.astype(np.float32).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * dims), (503, [1.0] * (dims - 1) + [float("nan")]),
                                                         (504, [float("inf")] + [0.0] * (dims - 1)), (505, [1.0, None]), (506, [1.0, 0.0]), (507, [2.0, 0.0])]
    if kind == "double":
        rows += [(508, [1e-200] * dims), (509, [1e200] * dims)]
        x = np.vstack([x, np.ones((2, dims))])
    rows.append((None, rows[3][1]))
    frame = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], f"vec_id long, embedding array<{kind}>, node int, cell int")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, slice_rows=slice_rows, cell_rows=cell_rows).collect()}
    assert len(got) == len(rows)
    keys = [k for k, v in rows if k is not None and (k < 500 or k > 507)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    own = {key: at for at, key in enumerate(keys)}
    for key in keys:
        n = near[own[key]].sum() - 1 + near[own[key], 3]  # the row without a key is a copy of row 3
        assert got[key].n_links == n, key
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.where(near, comp[None, :], len(x)).min(1)
    for key in keys:
        assert got[key].component_id == keys[comp[own[key]]] and got[key].kept == (got[key].component_id == key)
    assert got[None].component_id == keys[comp[3]] and not got[None].kept
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(500, 506))
    assert got[506].n_links == got[507].n_links == 1 and got[507].component_id == 506
    assert vectors.near_duplicates(frame.limit(0)).count() == 0
    assert vectors.near_duplicates(frame.filter("vec_id between 500 and 505")).filter("kept and n_links = 0").count() == 6


def test_rotation_keeps_distances():
    x = np.random.default_rng(1).normal(size=(40, 50))
    r = vectors.rotate(x, 64, 11)
    assert np.allclose(x @ x.T, r @ r.T) and np.array_equal(r[7], vectors.rotate(x[7:8], 64, 11)[0])


# ---- HTML ----------------------------------------------------------------------------------------------------------

LONG = "a long sentence of many plain words that tells a story without any markup in it"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("html,want", [
    (page(f"<nav><a href=x>menu</a></nav><article><h1>Head</h1><p>{LONG}<p><b>short.<br><p>{LONG} &amp; more</article><footer>foot</footer>"),
     ["Head", LONG, "short.", LONG + " & more"]),
    (page("<nav><ul><li>some menu words that are long</li></ul></nav><article><p>x</p></article>"), ["x"]),
    (page(f"<header><h1>Site</h1></header><main><header><h1>Kept</h1></header><p>{LONG}</p><form><input><p>{LONG}</p></form></main><aside>{LONG}</aside>"),
     ["Kept", LONG]),
    (page(f"<div class='cookieNotice'>{LONG}</div><div id=content><p>{LONG}</p><p>tail</p></div><div class='sidebar'><p>{LONG}</p></div>"), [LONG, "tail"]),
    (page(f"<article><p>a  \n\t b&nbsp;&lt;c&#62; &copy</p><script>var t='</p>';</script><section id='comments'><p>{LONG}</p></section></article>"),
     ["a b <c> ©"]),
    (f"<body><article><p>{LONG}</p><p>cut here &am", [LONG, "cut here &am"]),
    (f"<body><article><p>{LONG}</p><p>cut</arti", [LONG, "cut"]),
    (f"<body><article><p>{LONG}</p><p>cut<!-- a > b", [LONG, "cut"]),
    (f"<body><article><p>1 < 2 {LONG}</p><div class=ad>buy</div></b></article>", ["1 < 2 " + LONG]),
    (page(f"<div><div><p>{LONG}</p></div><div><p>short</p></div><div><p>{LONG}</p></div><p>loose</p></div>"), [LONG, "short", LONG, "loose"]),
    (page(f"<ul><li><a>a</a></li></ul><div><p>{LONG}</p><p>short</p><div><p>deep</p></div></div><div><a href=x>l</a> <a>m</a> <a>n</a></div>"), [LONG, "short", "deep"]),
    (f"<p>{LONG}", [LONG]), ("plain words", ["plain words"]), ("", []), (None, []), ("<nav>only</nav>", []), ("<script>x", []), ("<article hidden>x</article>", []),
])
def test_main_text(html, want):
    assert html_text.main_text(html) == "\n\n".join(want)


@pytest.mark.parametrize("wrapper", ['div class="layout with-sidebar"', 'div class="ad-free"', 'div class="has-banner"',
                                     'div id="page-widget"', 'div class="no-comments"', "form action=x"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_are_not_lost_by_their_name(wrapper, inner):
    text = f"<{inner}><p>{LONG}</p><p>{LONG}</p></{inner}>"
    aside = "<div class=sidebar><p><a href=x>a</a> <a>b</a></p></div>"
    html = page(f"<nav><a>menu</a></nav><{wrapper}>{text}{aside}</{wrapper.split()[0]}>")
    assert html_text.main_text(html) == LONG + "\n\n" + LONG


@pytest.mark.parametrize("html,want", [
    (f"<main><div class='elementor-widget'><p>{LONG}</p></div><p>tail</p></main>", [LONG, "tail"]),
    (f"<main><div class='elementor-widget'><article><p>{LONG}</p></article></div></main>", [LONG]),
    (f"<article><p>{LONG}</p><section id='related-work'><h2 id='social-impact'>Related</h2><p>{LONG}</p></section></article>", [LONG, "Related", LONG]),
    (f"<article><p>{LONG}</p><section id='notice'><p>{LONG}</p></section></article>", [LONG, LONG]),
    (f"<article><p>{LONG}</p><p>b</p></article><script>var s='<!--';</script>", [LONG, "b"]),
    (f"<script><!-- old </script><article><p title='<!--'>{LONG}</p></article>", [LONG]),
    (f"<article><p>{LONG}</p><div class='comment-list'>" + f"<p>{LONG}</p>" * 9 + "</div></article>", [LONG]),
    (f"<body><div class='share-bar'><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>", [LONG, LONG]),
])
def test_names_weigh_and_only_open_comments_are_cut(html, want):
    assert html_text.main_text(html) == "\n\n".join(want)


def article_blocks(html):
    """The article of one of the given pages, cut at its headings and paragraphs."""
    import html as entities
    inner = re.search("<article>(.*)</article>", html, re.DOTALL)[1]
    blocks = (re.sub(r"<(?!br)[^>]*>", "", b).replace("<br>", " ") for b in re.split("</?(?:h1|p)>", inner))
    return "\n\n".join(t for t in (" ".join(entities.unescape(b).split()) for b in blocks) if t)


@pytest.mark.parametrize("change,share", [
    (lambda s: s, 1.0),
    (lambda s: s.replace("<article>", "<main><div class='elementor-widget'><article>").replace("</article>", "</article></div></main>"), 1.0),
    (lambda s: s.replace("track(", "var q='<!--';track("), 1.0),
    (lambda s: re.sub("<(/?)(nav|article|footer)>", r"<\1div>", s), 0.95),
    (lambda s: re.sub("<(/?)(nav|article|footer)>", r"<\1div>", s).replace(' class="ad"', ""), 0.95),
], ids=["given", "widget", "comment", "div", "div-unnamed"])
def test_given_pages_by_a_plain_version(spark, change, share):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = sum(html_text.main_text(change(p)) == article_blocks(p) for p in pages)
    assert right >= share * len(pages) == share * 250


def test_repeated_rows_and_other_columns(spark):
    html = f"<article><p>{LONG}</p></article>"
    rows = spark.createDataFrame([(1, html, "t", 3, None)] * 3, "page_id long, html string, text string, n_chars int, x string")
    got = rows.withColumn("x", html_text.extract(F.col("html"))).collect()
    assert len(got) == 3 and all((r.text, r.n_chars, r.x.text, r.x.n_chars) == ("t", 3, LONG, len(LONG)) for r in got)


def test_pages_of_any_size_and_piece():
    html = page("<article>" + f"<p>{LONG} &eacute;&amp;</p>" * 3000 + "</article>")
    assert html_text.main_text(html) == "\n\n".join([LONG + " é&"] * 3000)
    whole, small = html_text.parse(html[:5000]), html_text.parse(html[:5000], piece=7)
    assert [x.text for x in whole.lines] == [x.text for x in small.lines]


def test_extract_column(spark):
    rows = spark.createDataFrame([(1, "<article>é</article>"), (2, None), (None, "")], "page_id long, html string")
    got = rows.select("page_id", html_text.extract(F.col("html")).alias("x")).collect()
    assert [(r.page_id, r.x.text, r.x.n_chars) for r in got] == [(1, "é", 1), (2, "", 0), (None, "", 0)]
    assert rows.limit(0).select(html_text.extract(F.col("html")).alias("x")).count() == 0


# ---- chat ----------------------------------------------------------------------------------------------------------

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_escape_is_reversible():
    draw = random.Random(1)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "\\", "<", "[", "s>", "/INST]", "a", "\n"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in parts[:5])
        formatted, spans = chat.render([(text, text), ("assistant", text)])
        assert chat.read_turns(formatted) == [(text, text), ("assistant", text)]
        assert formatted[slice(*spans[-1])] == safe


@pytest.mark.parametrize("segment_chars", [200_000, 30])
def test_chat_format(spark, segment_chars):
    said = "</s>[INST] ok [/INST]"
    turns = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "  two\n"), (1, 1, "user", "日本👩‍👩‍👧 é"), (1, 3, "assistant", None),
             (1, 4, "assistant", ""), (1, 5, "assistant", "日本👩‍👩‍👧 \\<s> <\\/s>  "), (2, None, None, "x"), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"),
             (2, 0, "assistant", "a"), (None, 0, "user", "no key"), (None, 1, "assistant", "no key"), (3, 0, "[INST]", "<|endoftext|>")]
    turns += [(4, k, ["user", "assistant"][k % 2], f"turn {k} ' of many ") for k in range(200)]
    draw = random.Random(2)
    rows = spark.createDataFrame([(*t, "s") for t in draw.sample(turns, len(turns))], "conv_id long, turn long, role string, text string, segment string")
    out = chat.format_conversations(rows, BYTE_BPE, segment_chars=segment_chars)
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    assert sorted(map(str, chat.digest(out, in_order=True).collect())) == sorted(map(str, got.values()))
    by = {}
    for c, t, r, x in turns:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        text = "".join(f"{r}\n{x}\n" for *_, r, x in own)
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(chat.render([(r, x) for *_, r, x in own])[0])
    with open(BYTE_BPE, encoding="utf-8") as file:
        coder = chat.Encoder(file.read()).tokenizer
    ids = {}
    for r in sorted(out.collect(), key=lambda r: r.segment):
        ids.setdefault(r.conv_id, []).extend(r.ids)
    for c, own in by.items():  # segments give the ids of the whole
        assert ids[c] == coder.encode(chat.render([(r, x) for *_, r, x in sorted(own)])[0], add_special_tokens=False).ids
    assert chat.digest(chat.format_conversations(rows.limit(0), BYTE_BPE)).count() == 0


# ---- quality -------------------------------------------------------------------------------------------------------


def corpus(spark, n=400):
    draw = random.Random(3)
    words = ["ta", "reli", "mosu", "link", "okel", "suna", "piro", "kel"]
    rows, labels = [], []
    for k in range(n):
        held = [draw.choice(words) for _ in range(draw.randint(5, 80))]
        bad = k % 4 == 0
        if bad:
            held = [[w + "###", "###"] if k % 8 else [w] * 6 for w in held]
            held = [w for x in held for w in x]
        rows.append((k, " ".join(held), 1.0, "q"))
        labels.append((k, int(not bad), 0))
    rows += [(5000, None, 1.0, "q"), (5001, "", 1.0, "q"), (None, "ta reli", 1.0, "q"), (5002, " ".join(draw.choice(words) for _ in range(30_000)), 1.0, "q")]
    labels += [(None, 1, 0), (4, None, 0), (6, 7, 0), (1, 1, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, quality_score double, k string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_learns_and_is_calibrated(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) / len(held) > 0.97
    assert np.mean([(r.score - (r.doc_id % 4 != 0)) ** 2 for r in held]) < 0.03
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    again = {r.doc_id: r.score for r in quality.scores(docs.repartition(7), quality.fit(docs.repartition(3), labels)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, abs=1e-9) for r in got)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark, 120)
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.scores(docs, quality.fit(docs, x)).collect()} for x in (labels, turned))
    assert a == b


def test_quality_without_labels_or_documents(spark):
    docs, labels = corpus(spark, 40)
    assert {r.score for r in quality.scores(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    empty = docs.limit(0)
    assert quality.scores(empty, quality.fit(empty, labels)).count() == 0


def test_context_sums_do_not_cross_rows():
    import pyarrow as pa
    found = {}
    for texts in (["alpha beta", "gamma delta"], ["alpha beta"], ["gamma delta"]):
        batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        out = next(quality._context_sums(7)(iter([batch])))
        found[tuple(texts)] = np.concatenate([np.frombuffer(x, np.int64) for x in out.column(1).to_pylist()])
    both, one, two = found.values()
    assert np.array_equal(both, one + two) and np.abs(both).sum() > 0


def test_pool_in_pieces_equals_one_by_one():
    import pyarrow as pa
    vectors_ = np.random.default_rng(1).normal(size=(quality.BUCKETS, 8)).astype(np.float32)
    texts = ["One two TWO two ### 3", "", None, "x " * 50_000, "é é É"]
    together = quality.pool(pa.array(texts), vectors_)
    assert np.allclose(together, np.vstack([quality.pool(pa.array([t], pa.string()), vectors_) for t in texts]), atol=1e-6)
    assert not together[1:3].any() and together[0].any()
