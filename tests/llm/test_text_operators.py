"""SimHash, decontamination, licenses, packing and language id against plain versions, with the odd rows each must bear."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from gaugeframe.llm import decontam, langid, licenses, packing, simhash
from gaugeframe.llm.common import components, local_roots
from gaugeframe.llm.tokens import WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, fp int, item string, length int, c0 int"
LINE = "Released under the MIT License."


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", {}).get(i, "en"), more.get("source", {}).get(i, "s"), None, "x", 1, "y", 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["ta", "re", "mo", "lin", "ok", "su"]) for _ in range(draw.randint(1, 4))) for _ in range(words))


ODD = [(None, "no key"), (900, None), (901, ""), (902, " \n\t"), (903, "word"), (904, "é" * 3), (905, prose(5, 20_000))]


def plain_simhash(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_and_local_roots(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    want = plain_components(set(itertools.chain.from_iterable(links)), links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in x and x[0] != x[1] for x in links)}
    i, j = np.array(links).T
    assert {n: int(c) for n, c in enumerate(local_roots(500, i, j)) if n in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bk_trees_find_every_pair():
    draw = np.random.default_rng(2)
    fps = np.unique(draw.integers(0, 1 << 12, 600).astype(np.uint64))
    draw.shuffle(fps)
    shard = np.sort(draw.integers(0, 7, len(fps)))
    tree = simhash.build_trees(fps, shard)
    i, j = simhash.search_trees(fps, tree, fps, tree[0], 2, budget=500)
    want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if shard[a] == shard[b] and (int(fps[a]) ^ int(fps[b])).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("shard_rows", [4096, 8])
def test_simhash_groups(spark, shard_rows):
    base = [prose(k, 80) for k in range(12)]
    texts = list(enumerate(base + [t + " tail" for t in base[:6]] + [t.upper() for t in base[:3]] + base[:2]))
    texts += [(300 + k, prose(77, 400) + f" {k}") for k in range(60)] + ODD
    rows = docs_of(spark, texts + [texts[3]])
    got = simhash.near_duplicates(rows, shard_rows=shard_rows).collect()
    fps = [plain_simhash(t) for _, t in texts]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    comp = plain_components(range(len(fps)), links)
    first = {}
    for n, c in comp.items():
        if texts[n][0] is not None:
            first[c] = min(first.get(c, 1 << 60), texts[n][0])
    want = sorted((str(texts[n][0]), fps[n], first.get(c)) for n, c in comp.items()) + [(str(texts[3][0]), fps[3], first[comp[3]])]
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == sorted(want)
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def distance_inside(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(item):
            new.append(min(row[k] + (p != c), row[k + 1] + 1, new[k] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_decontamination_against_edit_distance(spark):
    draw = random.Random(4)
    items = [(k, prose(100 + k, draw.randint(8, 25))) for k in range(8)] + [(50, None), (51, ""), (52, "tiny"), (0, prose(100, 12))]
    texts = []
    for n in range(60):
        held = list(decontam.normalise(items[n % 8][1]))
        for _ in range(draw.randrange(9)):
            at = draw.randrange(len(held))
            draw.choice([lambda: held.pop(at), lambda: held.insert(at, "x"), lambda: held.__setitem__(at, "q")])()
        texts.append((n, prose(n, 30) + "\n" + "".join(held).upper().replace(" ", "  ") + " " + prose(n + 500, 30)))
    texts += [*ODD, (70, "so tiny a thing"), texts[0]]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    rows = docs_of(spark, texts)
    got = decontam.find_leaks(rows, bench, block_chars=400).collect()
    want = []
    for key, text in texts:
        text = decontam.normalise(text)
        for item, own in items:
            own = decontam.normalise(own)
            if own and len(text) < 5000:
                d = distance_inside(own, text)
                if d <= decontam.edit_budget(len(own), 0.06, 16):
                    want.append((str(key), item, d))
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in got) == sorted(want) and want
    for r in got:
        text = next(decontam.normalise(t) for k, t in texts if k == r.doc_id)[r.start_char:r.end_char]
        assert r.distance in {distance_inside(decontam.normalise(t), text) for k, t in items if k == r.item_id and t}
    left = decontam.decontaminate(rows, bench)
    assert left.columns == rows.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(k) for k, _ in texts if str(k) not in {w[0] for w in want})
    assert decontam.find_leaks(rows, bench.limit(0)).count() == 0 and decontam.find_leaks(rows.limit(0), bench).count() == 0


@pytest.mark.parametrize("words", [12, 14, 40])
def test_reworded_items_are_found(words):
    long = ["unlikelihoods", "zebra", "kitchengarden", "boy", "quixoticness"]
    draw = random.Random(words)
    for seed in range(6):
        item = prose(1000 + seed, words).split()
        matcher = decontam.Matcher([(7, " ".join(item))], 0.06, 16)
        for many in (1, 2):
            for how in ("replace", "drop", "insert"):
                held = list(item)
                for at in sorted(draw.sample(range(words), many), reverse=True):
                    held[at: at + 1] = {"replace": [draw.choice(long)], "drop": [], "insert": [held[at], draw.choice(long)]}[how]
                found = list(matcher.find(decontam.normalise(prose(seed, 40) + " " + " ".join(held) + ". " + prose(seed + 90, 40))))
                assert [hit[0] for hit in found] == [7], (how, many)
        other = prose(seed + 5000, 400)
        assert not list(matcher.find(other))


def test_license_windows_against_sets(spark):
    long_text = licenses.TEMPLATES[1][1]
    cut = long_text.split()
    broken = " ".join(cut[:40] + ["other"] + cut[41:])  # loses five shingles of some hundred
    spoiled = " ".join(w if k % 6 else "other" for k, w in enumerate(cut))  # loses nearly all
    texts = [(0, prose(1, 300) + " " + long_text + " " + prose(2, 100)), (1, prose(3, 50) + "\n" + broken), (2, spoiled), (3, LINE.upper()),
             (4, "released, under the: MIT license"), (5, "under the MIT License"), (6, f"{prose(4, 7)} {LINE} {prose(5, 9)} {LINE}"), *ODD]
    got = {(str(r.doc_id), r.template): r for r in licenses.find_licenses(docs_of(spark, texts)).collect()}

    def holds(text, which):
        words = licenses.words_of((text or "").encode())
        grams, sought = licenses.shingles_of(words), set(licenses.shingles_of(licenses.words_of(licenses.TEMPLATES[which][1].encode())))
        step = 1 << max(0, len(sought) - 1).bit_length()
        shares = [len(sought & set(grams[a:a + 2 * step])) / len(sought) for a in range(0, max(1, len(grams)), step)]
        return max(shares)

    for key, text in texts:
        for which in range(len(licenses.TEMPLATES)):
            share = holds(text, which)
            assert ((str(key), which) in got) == (share >= 0.8)
            if share >= 0.8:
                assert got[str(key), which].containment == pytest.approx(share)
    assert ("1", 1) in got and ("2", 1) not in got and ("6", 0) in got and got["3", 0].first_word == 0
    assert licenses.find_licenses(docs_of(spark, texts).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates([("x", "too short")], 0.8)


def test_every_template_is_told_by_its_own_name(spark):
    texts = [(k, f"{prose(k, 60)} {text} {prose(k + 500, 80)}") for k, (_, text) in enumerate(licenses.TEMPLATES)]
    got = {}
    for r in licenses.find_licenses(docs_of(spark, texts)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {k: {name} for k, (name, _) in enumerate(licenses.TEMPLATES)}


def near_pairs():
    """Templates of different licenses that one text could be taken for both of."""
    grams = [set(licenses.shingles_of(licenses.words_of(t.encode()))) for _, t in licenses.TEMPLATES]
    return [(a, b) for a, (n, _) in enumerate(licenses.TEMPLATES) for b, (m, _) in enumerate(licenses.TEMPLATES)
            if n != m and len(grams[a] & grams[b]) >= 0.8 * len(grams[b])]


def test_near_equal_notices_are_told_apart(spark):
    pairs = near_pairs()
    names = [n for n, _ in licenses.TEMPLATES]
    assert {("GPL-2.0", "GPL-3.0"), ("AGPL-3.0", "GPL-3.0"), ("LGPL-3.0", "LGPL-2.1")} <= {(names[a], names[b]) for a, b in pairs}
    text = lambda k: licenses.TEMPLATES[k][1]
    rows = [(2 * n, f"{prose(n, 90)} {text(a)} {prose(n + 99, 30)}") for n, (a, b) in enumerate(pairs)]
    rows += [(2 * n + 1, f"{text(a)} {text(b)}") for n, (a, b) in enumerate(pairs)]  # both, one after the other
    got = {}
    for r in licenses.find_licenses(docs_of(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    for n, (a, b) in enumerate(pairs):
        assert got[2 * n] == {names[a]}
        assert got[2 * n + 1] == {names[a], names[b]}


def test_word_encoder_equals_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        own = WordEncoder(file.read())
    draw = random.Random(3)
    letters = "aE'sé ÉßÀ÷.,!#\n\t́ «»1٣日\x1c\x00\x0b\x85ñKİΣς'tdmre<|>"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(4000)]
    texts += ["", "It's 'tis x's,we'll!? <|endoftext|>x ﬁ Ω Å日本語、テスト。", prose(1, 3000)]
    for text, code, ids in zip(texts, own.tokenizer.encode_batch(texts, add_special_tokens=False), own.encode([t.encode() for t in texts])):
        assert np.array(code.ids, "<u4").tobytes() == ids, text


def test_added_tokens_have_the_ids_of_the_unchanged_tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), WordEncoder(open(path, encoding="utf-8").read())
    texts = ["a <|startoftext|>b<|endoftext|> c", "<|endoftext|>", "<|ENDOFTEXT|> x", "plain words", "it's<|endoftext|>é\n<|endoftext"]
    for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == ids, text
    assert 49407 in np.frombuffer(own.encode([texts[0].encode()])[0], "<u4")


def test_best_fit_is_tight_and_legal():
    draw = np.random.default_rng(5)
    for lengths in (draw.integers(1, 4095, 3000), np.full(100, 2049), np.full(64, 64), np.array([], int)):
        bins, offsets, used = packing.best_fit(lengths, 4096)
        assert used.max(initial=0) <= 4096 and np.array_equal(np.bincount(bins, lengths, len(used)).astype(int), used)
        by = np.lexsort((offsets, bins))
        ends = offsets[by] + lengths[by]
        assert all(offsets[by][k] == (ends[k - 1] if bins[by][k] == bins[by][k - 1] else 0) for k in range(1, len(by)))


@pytest.mark.parametrize("per_task", [100_000, 40])
def test_packing(spark, per_task, monkeypatch):
    texts = [(k, prose(k, random.Random(k).choice([1, 5, 60, 700, 2500]))) for k in range(150)] + ODD + [(3, prose(3, 60))]
    path = public_tokenizers.path("word_bpe_49k.json")
    place = packing.place
    monkeypatch.setattr(packing, "ITEMS", per_task)
    monkeypatch.setattr(packing, "place", lambda items, size, slack: place(items, size, slack, per_task))
    got = packing.pack(docs_of(spark, texts).repartition(5), path).withColumn("ids_crc32", F.crc32("ids"))
    rows = got.collect()
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(path)
    want = []
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4").tobytes()
            want.append((str(key), k // 4096, k, len(part) // 4, zlib.crc32(part)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    total = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == total.get(r.sequence_id, 0)
        total[r.sequence_id] = r.offset + r.length
    assert max(total.values()) <= 4096
    at_once = len(packing.best_fit(np.array([w[3] for w in want]), 4096)[2])  # all pieces best-fit in one place
    assert len(total) <= at_once + 3
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert {s: len(ids) // 4 for s, ids in whole.items()} == total
    assert packing.pack(docs_of(spark, texts).limit(0), path).count() == 0


WORDS = {"en": "the and of with that this house water people because", "fr": "le la avec pour cette maison eau gens parce que",
         "de": "der und mit für dieses haus wasser leute weil nicht"}


def test_language_evidence(spark):
    draw = random.Random(9)
    texts, lang, source = [], {}, {}
    for k in range(240):
        code = ["en", "fr", "de"][k % 3]
        texts.append((k, " ".join(draw.choice(WORDS[code].split()) for _ in range(draw.randint(3, 60)))))
        lang[k], source[k] = code, f"http://{code}{k % 2}.site.{'com' if code == 'en' else code}/x"
    texts += [(500, "zzzz qqqq"), (501, "zzzz qqqq"), (502, "xx"), (503, None), (504, ""), (505, texts[1][1]), (None, texts[2][1]), (0, texts[0][1])]
    lang |= {500: None, 501: "fr-CA", 502: "de", 503: "de", 504: None, 505: "de"}
    source |= {500: "http://de0.site.de", 501: None, 502: "nonsense", 503: "http://de0.site.de", 504: None, 505: "http://fr0.site.fr"}
    rows = docs_of(spark, texts, lang=lang, source=source).withColumn("host", langid.host_of(F.col("source")))
    got = {r.doc_id: r for r in langid.identify(rows, declared="lang", carry=["doc_id"]).collect()}
    assert langid.identify(rows, declared="lang", carry=["doc_id"]).count() == len(texts)
    assert all(got[k].lang == ["en", "fr", "de"][k % 3] and got[k].accepted for k in range(240))
    assert got[500].lang == "de"  # the host speaks
    assert got[501].lang == "fr"  # the declaration speaks
    assert got[505].lang == "fr"  # text and host against the declaration
    assert [(got[k].text_lang, got[k].accepted) for k in (502, 503, 504)] == [("und", False)] * 3
    kept = langid.keep_identified(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {k for k, _ in texts} - {502, 503, 504}
    none = langid.identify(rows.withColumn("lang", F.lit(None).cast("string")), declared="lang", carry=["doc_id"]).collect()
    assert len(none) == len(texts) and {r.lang for r in none} == {"und"}
    assert langid.identify(rows.limit(0), declared="lang", carry=["doc_id"]).count() == 0


def test_every_declared_language_is_told_apart(spark):
    codes = [a + b for a in "abcdefg" for b in "klmnopqrst"]  # 70, one of them rarer than the others
    texts = [(k, " ".join([codes[k % 70] * 3, codes[k % 70] + "x" + codes[k % 70]] * 10)) for k in range(209)]
    rows = docs_of(spark, texts, lang={k: codes[k % 70] for k, _ in texts}).withColumn("host", F.lit(None).cast("string"))
    got = {r.doc_id: (r.lang, r.text_lang) for r in langid.identify(rows, declared="lang", carry=["doc_id"]).collect()}
    assert got == {k: (codes[k % 70],) * 2 for k, _ in texts}


def test_trigram_counts_stay_within_rows():
    import pyarrow as pa
    texts = ["abcd", "", "x", "yz", None, "ABC", "é"]
    found = list(langid._trigrams(pa.array(texts)))
    rows = np.concatenate([first + row for first, _, _, row in found])
    assert np.bincount(rows, minlength=7).tolist() == [2, 0, 0, 0, 0, 1, 0]
    buckets = np.concatenate([b for _, _, b, _ in found])
    assert buckets[0] == buckets[2]  # abc and ABC


def test_markup_and_address(spark):
    page = "<html class=a lang='fr-CA'><script>lang</script><p>bon<b>jour</b>"
    rows = spark.createDataFrame([(page, "HTTPS://u:p@WWW.a.Fr:80/x"), ("<p>", "mailto:x"), (None, None)], "html string, url string")
    got = rows.select(langid.markup_language(F.col("html")).alias("l"), langid.host_of(F.col("url")).alias("h"),
                      langid.visible_text(F.col("html")).alias("t")).collect()
    assert [r.l for r in got] == ["fr-CA", None, None] and [r.h for r in got] == ["www.a.fr", None, None]
    assert got[0].t.split() == ["bon", "jour"]


@pytest.mark.parametrize("hot_rows", [0, 5, 1024])
def test_joins_of_hot_groups(spark, hot_rows):
    from gaugeframe.llm.common import join_groups
    from gaugeframe.staging import stage
    rows = stage(spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 97).alias("g")), "rows")
    groups = rows.groupBy("g").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    got = join_groups(rows, groups, "g", "least", hot_rows)
    assert got.columns == ["g", "id", "least"] and got.count() == 2000
    want = {r.g: r.least for r in groups.collect()}
    assert all(r.least == want[r.g] for r in got.collect())


def test_component_of_half_of_all_nodes(spark):
    links = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(10_000, 10_300, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(3000)}, **{n: k for k in range(10_000, 10_300, 3) for n in (k, k + 1)}}
