"""Joins, repeats, searches and pages against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from evigrid.llm import ann, components, hamming, pages, partenum, repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, key int, n int"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def joined(texts, num, den, k):
    """component per position, by comparing all pairs."""
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def variants(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, 300]))) for _ in range(12)]
    out = ["", None, "   ", "One", "one", "one two", "One  TWO", *base]
    while len(out) < n:
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("num,k", [(85, 4), (80, 5)])
def test_join_loses_no_link(spark, num, k):
    texts = variants(num)
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = {r["doc_id"]: r for r in partenum.jaccard_join(docs, partenum.Threshold(num, 100, k)).collect()}
    want, sizes = joined(texts, num, 100, k)
    assert [out[i]["component_id"] for i in range(len(texts))] == want
    assert [out[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_join_of_an_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "", "", 0, "", 1, 2)] * 3 + [(None, "a b c d e f", "", "", 0, "", 1, 2)], SCHEMA)
    assert partenum.jaccard_join(docs.limit(0)).count() == 0
    assert [(r["doc_id"], r["component_id"]) for r in partenum.jaccard_join(docs).collect()].count((5, 5)) == 3
    kept = partenum.one_of_each(docs, partenum.Threshold(), keep=("doc_id", "text")).collect()
    assert [(r["doc_id"], r["text"]) for r in kept] == [(5, "a b c d e f")]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "u long, v long")
    out = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert all(out[i] == 0 for i in range(21)) and out[101] == 100


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[p : p + 200] for t in raw for p in range(len(t) - 199))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                gone[p : p + 200] = True
        out.append((len(t), int(gone.sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("wide", [4096, 0])
def test_repeats_against_brute_force(spark, wide, monkeypatch):
    monkeypatch.setattr(repeats, "WIDE", wide)
    rng = random.Random(wide)
    chars = "abcdefghij éß"
    block = ["".join(rng.choice(chars) for _ in range(rng.choice([150, 199, 230, 400]))) for _ in range(5)]
    texts = ["", None, "x" * 199, "y" * 450, "ab" * 300]
    for _ in range(30):
        texts.append("".join(rng.choice([*block, "".join(rng.choice(chars) for _ in range(rng.randint(1, 300)))]) for _ in range(rng.randint(1, 5))))
    texts += [texts[-1]] * 4
    docs = spark.createDataFrame([(i, t, "", "", 0, "", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000)).encode()
    monkeypatch.setattr(repeats, "CHUNK", 700)
    raw, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    windows = 0
    for piece, piece_ends, _, _ in repeats.chunks_of(raw, ends):
        windows += int(repeats.segments(piece, piece_ends)[2].sum())
    assert windows == len(text) - 199


def vectors(spark, n=1200, d=24):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, d))
    x = centre[rng.integers(0, 12, n)] + rng.standard_normal((n, d))
    x[300:500] = x[300]
    rows = [(i, x[i].tolist(), "") for i in range(n)]
    rows += [(n, None, ""), (n + 1, [0.0] * d, ""), (n + 2, [float("nan")] * d, ""), (n + 3, [None] * d, ""), (n + 4, [1.0, 2.0], ""), (None, x[5].tolist(), "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), x


def test_nearest_recall_order_and_scores(spark):
    df, x = vectors(spark)
    out = ann.nearest(df).collect()
    hit = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        hit += len(set(want.tolist()) & {v for _, v, _ in got})
        assert [r for r, _, _ in got] == list(range(1, 11)) and np.allclose([s for _, _, s in got], d[[v for _, v, _ in got]])
    assert hit >= 0.9 * 10 * len(range(0, len(x), 100))


def test_hamming_is_exact(spark):
    df, x = vectors(spark, d=40)
    out = hamming.top_k(df).collect()
    for q in range(0, len(x), 100):
        d = ((x > 0) != (x[q] > 0)).sum(1)
        d[q] = 10**6
        want = np.lexsort((np.arange(len(x)), d))[:10]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [(v, s) for _, v, s in got] == [(int(v), int(d[v])) for v in want]
    few = df.filter("vec_id < 4")
    assert hamming.top_k(few).count() == 3 and hamming.top_k(few.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a = "<p>";</script></head><body><header>Site {k}</header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies {k}</div><div id="wrap"><div class="promo-line">Always the same line</div><div class="entry"><h2>Head {k} &eacute;</h2><p>First  para {k} <b>bold</b> text,
next&nbsp;line.<ul><li>one {k}<li>two</ul><div class="advert">Buy {k}</div><p>Last one<br>ends {k}.<form><input value=x>Search</form></div>
<section id="comments"><article>nice post {k}</article></section></div><aside>Side {k}</aside><footer>(c) {k}</footer></body></html>"""


def test_pages_keep_the_article_only(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k)), "x") for k in range(6)] + [(90, None, None, "x"), (91, "odd", "", "x"), (92, "http://o.example/", "<p>plain<p>text &amp; more", "x"), (93, "http://o.example/", "<div>" * 500 + "deep" + "</div>" * 3, "x")]
    out = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, template string")).collect()}
    for k in range(6):
        assert out[k] == f"Head {k} é\nFirst para {k} bold text, next line.\none {k}\ntwo\nLast one ends {k}."
    assert out[90] == out[91] == "" and out[92] == "plain\ntext & more" and out[93] == "deep"


def test_tree_matching_counts_the_largest_mapping():
    slot = lambda s, *kids: pages.Slot(s, 1, (1,), 0, True, 0, False, 0, 0, list(kids))
    a, b = [slot("p"), slot("div", slot("p"), slot("ul")), slot("p")], [slot("div", slot("ul")), slot("p"), slot("p")]
    assert pages.match(a, b)[0] == 3


def test_pipeline_against_plain_steps(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "house", "stands", "near", "river", "and", "many", "people", "walk", "along", "water", "every", "day", "with", "their", "dogs"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 40)).replace("1", "a") for _ in range(n))
    good = [make(120) for _ in range(120)]
    near = [g + " end" for g in good[:5]]
    passage = make(60)
    shared = [make(80) + " " + passage + " " + make(80) for _ in range(4)]
    junk = ["BUY!! " * 60 + make(3).upper() for _ in range(90)]
    none = ["12345 678", ""]
    texts = [*good, *near, *shared, *junk, *none, None]
    docs = spark.createDataFrame([(i, t, "en" if t else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    first_junk = len(good) + len(near) + len(shared)
    spark.createDataFrame([(i, 0 if first_junk <= i < first_junk + len(junk) else 1, 0) for i in range(first_junk + len(junk))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns, name
    texts_kept = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts_kept) == set(range(len(good))) | set(range(len(good) + len(near), first_junk))
    assert all(passage[20:-20] not in texts_kept[i] for i in range(len(good) + len(near), first_junk))
    assert all(texts_kept[i] == texts[i] for i in range(5, len(good)))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(texts_kept)
