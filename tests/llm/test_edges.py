"""Odd inputs, hot groups and methods of the ten operators: brute force on small tables."""

from __future__ import annotations

import json
import math
import random
import unicodedata
from collections import Counter
from zlib import crc32

import corpus_pipeline
import numpy as np
import pytest
from evigrid.llm import ann, hamming, language, packing, pages, partenum, pieces, quality, repeats, urls
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, row string"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def docs_of(spark, texts, langs=None):
    return table(spark, [(k, t, langs[k] if langs else "en", f"s{k % 3}", len(t or ""), "i", "k", "r") for k, t in enumerate(texts)])


# --- language ID -----------------------------------------------------------------------------------------------------


def clean(text):
    out = []
    for c in text:
        if c.isalpha():
            out.append(c.lower() if len(c.lower()) == 1 else c)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def cheapest(references, text):
    """Greedy longest phrases of at most BLOCK letters' blocks, by plain search in the references."""
    best = None
    whole = clean(text)
    for name in sorted(references):
        ref, n = clean(references[name]), 0
        for b in range(0, len(whole), language.BLOCK):
            block, at = whole[b : b + language.BLOCK], 0
            while at < len(block):
                k = 1
                while at + k <= len(block) and block[at : at + k] in ref:
                    k += 1
                at += max(1, k - 1)
                n += 1
        cost = n * math.log2(max(2, len(ref)))
        if best is None or cost < best[0]:
            best = (cost, name)
    return best[1]


def test_language_equals_plain_parsing():
    rng = random.Random(1)
    words = {k: ["".join(rng.choice(abc) for _ in range(rng.randint(1, 6))) for _ in range(80)] for k, abc in (("a", "abcdeé"), ("b", "abcfgh"), ("c", "xyzабв"))}
    make = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    references = {k: make(k, {"a": 300, "b": 60, "c": 300}[k]) for k in words}
    own = language.Languages(references)
    assert not len(own.spelt)  # all letters are symbols of their own, so that plain parsing sees the same phrases
    texts = [make(rng.choice("abc"), rng.randint(1, 250)) for _ in range(60)] + ["", "1 2"]
    raw = [t.encode() for t in texts]
    phrases, _, has = own.phrases(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    got = [own.names[k] if h else "und" for k, h in zip((phrases * own.cost).argmin(1), has, strict=True)]
    assert got == [cheapest(references, t) if any(c.isalpha() for c in t) else "und" for t in texts]


def test_language_of_six_alphabets_and_short_labels(spark):
    rng = random.Random(2)
    sets = {"de": "abcdefghäöüß", "en": "abcdefghiklm", "el": "αβγδεζηθικλμ", "ru": "абвгдежзиклм", "zh": [chr(0x4E00 + 7 * k) for k in range(900)], "ko": [chr(0xAC00 + 28 * k) for k in range(300)]}
    words = {k: ["".join(rng.choice(abc) for _ in range(rng.randint(1, 4))) for _ in range(150)] for k, abc in sets.items()}
    rows = []
    for k in range(720):
        lang = sorted(sets)[k % 6]
        rows.append((k, ("" if lang == "zh" else " ").join(rng.choice(words[lang]) for _ in range(60)), lang))
    rows += [(10_000, "qq ww zz", "xx"), (10_001, "12 34", "yy"), (10_002, "aÄ", None)]  # a tiny label, and one without a letter
    docs = table(spark, [(k, t, lang, "s", 0, "", "", "") for k, t, lang in rows])
    out = {r["doc_id"]: r for r in language.identify(docs).collect()}
    held = [(k, lang) for k, _, lang in rows[:720] if out[k]["held_out"]]
    assert len(held) > 100 and sum(out[k]["lang_pred"] == lang for k, lang in held) / len(held) > 0.95
    assert out[10_001]["lang_pred"] == "und" and all(r["lang_pred"] != "yy" for r in out.values())


def test_language_ties_and_letters_beyond_the_bmp():
    own = language.Languages({"b": "aaaa", "a": "aaaa", "c": "𐐨𐐩𐐪 𐐨𐐩𐐪"})
    texts = ["aa", "𐐨𐐩𐐪"]
    raw = [t.encode() for t in texts]
    phrases, _, _ = own.phrases(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [own.names[k] for k in (phrases * own.cost).argmin(1)] == ["a", "c"]


# --- packing ---------------------------------------------------------------------------------------------------------


def test_every_window_has_the_mixture_while_all_sources_last(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROUNDS", 1)
    rows = [(k, f"word and another word number {k} " * 30, "en", "a" if k % 10 else "b", 0, "", "", "") for k in range(9000)]
    targets = {"a": 0.75, "b": 0.25}
    got = packing.pack(table(spark, rows), targets=targets).select("source", "length", (F.col("sequence_id") * packing.SEQUENCE + F.col("offset")).alias("at"), "doc_id")
    total = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    lasts = int(min(total[s] / targets[s] for s in targets) / packing.WINDOW)
    per = got.filter(f"at < {lasts * packing.WINDOW}").groupBy(F.floor(F.col("at") / packing.WINDOW).alias("w")).agg((F.sum(F.when(F.col("source") == "b", F.col("length"))) / F.sum("length")).alias("b")).collect()
    assert len(per) >= 4 and all(abs(r["b"] - 0.25) < 0.03 for r in per)
    assert got.agg(F.count_distinct("doc_id")).first()[0] == 9000


def test_sources_without_a_target_come_last(spark):
    rows = [(k, "one two three " * 20, "en", ["a", "b", None][k % 3], 0, "", "", "") for k in range(300)]
    got = packing.pack(table(spark, rows), targets={"a": 1.0, "b": 0.0, "gone": 2.0}).select("source", (F.col("sequence_id") * packing.SEQUENCE + F.col("offset")).alias("at"))
    last = {r["source"]: (r["x"], r["y"]) for r in got.groupBy("source").agg(F.min("at").alias("x"), F.max("at").alias("y")).collect()}
    assert last["a"][1] < last["b"][0] and last["a"][1] < last[None][0]
    assert packing.equal_targets(table(spark, rows)) == {"a": 0.5, "b": 0.5} and packing.equal_targets(table(spark, rows).limit(0)) == {}


# --- pages -----------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, template string, salt int"
NOTICE = "Dear readers, this long notice stands on each and every page of this site, and it is longer than most of the texts that are written here from day to day."


def extract(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.extract_pages(table(spark, [(k, u, h, "x", "y", 1) for k, u, h in rows], PAGES)).collect()}


def test_the_wrapper_decides(spark):
    page = "<html><body><div><ul><li><a href=/>Home</a></ul></div><div><p>" + NOTICE + "</p></div><div><p>Text {k} of the day.</p><p>It is short, {k}.</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.replace("{k}", str(k) * 3)) for k in range(5)]
    rows += [(90, "http://alone.example/", rows[1][2])]
    out = extract(spark, rows)
    assert all(out[k] == f"Text {str(k) * 3} of the day.\nIt is short, {str(k) * 3}." for k in range(5))
    assert out[90].startswith("Dear readers")  # the same page without a template to tell


def test_an_article_on_two_pages_is_no_template(spark):
    story = "<p>" + "An agency article that two pages of one site share. " * 5 + "</p>"
    page = lambda k: f"<body><article><h1>Agency</h1>{story}<p>Own remark {k}</p></article></body>"
    out = extract(spark, [(k, "http://a.example/x", page(k)) for k in (1, 2)] + [(k, "http://b.example/x", page(1)) for k in range(10, 16)])
    assert all(out[k].startswith("Agency\nAn agency article") and out[k].endswith(f"Own remark {k}") for k in (1, 2))
    assert all(out[k] == out[1] for k in range(10, 16))  # copies make no constant


def test_pages_without_telling_names(spark):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(["river", "stone", "house", "walks", "under", "light"]) + rng.choice("abcdefgh") for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        body = [say(rng.randint(20, 60)) for _ in range(4)]
        want[k] = "\n".join([f"Title {k}", *body])
        rows.append((k, f"https://n.example/{k}", f"<div class=z1><a href=1>{say(2)}</a> <a href=2>{say(2)}</a></div><div class=z2><h1>Title {k}</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"</div><div class=z3>{say(5)}</div><div class=z4>Imprint of the site, always the same</div>"))
    assert extract(spark, rows) == want


def test_short_parts_deep_nests_and_odd_pages(spark):
    parts = "<body><article><p>" + "long part " * 60 + "</p></article><div class=x>small</div><article><p>short part {k}</p></article></body>"
    deep = "<body><div><article>" + "<div>" * 150 + "deep {k}" + "</div>" * 150 + "<p>after {k}</p></article></div></body>"
    rows = [(k, "http://p.example/", parts.replace("{k}", str(k))) for k in range(4)] + [(10 + k, "http://d.example/", deep.replace("{k}", str(k))) for k in range(4)]
    rows += [(20, None, "<form><p>All of this page is a form, as some systems write them.</p></form>"), (21, "x", "no markup at all"), (22, "x://y", "<br>"), (23, "http://p.example/", "<table><tr><td>other<td>page</table>")]
    rows += [(30, "http://big.example/", "<p>" + "word " * 200_000 + "</p>")]
    out = extract(spark, rows)
    assert all(out[k].endswith(f"\nshort part {k}") for k in range(4))
    assert all(out[10 + k] == f"deep {k}\nafter {k}" for k in range(4))
    assert out[20].startswith("All of this page") and out[21] == "no markup at all" and out[22] == "" and out[23] == "other page"
    assert len(out[30]) == 5 * 200_000 - 1
    assert pages.extract_pages(table(spark, [], PAGES)).count() == 0


@pytest.mark.parametrize("outer", ["article", "main", "div"])
@pytest.mark.parametrize("inner", ["section", "div"])
@pytest.mark.parametrize("host", ["one", "own"])
def test_no_part_of_an_article_is_lost(spark, outer, inner, host):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows, want = [], {}
    for kind in range(4):
        for k in range(5):
            parts = [say(n) for n in (300, 60, 40, 20)]
            title = f"Title {k}"
            body = [
                "".join(f"<{inner}><p>{x}</p></{inner}>" for x in parts),
                f"<h1>{title}</h1>" + "".join(f"<{inner} class={c}><p>{x}</p></{inner}>" for c, x in zip(("lead", "body", "facts", "inset"), (parts[2], parts[0], parts[3], parts[1]), strict=True)),
                "".join(f"<{inner} id={say(1)}-{say(1)}-{say(1)}><h2>Part {n}, {k}</h2><p>{x}</p></{inner}>" for n, x in enumerate(parts)),
                f"<h1>{title}</h1><p>{parts[0]}</p><div class=box><p>{parts[3]}</p></div><p>{parts[1]}</p><{inner}>{parts[2]}</{inner}>",
            ][kind]
            blocks = [
                parts, [title, parts[2], parts[0], parts[3], parts[1]], [x for n, p in enumerate(parts) for x in (f"Part {n}, {k}", p)], [title, parts[0], parts[3], parts[1], parts[2]],
            ][kind]
            page = f"<html><body><nav><a href=/>home</a></nav><div class=cookie>We use cookies, visitor {say(2)}</div><{outer}>{body}</{outer}><div class=comments><p>{say(30)}</p></div><ul><li><a href=x>{say(3)}</a></li><li><a href=y>{say(3)}</a></li></ul><footer>end</footer></body></html>"
            rows.append((10 * kind + k, f"http://{kind}{k if host == 'own' else ''}.example/", page))
            want[10 * kind + k] = "\n".join(blocks)
    assert extract(spark, rows) == want


def test_text_in_nodes_that_the_template_has_lost_is_kept(spark, monkeypatch):
    monkeypatch.setattr(pages, "NODES", 40)
    page = lambda k: "<body><div>" + "".join(f"<div class={'abcdefghijklmnopqrstuvwxyz'[(k * 5 + j) % 26] * 3}><p>part {j} of page {k}</p></div>" for j in range(8)) + "</div></body>"
    t = pages.fold(pages.parse(page(0)), 0)
    for k in range(1, 20):
        t = pages.pruned(pages.blend(t, pages.fold(pages.parse(page(k)), k)))
    assert t.nodes() <= 40
    wrapper = pages.Wrapper(json.loads(json.dumps(pages.wrapper_of(t))))
    for k in range(20):
        assert pages.extracted(page(k), wrapper) == "\n".join(f"part {j} of page {k}" for j in range(8))


def test_a_template_has_a_bound():
    fold = lambda k: pages.fold(pages.parse("".join(f"<div class={'abcdefghijklmnopqrstuvwxyz'[(k + j) % 26] * (j + 1)}>t</div>" for j in range(900)) + f"<main>text {k}</main>"), k)
    t = fold(0)
    for k in range(1, 12):
        t = pages.pruned(pages.blend(t, fold(k)))
    assert t.nodes() <= pages.NODES and any(pages.tag_of(k.sign) == "main" and k.pages == 12 for k in t.kids)
    assert json.loads(json.dumps(pages.Slot.of(json.loads(json.dumps(t.plain()))).plain())) == json.loads(json.dumps(t.plain()))


# --- hot groups ------------------------------------------------------------------------------------------------------


def test_join_with_a_hot_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 999)}" for _ in range(160)]
    texts = []
    for _ in range(5200):  # more than two blocks' worth of near copies, all different
        words = list(base)
        words[rng.randrange(160)] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(300)]
    out = {r["doc_id"]: r["component_id"] for r in partenum.jaccard_join(docs_of(spark, texts).repartition(6)).collect()}
    assert all(out[k] == 0 for k in range(5200)) and all(out[k] == k for k in range(5200, 5500))


def test_blocks_of_a_group_lose_no_pair():
    import pyarrow as pa

    n = 40
    rows = [(7, i, j, b, k) for k in range(n) for b in [k % 3] for other in range(3) for i, j in [(min(b, other), max(b, other))]]
    g, i, j, b, k = (np.array(x) for x in zip(*rows, strict=True))
    full = np.zeros((len(k), partenum.COUNTS), np.uint8)
    group = pa.table({"g": g, "i": i, "j": j, "block": b, "node": k, "component": k // 2, "n": np.full(len(k), 9), "counts": pa.array([x.tobytes() for x in full], pa.binary())})
    out = partenum._across(partenum.Threshold())(group)
    got = Counter((min(a, x), max(a, x)) for a, xs in zip(out["a"].to_pylist(), out["bs"].to_pylist(), strict=True) for x in xs)
    assert set(got) == {(a, x) for a in range(n) for x in range(a + 1, n) if a // 2 != x // 2}


def brute_repeats(texts):
    raw = [t.encode() for t in texts]
    count = Counter(t[p : p + 200] for t in raw for p in range(len(t) - 199))
    gone = []
    for t in raw:
        mask = bytearray(len(t))
        for p in range(len(t) - 199):
            if count[t[p : p + 200]] > 1:
                mask[p : p + 200] = b"\1" * 200
        gone.append(sum(mask))
    return gone


@pytest.mark.parametrize("most", [0, 4096])
def test_a_hot_line_in_many_contexts(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "WIDE", most)
    rng = random.Random(3)
    line = "All of the text above is licensed under terms that forbid everything that is not allowed by name; see the terms, and the terms of the terms, for further terms. "
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    ends = [say(60) for _ in range(12)]
    texts = [say(rng.randint(0, 120)) + line + rng.choice([say(90), rng.choice(ends)]) for _ in range(400)]
    texts += [texts[3], line, line * 3]
    out = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs_of(spark, texts).repartition(5)).collect()}
    assert [out[k] for k in range(len(texts))] == brute_repeats(texts)


def test_equal_segments_are_reduced_before_the_shuffle():
    rec = np.zeros(6, repeats._SEGMENT)
    rec["h"], rec["g"], rec["off"] = [5, 5, 5, 9, 9, 1], [1, 2, 1, 4, 4, 7], range(6)
    got, new_h, new_g = repeats.by_segment(rec)
    assert got["h"].tolist() == [1, 5, 5, 5, 9, 9] and new_h.sum() == 3 and new_g.sum() == 4


# --- empty tables, repeated rows, clashing names ---------------------------------------------------------------------


def test_empty_tables(spark):
    docs, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert quality.score_quality(docs, labels).count() == 0
    assert pieces.decode(pieces.encode(docs)).count() == 0
    assert urls.judge_urls(table(spark, [], PAGES)).count() == 0
    assert ann.nearest(vectors).count() == 0 and hamming.top_k(vectors).count() == 0


def test_pipeline_of_nothing_and_without_labels(spark, tmp_path):
    for name, rows in (("none", []), ("some", [(k, f"the river runs along the old house and nobody of {k} knows why", "en", "s", 60, "i", "k", "r") for k in range(20)])):
        table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == len(rows)  # without labels every score is 0.5, so all stay


def test_quality_equals_plain_counts():
    text = "Two words, one LINE!\nand | more é."
    raw = np.frombuffer(text.encode(), np.uint8)
    x = dict(zip(quality.STATS, quality.statistics(raw, np.array([0, len(raw)]))[0], strict=True))
    words = text.encode().split()
    assert np.isclose(x["log_words"], math.log1p(len(words))) and np.isclose(x["word_mean"], np.mean([len(w) for w in words]))
    assert np.isclose(x["commas"], 1 / len(words)) and np.isclose(x["pipes"], 1 / len(words)) and np.isclose(x["lines"], 1 / len(words))
    assert np.isclose(x["distinct"], len(set(words)) / len(words)) and np.isclose(x["non_ascii"], 2 / len(raw))


def test_quality_equals_a_plain_fit(spark):
    """The query's scores against the same formulas over all rows in one place."""
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["good", "words", "here", "Now", "x1"] if k % 2 else ["BUY!!", "###", "4711", "win"]) for _ in range(rng.randint(5, 60))), "en", "s", 0, "i", "k", "r") for k in range(240)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(table(spark, rows), labels).collect()}
    raw = [t.encode() for _, t, *_ in rows]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    fit = [k for k in range(200) if crc32(str(k).encode()) % 3 != 1]
    held = {r["id"] for r in spark.range(200).select("id", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("c")).filter("c").collect()}
    kernel = quality.Kernel(x[fit].mean(0), np.where(x[fit].std(0) > 1e-9, x[fit].std(0), 1.0))
    own = [k for k in fit if k not in held]
    a, y = kernel.features(x[own]), np.array([k % 2 for k in own], float)
    weights = np.linalg.solve(a.T @ a + 1e-3 * len(own) / 100 * np.eye(a.shape[1]), a.T @ y)
    calibrate = [k for k in fit if k in held]
    at = np.clip(np.rint(kernel.features(x[calibrate]) @ weights / quality.GRID), -1024, 2048)
    bins = sorted(set(at))
    count, mean = np.array([(at == b).sum() for b in bins], float), np.array([np.mean([k % 2 for k, p in zip(calibrate, at, strict=True) if p == b]) for b in bins])
    smooth = quality.isotonic(mean, count)
    blocks = np.split(np.arange(len(bins)), np.flatnonzero(np.diff(smooth)) + 1)
    knots = np.array([np.average(np.array(bins)[b], weights=count[b]) for b in blocks]) * quality.GRID
    want = np.clip(np.interp(kernel.features(x) @ weights, knots, [smooth[b[0]] for b in blocks]), 0, 1)
    assert np.allclose([got[k] for k in range(240)], want, atol=1e-6)


def test_repeated_rows_and_clashing_names(spark):
    docs = docs_of(spark, ["the same text", "the same text", None]).union(docs_of(spark, ["the same text"]))
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    scores = quality.score_quality(docs, labels).collect()
    assert len(scores) == 4 and len({r["score"] for r in scores if r["doc_id"] != 2}) == 1
    assert sorted(r["decoded"] for r in pieces.decode(pieces.encode(docs)).collect()) == ["", "the same text", "the same text", "the same text"]
    urls_in = table(spark, [(1, "http://www.example.com/en/", "h", "host", "path", 1)] * 2, PAGES.replace("template", "rule").replace("salt int", "verdict int").replace("page_id long, url string, html string, host string, rule string", "page_id long, url string, html string, host string, rule string"))
    assert [r["verdict"] for r in urls.judge_urls(urls_in).collect()] == ["allow", "allow"]
    vectors = spark.createDataFrame([(0, [1.0, 0.0], 1, [0.5], 2), (0, [1.0, 0.0], 1, [0.5], 2), (7, [1.0, 0.1], 1, [0.5], 2), (7, [1.0, 0.1], 1, [0.5], 2), (9, [0.0, 1.0], 1, [0.5], 2)], "vec_id long, embedding array<double>, dim int, v array<double>, vid int")
    for find in (ann.nearest, hamming.top_k):  # a repeated query is asked once for each of its rows' ids; its own id is no candidate
        got = find(vectors).collect()
        assert {r["query_id"] for r in got} == {0} and 0 not in {r["vec_id"] for r in got} and {7, 9} <= {r["vec_id"] for r in got}


def test_normal_forms_do_not_split_letters():
    text = unicodedata.normalize("NFD", "é è")
    own = language.Languages({"x": "é è ê"})
    raw = text.encode()
    _, _, has = own.phrases(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert has.tolist() == [True]


# --- very long texts -------------------------------------------------------------------------------------------------


def test_parts_of_long_texts_change_nothing(monkeypatch):
    from evigrid.llm import common

    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdeé中 ") for _ in range(rng.choice([1, 3, 9, 300]))) + rng.choice(["", "\n", ".", "!"]) for _ in range(2500)) + "  "
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.array([0, len(raw)])
    own = language.Languages({"a": "abcd é abba", "b": "eeé 中 aab"})
    encoder = packing.WordEncoder(packing.default_tokenizer())
    want = partenum.shingle_sets(raw, ends, 4), quality.statistics(raw, ends), own.phrases(raw, ends), encoder.encode([text], 1)[0]
    for long in (700, 2_000, 40_000):
        monkeypatch.setattr(common, "LONG", long)
        got = partenum.shingle_sets(raw, ends, 4)
        assert all(np.array_equal(x, y) for x, y in zip(got, want[0], strict=True))
        again = quality.STATS.index("repeats")
        assert np.allclose(np.delete(quality.statistics(raw, ends), again, 1), np.delete(want[1], again, 1))
        phrases, size, has = own.phrases(raw, ends)
        assert (np.abs(phrases - want[2][0]) <= 2 * len(raw) / long + 2 * len(text) / language.BLOCK).all() and has.all()
        assert np.array_equal(encoder.encode_one(raw, 1)[0], want[3])
    few = np.frombuffer(b"word " * 3, np.uint8)
    monkeypatch.setattr(common, "LONG", 4)
    assert len(partenum.shingle_sets(few, np.array([0, len(few)]), 4)[1]) == 1
