"""Language, quality, packing, pieces, URLs: brute force, round trips and held-out accuracy on small tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from evigrid.llm import language, packing, pieces, quality, urls
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.01"
ODD = ["", None, "  \n\t ", "a", "!!! 123 ...", "It's don't we'll x''s 'tis l'eau 12 3²x <|endoftext|> ΑΣ é́ 中文 😀", "word " * 5000, "x" * 5000]
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score int, key string"


def odd_docs(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k == 3 else f"s{k % 2}", 0, "x", 1, "y") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "null id", "en", "s0", 0, "x", 1, "y")], DOC_SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_is_right_on_held_out_documents(spark):
    docs = documents(spark)
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n > 0.98


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(k, f"the cat and the dog walk over the hill and see {k}" if k % 2 else f"der hund und die katze gehen auf den berg und sehen {k}", "en" if k % 2 else "de", "s", 0, "", 0, "") for k in range(100, 160)], DOC_SCHEMA)
    out = {r["doc_id"]: r for r in language.identify(odd_docs(spark).union(train)).collect()}
    assert [out[k]["lang_pred"] for k in (0, 1, 2, 4)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in out.values()) and None in out
    assert out[102]["lang_pred"] == "de" and out[103]["lang_pred"] == "en"
    empty = train.limit(0)
    assert language.identify(empty).count() == 0


def test_suffix_automaton_counts_phrases():
    reference = "abcabdabc"
    table = language.SuffixAutomaton([ord(c) - 96 for c in reference]).table()

    def greedy(text):
        n = at = 0
        while at < len(text):
            k = 1
            while at + k <= len(text) and text[at : at + k] in reference:
                k += 1
            at += max(1, k - 1)
            n += 1
        return n

    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("abcdx") for _ in range(30))
        state, n = 0, 0
        for c in text:
            got = int(table[state + (ord(c) - 96)])
            n, state = n + (got & 1), got >> 1
        assert n == greedy(text)


def test_quality_is_right_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality.score_quality(documents(spark), labels).join(labels, "doc_id").filter("held_out")
    right, n = out.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 100 and right / n > 0.95


def test_quality_of_odd_texts_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.score_quality(odd_docs(spark), none).collect()
    assert len(out) == len(ODD) + 2 and {r["score"] for r in out} == {0.5}
    some = spark.createDataFrame([(k, k % 2, 0) for k in range(8)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd_docs(spark), some).collect())


def test_isotonic_is_monotone_and_keeps_means():
    rng = np.random.default_rng(1)
    y, w = rng.random(200), rng.integers(1, 9, 200).astype(float)
    z = quality.isotonic(y, w)
    assert (np.diff(z) >= -1e-12).all() and np.isclose((z * w).sum(), (y * w).sum())


def test_word_encoder_equals_the_tokenizer():
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = [t or "" for t in ODD]
    ids, ends = packing.encoder_of(packing.default_tokenizer()).encode(texts, 1)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def check_packed(rows, texts):
    """texts: (id, text) of all documents, ids may repeat."""
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts), key=len)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    total = 0
    for sid in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[sid], key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= packing.SEQUENCE and (at == packing.SEQUENCE or sid == max(by_sequence))
        total += at
    assert total == sum(map(len, want))


def test_packing_is_gapless_and_complete(spark):
    docs = documents(spark).limit(300).cache()
    rows = packing.pack(docs).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for r in docs.collect():
        parts = sorted(whole[r["doc_id"]])
        assert np.frombuffer(b"".join(b for _, b in parts), "<u4").tolist() == [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]


def test_packing_odd_texts_and_targets(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, targets={"s0": 3.0, "s1": 1.0}).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_follows_the_mixture(spark):
    docs = spark.createDataFrame([(k, "word and another word " * 40, "en", "a" if k % 4 else "b", 0, "", 0, "") for k in range(4000)], DOC_SCHEMA)
    rows = packing.pack(docs, targets={"a": 0.5, "b": 0.5}).filter(f"sequence_id < {packing.WINDOW // packing.SEQUENCE}").groupBy("source").agg(F.sum("length").alias("n")).collect()
    n = {r["source"]: r["n"] for r in rows}
    assert abs(n["a"] / (n["a"] + n["b"]) - 0.5) < 0.03


def test_pieces_equal_the_library_and_decode_back():
    own, library = pieces.vocabulary(pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abcdefgh é中\n ") for _ in range(2000)), "  two  spaces ", "<s> <0x41>"]
    ids, ends = own.encode(texts)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(t)
    assert own.decode(ids.astype(np.int64), ends) == [library.decode(library.encode(t)) for t in texts]


def test_pieces_round_trip_as_dataframes(spark):
    docs = odd_docs(spark)
    out = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(r["decoded"] for r in out) == sorted((r["text"] or "") for r in docs.collect())


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_url_rules_against_plain_python(spark):
    rng = random.Random(9)
    made = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(['', 'www.', 'a.b.', 'x'])}{rng.choice(['Example.com', 'example.net', 'com', 'net', 'é.com', 'com:80'])}{rng.choice(['', '/', '/en/', '/en', '/es/1', '/fr/é', '?q=/en/'])}" for _ in range(400)]
    rows = list(enumerate([*made, None, "", "no scheme", "http://", "http://" + "a" * 5000 + ".com/", "http://com/\x01"]))
    out = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    for k, url in rows:
        host, path, rule = by_hand(url)
        assert (out[k]["host"], out[k]["path"], out[k]["rule"], out[k]["verdict"]) == (host, path, rule and rule.name, rule.verdict if rule else "allow")


def test_globs_span_words():
    automaton = urls.ShiftAnd(["*ads*", "a?c", "x" * 70 + "*", "*\\*"])
    texts = [b"my ads here", b"abc", b"x" * 80, b"star*", b"ac", b""]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert automaton.match(np.frombuffer(b"".join(texts), np.uint8), ends).tolist() == [[True, False, False, False], [False, True, False, False], [False, False, True, False], [False, False, False, True], [False] * 4, [False] * 4]


@pytest.mark.parametrize("k", [0, 1])
def test_crc_of_the_query(spark, k):
    row = spark.createDataFrame([(bytes([k, 2, 3]),)], "b binary").select(F.crc32("b")).first()
    assert row[0] == zlib.crc32(bytes([k, 2, 3]))
