"""Registered queries do their whole job: small tables against brute force, where a prefix or a part of the rows would differ."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata

from evigrid.plans import registry


def run(spark, tmp_path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
    return registry.queries()[name](spark, str(tmp_path)).collect()


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


LONG = "word  one\n" * 60
TEXTS = [LONG + "the end", LONG + "of étﬁ", LONG, "The", "none"]
DOCS = ([(k, t, "en", "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")


def test_normal_forms_of_whole_texts(spark, tmp_path):
    got = {r["doc_id"]: (r["citation"], r["nfc"]) for r in run(spark, tmp_path, "x2_normal_forms", documents=DOCS)}
    nfc = [unicodedata.normalize("NFC", t) for t in TEXTS]
    plain = [re.sub(r"\s+", " ", unicodedata.normalize("NFC", t.replace("ﬁ", "fi"))).strip() for t in TEXTS]
    assert got == {k: (md5(plain[k]), md5(nfc[k])) for k in range(len(TEXTS))}


def test_keys_of_whole_texts(spark, tmp_path):
    got = {r["doc_id"]: r["key_md5"] for r in run(spark, tmp_path, "x4_x13_text", documents=DOCS)}
    nfc = lambda t: unicodedata.normalize("NFC", t)
    assert got == {k: md5(" ".join(nfc(nfc(t).casefold()).split())) for k, t in enumerate(TEXTS)}


def test_facets_search_whole_texts(spark, tmp_path):
    labels = ([(0, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r["lang"], r["bucket"], r["n"]) for r in run(spark, tmp_path, "f2_facets", documents=DOCS, labels=labels)}
    assert got == {("en", "confirmed", 1), ("en", "provisional", 1)}


def test_every_order_gets_its_entry(spark, tmp_path):
    tables = {
        "supplier": ([(1, 7), (2, 8)], "s_suppkey long, s_nationkey long"),
        "orders": ([(k, k % 2, datetime.date(1992, 3, 1)) for k in range(1, 25)], "o_orderkey long, o_custkey long, o_orderdate date"),
        "customer": ([(0, 7), (1, 8)], "c_custkey long, c_nationkey long"),
    }
    got = {r["o_orderkey"]: (r["matches"], r["s_suppkey"]) for r in run(spark, tmp_path, "j17_valid_entry", **tables)}
    assert got == {k: (0, -1) if k % 2 else (1, 1) for k in range(1, 25)}  # supplier 1 from 1992-02-10, supplier 2 from 1992-03-21


def test_all_lines_of_an_order_are_bound(spark, tmp_path):
    lines = ([(1, n, n) for n in range(1, 8)] + [(2, n, n) for n in (1, 2, 3, 9)], "l_orderkey long, l_linenumber int, l_partkey long")
    parts = ([(k, k * 1.5) for k in range(1, 8)], "p_partkey long, p_retailprice double")
    got = {r["l_orderkey"]: (r["wanted"], r["found"], r["state"], r["total"]) for r in run(spark, tmp_path, "j6_complete_bindings", lineitem=lines, part=parts)}
    assert got == {1: (7, 7, "complete", 42.0), 2: (4, 3, "observation_missing", None)}


def test_all_benchmark_items_ask(spark, tmp_path):
    words = [chr(97 + k // 10) * 3 + chr(97 + k % 10) for k in range(30)]
    docs = ([(k, f"common {w}", "en", "s") for k, w in enumerate(words)], DOCS[1])
    tables = {"documents": docs, "benchmark": ([(k, f"{w} {w}") for k, w in enumerate(words)], "item_id long, text string"), "embeddings": ([(k, [math.cos(k), math.sin(k)], k % 2) for k in range(30)], "vec_id long, embedding array<float>, label int")}
    assert {(r["query_id"], r["id"]) for r in run(spark, tmp_path, "q2_bm25_top20", **tables)} == {(k, k) for k in range(30)}
    assert {(r["query_id"], r["matches"]) for r in run(spark, tmp_path, "q3_bm25_exhaustive", **tables)} == {(k, 1) for k in range(30)}
    assert {r["claim"] for r in run(spark, tmp_path, "q6_evidence_packing", **tables)} == set(range(30))
    fused = run(spark, tmp_path, "q5_rank_fusion", **tables)
    assert {(r["query_id"], r["id"]) for r in fused if r["rank"] == 1 and r["routes"] == 2} == {(k, k) for k in range(30)}


def test_every_hundredth_vector_asks(spark, tmp_path):
    vectors = [(k, [math.cos(k), math.sin(k)], k % 3) for k in range(450)]
    got = {(r["query_id"], r["rank"], r["id"]) for r in run(spark, tmp_path, "q4_knn_filtered", embeddings=(vectors, "vec_id long, embedding array<double>, label int"))}
    want = set()
    for q in range(0, 450, 100):
        near = sorted((-round(math.cos(k - q), 6), k) for k in range(450) if k % 3 == q % 3)[:20]
        want |= {(q, n + 1, k) for n, (_, k) in enumerate(near)}
    assert got == want
