"""What large tables did to the queries: sides of joins that the driver would have to hold, work that grows too fast."""

from __future__ import annotations

import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
from evigrid.functions import spans
from evigrid.operators import admission, firstfit, fusion, geometry, grids, joins, missing, retrieval, splitting
from evigrid.plans import admissions, decisions, discovery, evidence, exchange, structure, tabular
from evigrid.sources import archives
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def year_cells(spark, tables: int):
    head = [(0, 0, "구분"), (0, 1, "단위"), (0, 2, "2023"), (0, 3, "2024"), (1, 0, "에너지 a"), (1, 1, "MWh"), (1, 2, "5"), (1, 3, "7")]
    rows = [(t, r * 100 + c, r, c, 1, 1, text) for t in range(tables) for r, c, text in head]
    return spark.createDataFrame(rows, "tbl long, cell int, row int, col int, row_span int, col_span int, text string")


def test_year_tables_send_no_cells_through_the_driver(spark):
    out = grids.year_table(year_cells(spark, 20))
    assert "Broadcast" not in final_plan(out)
    assert {(r["value"], r["year"], r["metric"]) for r in out.collect()} == {("7", "2024", "에너지 a")} and out.count() == 20


def test_a_round_trip_counts_what_the_map_says(spark):
    raws = ["", "a\r\nb", "\r\n\r\n", "éx\r\nça", "plain"]
    df = spark.createDataFrame([(x,) for x in raws], "raw string")
    steps = ("line_ends", "composed")
    rows = df.select("raw", spans.round_trip(F.col("raw"), *steps).alias("m"), spans.aligned(F.col("raw"), *steps).alias("w")).select("*", spans.text_offsets(F.col("w.map")).alias("there")).collect()
    for r in rows:
        assert r["m"]["text"] == r["w"]["text"]
        assert r["m"]["refused"] == sum(x < 0 for x in r["there"]) and r["m"]["kept"] == sum(x >= 0 for x in r["there"])


def test_line_ends_leave_no_array_of_offsets_behind(spark):
    plan = structure.x5_line_ends(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "transform(" not in plan


def test_a_shown_text_counts_what_its_map_says(spark):
    raws = ["", None, "온실 가스 배출 10 톤 킬 로 그 램 삼 각 tCO2 가 나", "(가 나) 다  라 \t마", "abc", "킬 로 그램 감 축. 목 표\u3000가 나"]
    rows = spark.createDataFrame([(x,) for x in raws], "raw string").withColumn("may", spans.joinable_spaces(F.col("raw"))).withColumn("gone", F.filter("may", lambda x, i: i % 2 == 0))
    rows = rows.select("*", spans.aligned(F.col("raw"), deleted=F.col("gone")).alias("w"), spans.shown_trip(F.col("raw")).alias("m"))
    rows = rows.withColumn("whole", spans.raw_span(F.col("w.map"), F.lit(0), F.char_length("w.text"))).collect()
    assert [r["m"]["text"] for r in rows] == [r["w"] and r["w"]["text"] for r in rows] and [r["m"]["may"] for r in rows if r["raw"]] == [5, 1, 0, 3]
    for r in rows:
        size = lambda c: None if r[c] is None else len(r[c])
        assert (r["m"]["may"], r["m"]["gone"]) == (size("may"), size("gone")) and (r["m"]["start"], r["m"]["end"]) == (tuple(r["whole"]) if r["whole"] else (None, None))


def test_shown_texts_leave_no_map_behind(spark):
    plan = structure.x7_display(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "filter(" not in plan and "BatchEvalPython" not in plan


def test_statements_are_judged_once_for_claims_that_say_the_same(spark):
    claims = spark.createDataFrame([(None if k == 0 else 1, k, "m", "2024", ["a"], ["f"]) for k in range(40)], "doc int, claim int, metric string, period string, entities array<string>, facilities array<string>")
    none = F.array().cast("array<string>")
    some = [F.array(F.lit(x)) for x in ("m", "a", "f")]
    excluded = [none.alias(f"excluded_{x}") for x in ("metrics", "periods", "entities", "facilities")]
    statements = spark.range(3).select(F.lit(1).alias("doc"), F.col("id").alias("statement"), F.lit("limited").alias("level"), F.lit("p").alias("provider"), F.lit("s").alias("standard"), F.lit("2024").alias("period"), *[c.alias(n) for c, n in zip(some, ("metrics", "entities", "facilities"), strict=True)], *excluded, none.alias("unresolved"), F.lit(False).alias("unread_exclusions"))
    out = admission.assurance_match(claims.coalesce(1), statements, ["doc"])
    rows = out.collect()
    assert len(rows) == 39 * 3 + 1 and sum(r["status"] == "covered" for r in rows) == 117 and {r["claim"] for r in rows} == set(range(40))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_verdicts_of_few_documents_are_dealt_out(spark, tmp_path, monkeypatch):
    """A task for each thousand verdicts, not for each document; documents without a statement keep their claims."""
    tables = ("customer", "supplier")
    for name in tables:
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        nation = F.col(f"{name[0]}_nationkey")
        rows.withColumn(nation._jc.toString(), F.when(nation % 5 == 0, None).otherwise(nation % (3 if name == "customer" else 2))).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(admission, "VERDICTS", 40)
    seen = []
    monkeypatch.setattr(admission.sizing, "in_parts", lambda df, parts, *keys, own=admission.sizing.in_parts: seen.append((parts, keys)) or own(df, parts, *keys))
    got = admissions.j11_assurance_axes(spark, str(tmp_path))
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(admissions.QUERIES["j11_assurance_axes"][1]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert len(seen) == 2 and all(parts > 3 and keys == ("doc", "_part") for parts, keys in seen)


def test_windows_compare_a_sharp_s_as_sql_does(spark, tmp_path):
    text = "Nicht sch kg " + "x" * 300 + " scope 1 erßch kg end"
    spark.createDataFrame([(4, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(structure.QUERIES["j22_windows"][1]).fetchall()
    assert want and sorted(tuple(r) for r in structure.j22_windows(spark, str(tmp_path)).collect()) == sorted(want)


def same_as_sql(spark, tmp_path, texts) -> None:
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(structure.QUERIES["j22_windows"][1]).fetchall()
    assert want and sorted(tuple(r) for r in structure.j22_windows(spark, str(tmp_path)).collect()) == sorted(want)


def test_windows_know_years_and_units_as_sql_does(spark, tmp_path):
    """A card number holds a year for the SQL; a per cent sign is no unit to it."""
    far = "x" * 300
    same_as_sql(spark, tmp_path, [(7, f"To hetion ndesble, outh 4016670676581972 {far} scope 1 outh 1972"), (3, f"Thin%%% or*** {far} scope 1 at 5 % {far} thin scope 2"), (2, f"Que password=11dc549046db720917 et les. {far} 2024 que et")])


def test_windows_of_odd_texts_are_those_of_sql(spark, tmp_path):
    """Texts that share an id share their windows; white space, borders and case are those of the SQL."""
    far = "x" * 300
    texts = [(1, f"Kilo wor {far} 2024 kilo"), (1, f"Kilo of {far} wor of the sco\u00a0pe 1 kilo kwh"), (2, f"ékg İÄΣ ab {far} Scope1 äς Ab iä"), (3, None), (None, "a 2024 b"), (4, ""), (5, f"Scope1 2024 thing {far} scope\t1 thing scope1"), (6, "ab\u00a0cd 2024 abcd ab\x0bcd")]
    same_as_sql(spark, tmp_path, texts)


def test_windows_leave_no_task_with_their_texts(spark):
    plan = final_plan(structure.j22_windows(spark, DATA))
    assert "Join" not in plan and set(re.findall(r"Exchange (\w+)", plan)) == {"hashpartitioning"} and plan.split("== Initial Plan ==")[0].count("Exchange hash") == 1


def test_candidates_of_own_texts_are_those_of_the_joins(spark):
    texts = ["서울사업장은 2024년 재생에너지 120 MWh 사용량 " + "가" * 300 + " 재생에너지를 확대 2024 MWh", "Straße 2023 water 5 % " + "x" * 300 + " STRASSE 2024 WATER 3 %", "x Scope 1 · 2 of 12024 ", "", None]
    rows = spark.createDataFrame([(k, x, x and x[:30]) for k, x in enumerate(texts)], "doc long, text string, quote string")
    terms = ("재생에너지", "2024", "scope 1")
    joined = missing.candidates(rows.select(F.col("doc").alias("claim"), "doc", "quote"), missing.windows(missing.literal_hits(rows, terms).select("doc", "start"), rows, ["doc"]), ["doc"])
    own = missing.own_candidates(rows, "doc", terms)
    assert own.count() > 3 and sorted(map(str, own.collect())) == sorted(map(str, joined.select(*own.columns).collect()))


def boxes_of_page(spark, n: int):
    """n boxes in a column, as two parsers saw them, and one that repeats."""
    rows = [(1, 1, "p", 3 * k + p, f"p{p}", 0.0, 20.0 * k, 40.0 + p, 20.0 * k + 15, "t") for k in range(n) for p in (0, 1)] + [(1, 1, "p", 3 * n + k, f"p{k % 2}", 500.0, 0.0, 540.0, 15.0, "t") for k in range(n)]
    return spark.createDataFrame(rows, "doc long, page int, kind string, id long, parser string, x0 double, y0 double, x1 double, y1 double, text string")


def test_a_full_page_is_fused_without_asking_every_group(spark):
    began = time.time()
    out = geometry.fuse(boxes_of_page(spark, 3000)).collect()
    assert len(out) == 4500 and {r["members"] for r in out} == {2} and time.time() - began < 20


def versions_of_page(spark, n: int):
    blocks = boxes_of_page(spark, n)
    columns = [F.col("parser").alias("run"), F.col("parser").alias("family"), F.format_string("%06d", "id").alias("native"), F.lit(False).alias("invalid"), F.array(F.lit("a")).alias("context"), F.lit(None).cast("string").alias("table_native")]
    return blocks.select("doc", "page", "kind", "parser", "x0", "y0", "x1", "y1", "text", *columns)


def test_a_full_page_of_graphs_is_fused_in_every_version(spark):
    rows = versions_of_page(spark, 2000)
    for version in (1, 4, 5):
        began = time.time()
        out = fusion.fused_blocks(rows, tenant="t", manifest="6f1d3c52-8a0b-4c7e-9d2f-0b5a1e3c7d94", version=version, mixed=version == 5).collect()
        assert sorted(len(r["members"]) for r in out) == [2] * 2000 + [2000] and time.time() - began < 20


def counts_of_blocks(rows, versions):
    out = {}
    for version in versions:
        given = rows if version >= 3 else rows.filter("not invalid")
        for r in fusion.fused_blocks(given, tenant="t", manifest="6f1d3c52-8a0b-4c7e-9d2f-0b5a1e3c7d94", version=version, mixed=version == 5).collect():
            told = (1, len(r["members"]) > 1, r["quality"] == "conflicted", r["issue"] == "source_geometry_invalid", r["quality"] == "unlocated")
            key = (r["doc"], r["page"], r["kind"], version)
            out[key] = tuple(a + b for a, b in zip(out.get(key, (0,) * 5), told, strict=True))
    return out


def test_counts_of_all_versions_are_those_of_the_blocks(spark):
    """With crowded pages, tables given twice or not at all, cells without one, contexts that differ and no geometry."""
    deal, rows = random.Random(7), []
    for k in range(1500):
        doc, kind, parser = deal.randrange(6), deal.choice(["table_cell", "table_cell", "paragraph", "table"]), f"p{deal.randrange(2)}"
        x, y, wide = (0.0, 0.0, 20.0) if doc == 5 else (deal.choice([0.0, 1.0, 2.0, 50.0]), deal.choice([0.0, 1.0, 30.0, 60.0]), deal.choice([19.0, 20.0, 21.0]))
        context = deal.choice([None, [], ["row number=1", "year=1"], ["row number=2", "year=1"], ["mixed_parser_name=a", "year=1"], ["year=1", None]])
        rows.append((doc, 1 + k % 2, kind, parser, parser, parser, f"t{k % 9}" if kind == "table" else f"b{k:04}", x, y, x + wide, deal.choice([y + 15, y + 15, y + 15, None]), deal.choice([False] * 6 + [True, None]), deal.choice(["a", "e\u0301", "\u00e9", None]), context, deal.choice([None, "t1", "t2", "t3", "none"]) if kind == "table_cell" else None))
    df = spark.createDataFrame(rows, "doc long, page int, kind string, parser string, run string, family string, native string, x0 double, y0 double, x1 double, y1 double, invalid boolean, text string, context array<string>, table_native string")
    versions = (1, 2, 3, 4, 5)
    once = df.dropDuplicates(["doc", "run", "native"]).localCheckpoint()
    for given in (once, once.union(once.filter("native in ('t1', 't2')"))):
        got = {(r["doc"], r["page"], r["kind"], r["version"]): tuple(r[c] for c in fusion.COUNTS) for r in fusion.fused_counts(given, versions).collect()}
        assert got == counts_of_blocks(given, versions) and any(x[2] for x in got.values()) and any(x[3] for x in got.values())


def test_small_pages_are_grouped_as_one_by_one():
    deal = random.Random(3)
    for _ in range(200):
        sizes = [deal.randint(1, 9) for _ in range(deal.randint(1, 6))]
        page, a, b, want, begin = [], [], [], [], 0
        for p, n in enumerate(sizes):
            near = [{k} | set() for k in range(n)]
            for y in range(n):
                for x in range(y):
                    if deal.random() < 0.6:
                        near[x].add(y), near[y].add(x), a.append(begin + x), b.append(begin + y)
            first = {k: g[0] for g in firstfit.first_fit(range(n), near) for k in g}
            want += [begin + first[k] for k in range(n)]
            page, begin = page + [p] * n, begin + n
        assert firstfit.small_first_fit(np.array(page), np.array(a, int), np.array(b, int)).tolist() == want


def test_versions_are_told_from_one_pass(spark):
    assert final_plan(exchange.p1_versions(spark, DATA)).split("== Initial Plan ==")[0].count("MapInArrow") == 1


def test_edges_of_fused_graphs_send_no_side_to_all(spark):
    rows = versions_of_page(spark, 40)
    fused = fusion.fused_blocks(rows, tenant="t", manifest="6f1d3c52-8a0b-4c7e-9d2f-0b5a1e3c7d94", version=4)
    edges = rows.select("doc", "run", F.col("native").alias("source_native"), F.col("native").alias("target_native"), F.lit("same").alias("relation"))
    assert "Broadcast" not in final_plan(fusion.fused_edges(fused, edges))


def test_first_fit_is_that_of_every_group(spark):
    import random

    deal = random.Random(5)
    for _ in range(300):
        n = deal.randint(1, 8)
        near = [set() for _ in range(n)]
        for a in range(n):
            for b in range(a, n):
                if deal.random() < 0.6:
                    near[a].add(b)
                    near[b].add(a)
        classes, plain = [deal.randrange(n) for _ in range(20)], []
        for at, c in enumerate(classes):
            fit = next((g for g in plain if all(classes[x] in near[c] for x in g)), None)
            plain.append([at]) if fit is None else fit.append(at)
        assert firstfit.first_fit(classes, near) == plain


def test_prefixes_copy_no_text_beside_its_atoms(spark):
    plan = final_plan(structure.x9_prefixes(spark, DATA))
    assert "Aggregate" not in plan and "Sort" not in plan


def test_texts_of_the_grammar_are_worked_out_once(spark):
    plan = structure.x10_refined(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == len(structure.WORDS)


def test_scores_are_summed_where_the_documents_are(spark):
    docs = spark.createDataFrame([(k % 9, f"carbon energy {k}") for k in range(12)], "id long, text string")
    items = spark.createDataFrame([(1, "carbon 3"), (2, "energy")], "q long, text string")
    out = retrieval.bm25(docs, items, id_col="id", text_col="text", query_id="q", query_col="text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and plan.count("hashpartitioning(id") == 1
    assert len(out.collect()) == 18


def test_facts_are_admitted_without_a_copy_of_each_row_for_each_count(spark):
    assert "Expand" not in admissions.a7_fact_admission(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_tables_laid_out_as_text_are_shuffled_once(spark):
    """No task's rows depend on how well they pack: the only shuffle is by number, and that follows the input."""
    assert "ENSURE_REQUIREMENTS" not in final_plan(structure.x34_laid_out(spark, DATA))


def test_a_laid_out_text_has_all_tabs_and_lines_between_and_after_cells(spark):
    cells = [(1, 1, 1, 1, 1, 1, "a"), (1, 2, 3, 0, 2, 1, None), (1, 3, 3, 2, 1, 2, "b"), (2, 4, 0, 0, 1, 1, "c"), (2, 5, 0, 0, 1, 1, "d")]
    df = spark.createDataFrame(cells, "tbl long, cell int, row int, col int, row_span int, col_span int, text string")
    assert [(r["tbl"], r["text"]) for r in grids.laid_out_text(df).collect()] == [(1, "\t\t\t\n\ta\t\t\n\t\t\t\n\t\tb\t\n\t\t\t")]
    assert {r["cell"]: (r["start"], r["status"]) for r in grids.laid_out(df).collect()} == {1: (5, "ok"), 2: (13, "ok"), 3: (15, "ok"), 4: (None, "same_slot"), 5: (None, "same_slot")}


def test_headers_are_found_after_one_shuffle(spark):
    plan = final_plan(structure.j20_headers(spark, DATA))
    assert "ENSURE_REQUIREMENTS" not in plan and "Join" not in plan


def test_entries_valid_at_a_day_are_counted_without_meeting_them(spark):
    entries = [("a", 1, "2020-01-01", "2020-03-01"), ("a", 2, "2020-02-01", "2020-05-01"), ("a", 3, "2020-05-01", None), ("a", 4, "2020-06-01", "2020-06-01"), ("b", 5, "2020-01-01", None), ("b", None, "2020-01-01", None)]
    e = spark.createDataFrame(entries, "k string, v long, s string, e string").select("k", "v", F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    days = {("a", "2019-12-31"): (0, None), ("a", "2020-01-01"): (1, 1), ("a", "2020-02-15"): (2, None), ("a", "2020-03-01"): (1, 2), ("a", "2020-05-01"): (1, 3), ("a", "2030-01-01"): (1, 3), ("b", "2020-07-01"): (1, 5), ("c", "2020-01-01"): (0, None), (None, "2020-01-01"): (0, None)}
    p = spark.createDataFrame(list(days), "k string, d string").withColumn("at", F.to_date("d"))
    assert {(r["k"], r["d"]): (r["matches"], r["v"]) for r in joins.unique_at(p, e, "k", "at", "s", "e", "v").collect()} == days


def test_spans_votes_and_copies_are_dealt_by_number(spark):
    assert "ENSURE_REQUIREMENTS" not in final_plan(tabular.r4_page_components(spark, DATA))
    assert "ENSURE_REQUIREMENTS" not in final_plan(decisions.a3_strict_consensus(spark, DATA))
    assert "ENSURE_REQUIREMENTS" not in final_plan(structure.x36_distinct_sources(spark, DATA))


def test_boxes_of_the_last_parser_ask_nobody(spark):
    rows = [(1, 1, "p", k, f"p{k % 2}", 0.0, 0.0, 10.0, 10.0) for k in range(4)]
    df = spark.createDataFrame(rows, "doc long, page int, kind string, id long, parser string, x0 double, y0 double, x1 double, y1 double")
    out = geometry.matching_pairs(df)
    assert {(r["l_id"], r["r_id"]) for r in out.collect()} == {(0, 1), (0, 3), (2, 1), (2, 3)}
    assert "_last" in out._jdf.queryExecution().optimizedPlan().toString()


def test_hits_of_packets_are_shuffled_thrice_and_never_by_scope(spark):
    plan = evidence.p7_packet(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 8 and plan.count("hashpartitioning(scope") <= 1  # that one is the rule pack


def test_a_packet_takes_each_source_once_and_no_hit_of_an_unknown_claim(spark):
    claims = spark.createDataFrame([(1, 10, 0, True, "t"), (1, 11, 0, None, "t"), (None, 12, 0, True, "t")], "claim long, source_id long, place int, verified boolean, tenant string")
    fused = spark.createDataFrame([(1, 13, 0.5, "h13"), (1, 13, 0.7, "h13"), (1, 14, 0.6, None), (2, 13, 0.9, "h13"), (None, 13, 0.9, "h13")], "query_id long, id long, score double, hash string")
    blocks = spark.createDataFrame([(k, "t", f"h{k}", 100 if k < 14 else None, 0) for k in (10, 11, 13, 14)], "source_id long, tenant string, text_hash string, tokens int, shared int")
    tables = spark.createDataFrame([(11, "r"), (13, "r"), (14, None), (10, None)], "source_id long, root string")
    elements = spark.createDataFrame([("A", ["same_table", None])], "element string, scopes array<string>")
    got = retrieval.packets(claims, fused, blocks, tables, elements, ["tenant"], k=4).collect()
    assert [(r["claim"], r["blocked"], [tuple(x) for x in r["candidates"]], r["rejected"]) for r in got] == [(1, True, [(1, 10, "local_claim", [], "admitted"), (2, 11, "local_claim", [], "admitted"), (3, 13, "same_table", ["A"], "admitted"), (4, 14, "global_bound", [], "omitted")], [])]


def test_members_go_out_together_and_without_contents_nobody_reads(spark):
    docs = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["some text"] * 2998 + [None, "x" * (3 << 20)])], ["doc_id", "text"])
    sizes = [b.num_rows for b in exchange._packed(iter([docs]))]
    assert sum(sizes) == 3000 and max(sizes) <= archives.BATCH_ROWS and len(sizes) <= 5
    files = spark.createDataFrame([(str(k), exchange._archive(k, b"body")) for k in range(6)], "path string, content binary")
    whole, bare = archives.archive_members(files), archives.archive_members(files, content=False)
    assert bare.columns == whole.columns[:-1] and {tuple(r) for r in bare.collect()} == {tuple(r) for r in whole.drop("content").collect()}
    assert bare.count() == 13


def test_texts_are_told_by_one_look_and_as_word_by_word(spark):
    texts = ["", None, "the", "THE of,in-the\nThat\tis thethe the_ the1 Thé the\u0301 \u0130n", "온the of온 it  it.for", "  as\r\nare "]
    texts += [" ".join(random.Random(k).choices([*structure.WORDS, "x", "The.", "é", "-"], k=40)) for k in range(40)]
    one_by_one = F.col("t")
    for word, said in structure.WORDS.items():
        one_by_one = F.regexp_replace(one_by_one, rf"(?i)\b{word}\b", said)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(structure.told(F.col("t")).alias("got"), one_by_one.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert "regexp_replace(regexp_replace(" not in evidence.f5_eligibility(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_a_look_at_the_next_character_misses_no_word():
    g, rng = splitting.Grammar(), random.Random(3)
    for name in ("environment", "assertion", "year", "nonclaim", "assurance", "status", "means"):
        pattern = getattr(g, name)
        plain = re.sub(r"\(\?=\[[^]]*\]\)", "", pattern)
        assert plain != pattern
        words = [w for w in re.split(r"\\[sbd][*+]?|\(\?[:=<!]*|[()|\[\]^\\.?]", plain) if w] + ["2030", "1999년", "GRI 1", "TCFD", "sasb 색인", "x", " ", "단위:", "Scope 2", "ISO 14001 인증", "도입"]
        for _ in range(3000):
            text = "".join(rng.choice((w, w.upper())) for w in rng.choices(words, k=2))
            assert [m.span() for m in re.finditer(pattern, text, re.I)] == [m.span() for m in re.finditer(plain, text, re.I)]


def test_what_hangs_below_rows_is_told_once_for_a_table(spark):
    """Against the definition, for tables with several claims, notes below notes, below several rows and below other tables."""
    rng = random.Random(5)
    members, edges = [], []
    for t in (100, 200, 300):
        members += [(t, t, None, "head")] + [(t, t + n, n, rng.choice("ab")) for n in range(1, 7)] + [(t, t + 10 + n, None, rng.choice("abc")) for n in range(20)]
        edges += [(t + n, t) for n in range(1, 7)]
        for n in range(19):
            edges += [(t + 10 + n, p) for p in rng.sample([*range(t + 1, t + 7), *range(t + 10, t + 10 + n), 101], rng.randint(1, 2))]
    edges += edges[:9]
    claims = [(t * 10 + r, t, r) for t in (100, 200) for r in (1, 3, 6)] + [(7, 300, None)]
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)

    def above(x):
        return set().union(*[{p} | above(p) for p in up.get(x, ())])

    want = set()
    for claim, t, at in claims:
        rows = {i: (r, x) for u, i, r, x in members if u == t and r is not None}
        want |= {(claim, t, "context")} | {(claim, i, "later" if at and r > at else "kept") for i, (r, _) in rows.items()}
        for _, i, r, x in members:
            if _ == t and r is None and i != t:
                met = [rows[a] for a in above(i) if a in rows]
                want.add((claim, i, "later" if at and any(n > at for n, _ in met) else "repeated" if at and any(y == x for _, y in met) else "kept"))
    df = [spark.createDataFrame(x, s) for x, s in ((claims, "claim long, table_id long, row_no int"), (members, "table_id long, id long, row_no int, text string"), (edges, "child long, parent long"))]
    got = [tuple(r) for r in retrieval.table_context(*df).collect()]
    assert len(got) == len(want) and set(got) == want and {r for _, _, r in want} == {"kept", "later", "repeated", "context"}


def test_members_of_tables_are_sent_to_nobody_and_rounds_are_staged(spark):
    plan = discovery.q7_table_context(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "ExistingRDD" not in plan
