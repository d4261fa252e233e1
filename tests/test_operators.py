"""Operators on hand-made cases: order of gates, states kept apart, boundaries, streams."""

from __future__ import annotations

import pandas as pd
import pytest
from evigrid.functions import periods as D
from evigrid.functions import text as T
from evigrid.operators import geometry, graph, joins, ladder, numeric, retrieval, votes, windows
from evigrid.sources import files, html_tables
from evigrid.streaming import jobs
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_terms_of_mixed_scripts(spark):
    row = one(spark, T.search_terms(F.lit("탄소 배출량 a 2030년 CO2 1,234.5 Été")))
    assert row[0] == ["탄소", "배출", "출량", "a", "2030", "co", "2", "1,234.5", "t"]


@pytest.mark.parametrize("cell,state,value", [("-", "missing", None), ("", "missing", None), ("N/A", "missing", None), ("1,234.50", "present", "1234.50"), ("12,34", "unreadable", None), ("0", "present", "0"), ("-4.5", "present", "-4.5")])
def test_dash_is_missing_and_never_zero(spark, cell, state, value):
    row = one(spark, T.value_state(F.lit(cell)), T.number_literal(F.lit(cell)))
    assert row[0] == state and (state != "present" or row[1] == value)


def test_sentences_and_pages(spark):
    row = one(spark, T.sentences(F.lit("One. Two 2.5 is one! \n\n Last")), T.page_refs(F.lit("p. 3-5, 9, 4, 8-7")), T.csv_safe(F.lit(" =1+1")), T.literal_count(F.lit("a b ab a  b"), "ab"))
    assert row[0] == ["One.", "Two 2.5 is one!", "Last"] and row[1] == [3, 4, 5, 9] and row[2] == "' =1+1" and row[3] == 3


def test_normal_forms(spark):
    row = one(spark, T.citation_form(F.lit("ﬁne  é\n x")), T.nfkc_fold(F.lit("Ｓtraße")))
    assert row[0] == "fine é x" and row[1] == "strasse"


def test_periods_and_amounts(spark):
    low, high = D.display_interval(F.lit("105.0"), F.lit(1))
    row = one(spark, D.parse_period(F.lit("2024-02-30/2024-03-01")), D.iso_date(F.lit("20240229")), D.normalize_amount(F.lit("(1,234)"), F.lit("백만원")), low, high)
    assert row[0] is None and str(row[1]) == "2024-02-29" and row[2] == -1234000000 and float(row[3]) == 104.95 and float(row[4]) == 105.05


def states(spark, track, **known):
    names = ladder.LADDERS[track][0]
    return ladder.decide(spark.createDataFrame([(1, *[known.get(n, "present") for n in names])], "k int, " + ", ".join(f"{n} string" for n in names)), "k", track).first()


def test_ladder_arms(spark):
    assert states(spark, "goal")["grade"] == "E3"
    assert states(spark, "goal", target_year="absent")["grade"] == "E1"
    assert states(spark, "goal", target_year="absent", transition_plan="absent")["grade"] == "E0"
    blocked = states(spark, "goal", current_progress="unknown", scope="conflict")
    assert (blocked["status"], blocked["floor"], blocked["ceiling"], blocked["worlds"]) == ("blocked_evidence", "E1", "E3", 4)
    assert states(spark, "management", named_means_or_concrete_state="absent", willingness_only="absent")["status"] == "blocked_rule_gap"
    assert states(spark, "performance", quantitative_or_qualified_ordinal="absent")["label"] == "UNSUBSTANTIATED"


@pytest.mark.parametrize("given,want", [
    ([("present", "v", True)] * 3, "present"), ([("present", "v", True)] * 2 + [("unknown", None, False)], "present"), ([("present", "v", True)] * 2 + [("absent", None, True)], "conflict"),
    ([("present", "v", True)] * 2 + [("conflict", None, False)], "conflict"), ([("present", "v", True)] * 2, "unknown"), ([("present", "v", True)] * 2 + [("unreadable", None, False)], "unknown"), ([("present", "v", False)] * 3, "unknown"),
])
def test_votes_keep_disagreement(spark, given, want):
    rows = [(1, k, s, v, ok) for k, (s, v, ok) in enumerate(given)]
    assert votes.resolve(spark.createDataFrame(rows, "c int, replicate int, state string, value string, verified boolean"), ["c"]).first()["resolved"] == want


def test_numeric_first_failure_is_the_reason(spark):
    rows = [(1, 1.0, 2.0, 1.5, 2.5, 2, 1, 1, False), (2, 1.0, 2.0, 1.5, 2.5, 1, 1, 1, False), (3, 1.0, 2.0, 1.5, 2.5, 1, 1, 0, False), (4, 1.0, 2.0, 2.0, 2.5, 1, 1, 0, True), (5, 1.0, 2.0, 2.1, 2.5, 1, 1, 0, True)]
    out = numeric.check_sum(spark.createDataFrame(rows, "key int, lo double, hi double, rep_lo double, rep_hi double, wanted int, found int, missing int, same_period boolean"))
    assert [(r["status"], r["reason"]) for r in out.orderBy("key").collect()] == [("not_computable", "observation_missing"), ("not_computable", "value_missing_or_unresolved"), ("not_comparable", "dimension_mismatch"), ("consistent", None), ("inconsistent", None)]


def test_zero_baseline_has_no_rate(spark):
    lo, hi, fine = numeric.rate_interval(F.lit(-0.5), F.lit(0.5), F.lit(9.5), F.lit(10.5), "growth")
    assert tuple(one(spark, lo, hi, fine)) == (None, None, False)


def test_geometry(spark):
    m = (0.0, 2.0, -1.0, 0.0, 100.0, 5.0)
    box = tuple(F.lit(x) for x in (1.0, 2.0, 3.0, 6.0))
    there = geometry.apply_affine(m, box)
    assert tuple(one(spark, *geometry.apply_affine(geometry.invert_affine(m), there))) == (1.0, 2.0, 3.0, 6.0)
    assert one(spark, geometry.iou(box, (F.lit(None).cast("double"), *box[1:])))[0] is None


def test_a_cycle_is_an_error(spark):
    with pytest.raises(Exception, match="cycle"):
        graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")).collect()
    with pytest.raises(Exception, match="cycle"):
        graph.ancestors(spark.createDataFrame([(k, (k + 1) % 10) for k in range(10)], "child int, parent int")).collect()


def test_closures_have_no_depth(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(12)], "child int, parent int")
    assert graph.ancestors(chain).count() == 12 * 13 // 2
    notes = graph.note_targets(spark.createDataFrame([(0,), (11,)], "id int"), chain, spark.createDataFrame([("n", 12), ("m", 0)], "note string, target int"))
    assert sorted((r["id"], r["note"], r["distance"]) for r in notes.collect()) == [(0, "m", 0), (0, "n", 12), (11, "n", 1)]
    near = graph.nearest_section(spark.createDataFrame([(0,), (12,)], "id int"), chain, spark.createDataFrame([(5, "h"), (9, "g")], "id int, title string"))
    assert {(r["id"], r["section"], r["title"]) for r in near.collect()} == {(0, 5, "h"), (12, None, None)}


def test_wide_boxes_lose_no_pair(spark):
    rows = [(1, 1, "p", 1, "a", 0.0, 0.0, 595.0, 100.0, ""), (1, 1, "p", 2, "b", 66.0, 0.0, 661.0, 100.0, "")]
    for k in range(200):
        w, h = 3.0 * 1.09 ** (k % 60), 2.0 * 1.07 ** (k % 50)
        rows += [(2, 1, "p", 10 + 2 * k, "a", 5.0 * k % 97, 3.0 * k % 71, 5.0 * k % 97 + w, 3.0 * k % 71 + h, ""), (2, 1, "p", 11 + 2 * k, "b", 5.0 * k % 97 + w * (k % 9) / 90, 3.0 * k % 71, 5.0 * k % 97 + w, 3.0 * k % 71 + h * 0.95, "")]
    df = spark.createDataFrame(rows, "doc long, page int, kind string, id long, parser string, x0 double, y0 double, x1 double, y1 double, text string")

    def iou(p, q):
        w, h = max(0.0, min(p[7], q[7]) - max(p[5], q[5])), max(0.0, min(p[8], q[8]) - max(p[6], q[6]))
        return w * h / ((p[7] - p[5]) * (p[8] - p[6]) + (q[7] - q[5]) * (q[8] - q[6]) - w * h)

    for least in (0.8, 0.55, 1.0):
        got = [(r["l_id"], r["r_id"]) for r in geometry.matching_pairs(df, least).collect()]
        want = {(p[3], q[3]) for p in rows for q in rows if p[0] == q[0] and p[4] < q[4] and iou(p, q) >= least}
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("text,fine", [("2024", True), ("FY2024 Q2", True), ("2024년", True), ("2025-2024", False), ("2023 ~ 2024년", True), ("2024-01-01", True), ("2024-01-01 ~ 2024-12-31", True), ("2024-99-99", False), ("2024-02-01 to 2024-01-01", False), ("2024-01-01/2024-12-31", False), ("0000", False), (None, False)])
def test_period_forms(spark, text, fine):
    assert one(spark, D.is_supported_period(F.lit(text).cast("string")))[0] is fine


@pytest.mark.parametrize("unit,value", [(None, 5), ("KRW", 5), (" 억 ", 500_000_000), ("조", 5 * 10**12), ("t", None)])
def test_amount_units(spark, unit, value):
    assert one(spark, D.normalize_amount(F.lit("5"), F.lit(unit).cast("string")))[0] == value


def test_terms_are_case_folded(spark):
    assert one(spark, T.search_terms(F.lit("Straße GROẞ ﬁn ٣٤")))[0] == ["strasse", "gross", "fin", "٣٤"] and one(spark, T.citation_form(F.lit("laﬆ")))[0] == "last"


def test_a_ladder_of_too_many_facts_is_refused(spark, monkeypatch):
    names = tuple(f"f{k}" for k in range(13))
    monkeypatch.setitem(ladder.LADDERS, "long", (names, (ladder.branch("A", "E1", names),)))
    with pytest.raises(ValueError, match="too many facts"):
        states(spark, "long")

def test_containment_equals_brute_force(spark):
    spans = [(k % 3, (k * 7) % 50, (k * 7) % 50 + k % 40 + 1, k) for k in range(80)]
    df = spark.createDataFrame(spans, "key int, start int, end int, id int")
    got = {(r["inner_id"], r["outer_id"]) for r in joins.contained(df, df, "key", 10).collect()}
    assert got == {(i[3], o[3]) for i in spans for o in spans if i[0] == o[0] and o[1] <= i[1] < i[2] <= o[2]}


def test_islands_and_carry(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 5, 6, 9, 9)], "k string, v int")
    assert [(r["first"], r["last"], r["size"]) for r in windows.islands(df, ["k"], "v").orderBy("first").collect()] == [(1, 3, 3), (5, 6, 2), (9, 9, 1)]


def test_evidence_packing_retries_without_context(spark):
    pdf = pd.DataFrame({"claim": [1] * 4, "rank": [1, 2, 3, 4], "bundle": [1, 2, 3, 4], "tokens": [1600, 1700, 2000, 100], "shared": [0, 200, 100, 0]})
    out = retrieval.pack_evidence(spark.createDataFrame(pdf)).orderBy("rank").collect()
    assert [r["state"] for r in out] == ["admitted", "admitted_without_context", "omitted", "admitted"]


def test_html_tables_place_spans():
    html = "<table><tbody><tr><td rowspan=2>a</td><td colspan=2>b<br>x</td></tr><tr><td>c</td><th> d </th></tr></tbody></table>"
    assert html_tables.table_cells(html) == [(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b\nx"), (1, 1, 1, 1, "c"), (1, 2, 1, 1, "d")]


@pytest.mark.parametrize("html,reason", [
    (None, "empty"), ("<table></table>", "empty"), ("<table><tr><td>a<td>b</td></tr></table>", "misplaced_cell"), ("<table><tr><td>a</td></tr>", "unclosed"), ("<table><tr><td>a</td></tr></table><table></table>", "not_one_table"),
    ("<table><tr><td><table></table></td></tr></table>", "not_one_table"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "ragged"), ("<table><tr><td rowspan=2>a</td></tr></table>", "row_span_past_end"),
    ("<table><tr><td colspan=x>a</td></tr></table>", "bad_span"), ("<table><tr><td colspan=101>a</td></tr></table>", "over_limit"), ("<td>a</td>", "misplaced_cell"), ("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>", "overlap"),
    ("<table><tr><td>a</th></tr></table>", "unclosed"), ("x" * 200_001, "over_limit"),
])
def test_broken_tables_have_a_reason(html, reason):
    with pytest.raises(html_tables.Refused, match=reason):
        html_tables.table_cells(html)


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 /Type /Page ")
    (tmp_path / "b.pdf").write_bytes(b"MZ")
    out = files.quarantined(spark, str(tmp_path))
    assert sorted(r["verdict"] for r in out.collect()) == ["not_a_pdf", "verified"]
    vault = out.filter("false").select("sha256")
    assert files.promote(out, vault).count() == 1
    table, digest = files.rule_pack(spark, [{"id": "B", "grade": "E1", "require_all": ["x"]}])
    assert table.count() == 1 and len(digest) == 64
    with pytest.raises(ValueError):
        files.rule_pack(spark, [{"id": "B"}])
    with pytest.raises(ValueError):
        files.canonical_json({"a": float("nan")})


def test_leases_are_fenced_in_a_stream(spark, tmp_path):
    rows = [(1, 1, 0, "w1", "claim", 0), (1, 2, 10, "w2", "claim", 0), (1, 8, 20, "w1", "claim", 0), (1, 9, 210, "w2", "commit", 0), (1, 3, 200, "w2", "claim", 0), (1, 4, 210, "w1", "commit", 1), (1, 5, 220, "w2", "heartbeat", 2), (1, 6, 300, "w2", "commit", 2), (1, 7, 310, "w1", "claim", 0)]
    schema = "job long, seq long, at long, owner string, action string, token long"
    for k in range(2):
        spark.createDataFrame(rows[k * 7 : k * 7 + 7], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    query = jobs.leases(stream).writeStream.outputMode("append").format("memory").queryName("verdicts").start()
    query.processAllAvailable()
    query.stop()
    out = [r["verdict"] for r in spark.sql("SELECT * FROM verdicts ORDER BY at, seq").collect()]
    assert out == ["claimed", "refused_leased", "refused_leased", "claimed", "refused_fenced", "refused_fenced", "renewed", "committed", "refused_committed"]


def test_a_failed_job_waits_and_gives_up():
    class Once:
        exists = False

        def update(self, value):
            self.get = value

    events = [(0, "claim", 0), (1, "fail", 1), (2, "claim", 0), (3, "claim", 0), (4, "fail", 2), (8, "claim", 0), (9, "fail", 3), (99, "claim", 0)]
    pdf = pd.DataFrame([(1, n, at, "w", action, token) for n, (at, action, token) in enumerate(events)], columns=["job", "seq", "at", "owner", "action", "token"])
    out = next(jobs.lease_step((1,), iter([pdf[4:], pdf[:4]]), Once()))
    assert out["verdict"].tolist() == ["claimed", "pending", "refused_waiting", "claimed", "pending", "claimed", "failed", "refused_failed"]


def test_ids_are_version_five(spark):
    import uuid

    from evigrid.functions import ids

    names = ["", "a|0|4", "é中", "x" * 300]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.uuid5("6f1d3c52-8a0b-4c7e-9d2f-0b5a1e3c7d94", F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID("6f1d3c52-8a0b-4c7e-9d2f-0b5a1e3c7d94"), n)) for n in names]


def test_a_reply_with_one_wrong_span_is_refused_whole(spark):
    from evigrid.operators import claims

    text = "We cut 1,234.5 tonnes. So we say.  "
    blocks = spark.createDataFrame([(k, 1, "verified", False, text) for k in range(6)] + [(9, 2, "verified", False, "  ")], "source_id int, page int, quality string, fragment boolean, text string")
    replies = spark.createDataFrame([(k, None) for k in range(7)], "source_id int, failure string")
    spans = [(0, 0, 22, text[:22], "claim", None), (1, 0, 9, text[:9], "claim", None), (2, 0, 22, "other", "claim", None), (3, 0, 22, text[:22], "excluded", None), (4, 0, 22, text[:22], "unknown", "x"), (4, 20, 26, text[20:26], "unknown", "y")]
    out = claims.discover(blocks, replies, spark.createDataFrame(spans, "source_id int, start int, end int, quote string, kind string, reason string"), namespace="6f1d3c52-8a0b-4c7e-9d2f-0b5a1e3c7d94")
    got = {}
    for r in out.collect():
        got.setdefault(r["source_id"], []).append((r["start"], r["end"], r["outcome"], r["reason"]))
    assert sorted(got[0]) == [(0, 22, "claim", None), (22, 35, "unknown", "unprocessed_span")]
    assert all(got[k] == [(None, None, "unknown", "MODEL_SPAN_OR_SCHEMA_INVALID")] for k in (1, 2, 3, 4))
    assert got[5] == [(0, 35, "unknown", "unprocessed_span")] and got[9] == [(None, None, "unknown", "empty_source")]


def test_cursors_are_signed():
    from evigrid.operators import listing

    one = listing.cursor(b"k", ["runs", "t"], 100, 50)
    assert listing.position_of(b"k", ["runs", "t"], one, 49) == 100
    for secret, scope, text, now in ((b"x", ["runs", "t"], one, 49), (b"k", ["runs", "u"], one, 49), (b"k", ["runs", "t"], one, 50), (b"k", ["runs", "t"], one.replace("100", "200"), 49)):
        with pytest.raises(ValueError):
            listing.position_of(secret, scope, text, now)
    with pytest.raises(ValueError):
        listing.frozen_page(None, 0, 101)


def test_finite_decimals():
    from fractions import Fraction

    assert [numeric.terminating(Fraction(a, b)) for a, b in ((1, 8), (1, 3), (-5, 2), (0, 7), (10**20 + 1, 10))] == ["0.125", None, "-2.5", "0", "10000000000000000000.1"]


def test_fusion_takes_the_first_group_that_fits(spark):
    schema = "doc long, page int, kind string, id long, parser string, x0 double, y0 double, x1 double, y1 double, text string"
    rows = [(1, 1, "p", 1, "a", 0.0, 0.0, 10.0, 10.0, "t"), (1, 1, "p", 2, "b", 0.0, 0.0, 10.0, 9.0, "t"), (1, 1, "p", 3, "c", 0.0, 1.0, 10.0, 10.0, "u"), (1, 1, "p", 4, "b", 50.0, 0.0, 60.0, 10.0, "v"), (1, 1, "q", 5, "b", 0.0, 0.0, 10.0, 10.0, "t")]
    out = sorted((r["kind"], r["first_id"], r["members"], r["winner"], r["issue"]) for r in geometry.fuse(spark.createDataFrame(rows, schema)).collect())
    # 3 overlaps 2 by 8/10 and 1 by 9/10, so it joins them; its text differs
    assert out == [("p", 1, 3, None, "text_conflict"), ("p", 4, 1, 4, None), ("q", 5, 1, 5, None)]
