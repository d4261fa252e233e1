"""Offset maps and splitting against plain versions, offset by offset."""

from __future__ import annotations

import re
import unicodedata

import pytest
from evigrid.functions import spans
from evigrid.operators import splitting
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

LETTERS = list("aex") + ["́", "̣", "̈", "é", "ạ", "가", "ᄀ", "ᅡ", "ᆨ", "Å", "̈́", "क", "़", "क़", "\r\n", "\r", "\n", " ", "ে", "া", "יִ"]
nfc = lambda x: unicodedata.normalize("NFC", x)


def plain_composed(raw):
    """text offset -> the raw offset at which both halves compose by themselves."""
    whole, out = nfc(raw), {}
    for i in range(len(raw) + 1):
        left = nfc(raw[:i])
        if left + nfc(raw[i:]) == whole:
            out.setdefault(len(left), i)
    return out


def pairs(found):
    raw, text = spans.borders(found)
    return dict(zip(raw.tolist(), text.tolist(), strict=True))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(LETTERS), max_size=10).map("".join))
def test_maps_have_the_borders_of_a_plain_search(raw):
    text, found = spans.composed(raw)
    assert text == nfc(raw) and {t: r for r, t in pairs(found).items()} == plain_composed(raw)
    lines, first = spans.line_ends(raw)
    assert lines == raw.replace("\r\n", "\n")
    last, second = spans.composed(lines)
    both = spans.compose(first, second)
    assert pairs(both) == {r: pairs(second)[m] for r, m in pairs(first).items() if m in pairs(second)}
    assert [x[0] for x in both[1:]] == [x[0] + x[2] for x in both[:-1]] and [x[1] for x in both[1:]] == [x[1] + x[3] for x in both[:-1]]
    assert all(raw[r] == "\r" and last[t] == "\n" or nfc(raw[r : r + m]) == last[t : t + n] for r, t, m, n, _ in both if m > 1 and "\r\n" not in raw[r : r + m])


def test_long_texts_have_short_maps():
    text, found = spans.composed("plain text, " * 100_000 + "é" + "x" * 1000)
    assert [x[2:] for x in found] == [(1_200_000, 1_200_000, True), (2, 1, False), (1000, 1000, True)] and text[1_200_000] == "é"


def test_spans_go_there_and_back(spark):
    raw = "one\r\ntwo é three\r\n"
    rows = spark.createDataFrame([(a, b, raw) for a in range(-1, 20) for b in range(-1, 20)], "a int, b int, raw string")
    m = rows.withColumn("m", spans.aligned(F.col("raw"), "line_ends", "composed"))
    out = m.select("a", "b", spans.raw_span(F.col("m.map"), F.col("a"), F.col("b")).alias("r"), spans.text_span(F.col("m.map"), F.col("a"), F.col("b")).alias("t")).collect()
    text = "one\ntwo é three\n"
    table = {0: 0, 1: 1, 2: 2, 3: 3, 4: 5, 5: 6, 6: 7, 7: 8, 8: 9, 9: 11, **{k: k + 2 for k in range(10, 16)}, 16: 19}
    table[15] = 17
    back = {r: t for t, r in table.items()}
    for x in out:
        fine = 0 <= x["a"] < x["b"] <= len(text)
        assert (tuple(x["r"]) if x["r"] else None) == ((table[x["a"]], table[x["b"]]) if fine else None)
        fine = x["a"] < x["b"] and x["a"] in back and x["b"] in back
        assert (tuple(x["t"]) if x["t"] else None) == ((back[x["a"]], back[x["b"]]) if fine else None)


def test_joined_words(spark):
    assert spans.joinable("온실 가스 배출 10 톤 킬 로 그 램 삼 각 tCO2 가 나") == [2, 5, 21, 23, 32]
    assert spans.joined("온실 가스", [2])[0] == "온실가스" and spans.joined("킬 로 그램", [1]) is None
    rows = spark.createDataFrame([("온실 가스 배출", [2, 5]), ("온실 가스 배출", [2]), ("온실 가스 배출", [1]), (None, [1]), ("온실 가스", [])], "raw string, gone array<int>")
    m = rows.withColumn("m", spans.aligned(F.col("raw"), deleted=F.col("gone")))
    assert [r["m"] and r["m"]["text"] for r in m.collect()] == ["온실가스배출", "온실가스 배출", None, None, "온실 가스"]
    one = m.limit(1).select(
        spans.raw_span(F.col("m.map"), F.lit(2), F.lit(4)).alias("inner"), spans.raw_span(F.col("m.map"), F.lit(1), F.lit(3)).alias("across"),
        spans.text_span(F.col("m.map"), F.lit(3), F.lit(5)).alias("word"), spans.text_span(F.col("m.map"), F.lit(2), F.lit(5)).alias("space_first"), spans.text_span(F.col("m.map"), F.lit(0), F.lit(3)).alias("space_last"),
        spans.quoted_span(F.col("m.text"), F.col("m.map"), F.lit("가스")).alias("quoted"), spans.quoted_span(F.col("m.text"), F.col("m.map"), F.lit("산소")).alias("absent"),
        spans.literal_span(F.col("m.text"), F.col("m.map"), F.lit(0), F.lit(2), F.lit("온실")).alias("literal"), spans.literal_span(F.col("m.text"), F.col("m.map"), F.lit(0), F.lit(2), F.lit("가스")).alias("other"),
    ).first()
    assert {k: v and tuple(v) for k, v in one.asDict().items()} == {"inner": (3, 5), "across": (1, 4), "word": (2, 4), "space_first": None, "space_last": None, "quoted": (3, 5), "absent": None, "literal": (0, 2), "other": None}
    with pytest.raises(ValueError):
        spans.aligned(F.col("raw"), "upper")


# --- splitting -------------------------------------------------------------------------------------------------------

TEXT = "당사는 2030년까지 온실가스 30% 감축 목표를 수립하였으며, 2025년까지 재생에너지 및 용수 사용을 확대하고 있습니다. 색인 온실가스 감축. MCM에서 2024년 계획을 검토했습니다. 짧은 문장.\n\nWe will reduce emissions by 10% in 2030; water use was cut, and installed 5 MW solar in 2024."


def test_atoms_by_hand(spark):
    rows = spark.createDataFrame([(1, TEXT, "paragraph"), (2, None, "paragraph"), (3, "", "paragraph")], "id int, text string, kind string")
    got = [(TEXT[r["start"] : r["end"]], TEXT[r["parent_start"] : r["parent_end"]][:6], r["dependent"]) for r in splitting.atoms(rows).collect()]
    assert got == [
        ("당사는 2030년까지 온실가스 30% 감축 목표를 수립하였으며,", "당사는 20", False), ("2025년까지 재생에너지 및", "당사는 20", False), ("용수 사용을 확대하고 있습니다.", "당사는 20", False),
        ("MCM에서 2024년 계획을 검토했습니다.", "MCM에서 ", True), ("We will reduce emissions by 10% in 2030;", "We wil", False), ("water use was cut, and installed 5 MW solar in 2024.", "We wil", False),
    ]
    table = spark.createDataFrame([("1,234", "table_cell", ["온실가스 배출량", "2024년", "톤"]), ("1,234", "table_cell", ["온실가스"]), ("온실가스 감축\t2024년\n용수 절감 10%\t2023", "table_row", [])], "text string, kind string, axes array<string>")
    assert [(r["text"][:5], r["start"], r["end"]) for r in splitting.atoms(table, context="axes").collect()] == [("1,234", 0, 5), ("온실가스 ", 0, 13), ("온실가스 ", 14, 28)]


def plain_prefixes(g, text, chosen):
    out = []
    for start, end in sorted(chosen):
        left = 0
        for p in (g.terminal, g.paragraph):
            for m in re.finditer(p, text[:start]):
                left = max(left, m.end())
        for m in re.finditer(g.bullet, text[: start + 1]):
            left = max(left, m.start())
        while left < start and text[left].isspace():
            left += 1
        if left >= start:
            out.append((start, end, start, None, None))
            continue
        cursor, heading = left, False
        for line in text[left:start].splitlines(keepends=True):
            value = re.sub(g.bullet, "", line).strip()
            cursor += len(line)
            if value and len(value) <= 24 and not re.search(g.continuation, value):
                left, heading = cursor, True
        while left < start and text[left].isspace():
            left += 1
        why = "possible_embedded_heading" if heading and left >= start else "independent_preceding_claim" if re.search(g.independent, text[left:start], re.I) else "another_selected_claim" if any(a < start and b > left for a, b in chosen) else None
        out.append((start if why else left, end, start, "retained" if why else "expanded", why))
    return sorted(out, key=lambda x: x[:3])


PIECES = ["온실가스를 ", "감축했다. ", "제목\n", "위해 ", "\n\n", "• ", "1) ", "and ", "하였으며, ", "긴 문장이 여기에 스물네 글자보다 더 길게 이어집니다\n", "x.y", "? ", "12. ", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=9).map("".join), st.data())
def test_sentence_beginnings_equal_a_plain_scan(text, data):
    ends = sorted(set(data.draw(st.lists(st.integers(0, len(text)), min_size=2, max_size=6))))
    chosen = [(a, b) for a, b in zip(ends, ends[1:], strict=False)][::2]
    g = splitting.Grammar()
    assert splitting.prefixes_of(g, text, "paragraph", chosen) == plain_prefixes(g, text, chosen)


def test_parts_of_a_selection(spark):
    items = "• 위원회가 전략을 승인하고 있음 • 설비 운영을 모니터링 중임 • 절감 활동을 추진하였음"
    clauses = "이사회는 온실가스 전략을 승인하고, 실무 조직은 감축 활동을 추진했으며, (설비를 도입하고, 운영) 체계를 구축하였습니다"
    goal = "온실가스를 2020년 수준으로 유지하고 2030년까지 배출량 10% 감축 목표, 2040년까지 용수 20% 절감 목표"
    rows = spark.createDataFrame([(k, t, "paragraph", [(0, len(t))]) for k, t in enumerate([items, clauses, goal, "• 짧음 • 더", "조건이 되면 승인하고, 추진했다"])], "id int, text string, kind string, spans array<struct<start:int,end:int>>")
    got = {}
    for r in splitting.refined(rows).collect():
        got.setdefault(r["id"], []).append(r["text"][r["start"] : r["end"]])
    assert len(got[0]) == 3 and all(x.startswith("• ") for x in got[0])
    assert got[1] == ["이사회는 온실가스 전략을 승인하고,", "실무 조직은 감축 활동을 추진했으며,", "(설비를 도입하고, 운영) 체계를 구축하였습니다"]
    assert got[2] == ["온실가스를 2020년 수준으로 유지하고 2030년까지 배출량 10% 감축 목표,", "2040년까지 용수 20% 절감 목표"]
    assert len(got[3]) == len(got[4]) == 1


def test_a_label_between_observations_is_cut_off(spark):
    text = " • 전력 사용량: 120 MWh 서울 사업장\n • 전력 사용량: 80 MWh\n"
    row = spark.createDataFrame([(text, "table_cell", [(1, text.index("\n")), (text.rindex("•"), len(text) - 1)])], "text string, kind string, spans array<struct<start:int,end:int>>")
    got = [(text[r["start"] : r["end"]], r["label"]) for r in splitting.unlabelled(row).collect()]
    assert got == [("• 전력 사용량: 120 MWh", "서울 사업장"), ("• 전력 사용량: 80 MWh", None)]
