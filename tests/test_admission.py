"""Admissions by hand: what the tables' queries do not reach."""

from __future__ import annotations

import pytest
from evigrid.functions import text as T
from evigrid.operators import admission
from evigrid.streaming import jobs
from pyspark.sql import functions as F


def test_names_are_equal_in_any_writing(spark):
    rows = spark.createDataFrame([("  Straße\tDE ",), ("STRASSE　de",), ("é",), ("É",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.normalized_key(F.col("t"))).collect()] == ["strasse de", "strasse de", "é", "é", None]
    notes = spark.createDataFrame([("　단위: kWh\n",), ("unit : t x",), (" Scope 1\r\n",)], "t string")
    assert [tuple(r) for r in notes.select(T.unit_note(F.col("t")), T.scope_note(F.col("t"))).collect()] == [("kWh", None), (None, None), (None, "Scope 1")]


@pytest.mark.parametrize("json, found", [
    ('{"label": 1}', True), ('{"a": {"sublabel": 1}}', True), ('{"a": "\\"label\\": 1"}', False), ('{"labels": 1}', False), ('{"a": "label"}', False), ('{"a": "x\\\\", "label" : 2}', True), ("{}", False),
])
def test_forbidden_fields_at_any_depth(spark, json, found):
    assert spark.createDataFrame([(json,)], "j string").select(admission.carries(F.col("j"))).first()[0] is found


def test_exclusions_outweigh_and_statements_are_not_merged(spark):
    claims = spark.createDataFrame([(1, 1, "m", "2024", ["a"], ["p"]), (1, 2, "m", None, ["a"], ["p"]), (2, 3, "m", "2024", [], [])], "doc int, claim int, metric string, period string, entities array<string>, facilities array<string>")
    texts = "array<string>"
    schema = f"doc int, statement int, level string, provider string, standard string, period string, metrics {texts}, entities {texts}, facilities {texts}, excluded_metrics {texts}, excluded_periods {texts}, excluded_entities {texts}, excluded_facilities {texts}, unresolved {texts}, unread_exclusions boolean"
    one = lambda n, **k: tuple({"doc": 1, "statement": n, "level": "limited", "provider": "p", "standard": "s", "period": "2024년도", "metrics": ["m"], "entities": ["a"], "facilities": ["p"], "excluded_metrics": [], "excluded_periods": [], "excluded_entities": [], "excluded_facilities": [], "unresolved": None, "unread_exclusions": None, **k}.values())
    rows = [one(1), one(2, excluded_periods=["2024 년"]), one(3, excluded_entities=[" a"]), one(4, level="none"), one(5, unresolved=["level"]), one(6, entities=["b"]), one(7, standard=None), one(8, unread_exclusions=True)]
    got = {(r["claim"], r["statement"]): (r["status"], r["reason"]) for r in admission.assurance_match(claims, spark.createDataFrame(rows, schema), ["doc"]).collect()}
    none, mismatch = "insufficient_scope_information", "scope_mismatch_or_no_assurance"
    assert [got[1, n] for n in range(1, 9)] == [("covered", None), ("not_covered", "explicit_exclusion"), ("not_covered", "explicit_exclusion"), ("not_covered", mismatch), ("undetermined", "unresolved_statement"), ("not_covered", mismatch), ("undetermined", none), ("undetermined", "unresolved_statement")]
    assert got[2, 1] == ("undetermined", none) and got[3, None] == ("undetermined", "statement_unavailable")


def test_a_report_marks_an_event_once(spark):
    outbox = spark.createDataFrame([(1, "pending", 0, 5), (2, "pending", 2, 5), (3, "sent", 1, 5), (4, "pending", 9, 5)], "event_id long, status string, attempts int, due long")
    reports = spark.createDataFrame([(1, 10, True, 0), (1, 11, False, 0), (2, 10, False, 1), (3, 10, False, 1), (4, 10, False, 9)], "event_id long, now long, sent boolean, expected int")
    got = {r["event_id"]: tuple(r)[1:] for r in admission.marked(outbox, reports).collect()}
    assert got == {1: ("sent", 1, 12, True), 2: ("pending", 2, 5, False), 3: ("sent", 1, 5, False), 4: ("pending", 10, 70, True)}


def test_a_replay_of_leases_is_the_stream_s_step(spark):
    events = [(j, n, n // 2, f"w{(n * 7 + j) % 3}", ["claim", "heartbeat", "commit", "fail", "claim", "claim", "cancel"][(n * 5 + j) % (7 if j % 3 else 6)], 1 + (n + j) % 2) for j in range(12) for n in range(30)]
    schema = "job long, seq long, at long, owner string, action string, token long"
    got = sorted(map(tuple, jobs.replayed(spark.createDataFrame(events, schema)).collect()))
    want = []
    for j in range(12):
        lease = jobs.Lease()
        for _, seq, at, owner, action, token in sorted((e for e in events if e[0] == j), key=lambda e: (e[2], e[1])):
            verdict = lease.take(at, owner, action, token)
            want.append((j, seq, at, owner, lease.token, verdict))
    assert got == sorted(want)
