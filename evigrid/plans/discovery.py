"""Claim discovery, listings, numeric checks, whole decisions, periods in prose and evidence routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import periods as D
from evigrid.functions import text as T
from evigrid.operators import claims, ladder, listing, numeric, sizing, votes
from evigrid.operators import retrieval as R
from evigrid.plans import decisions, retrieval
from evigrid.sources.tables import table

NAMESPACE = "6f1d3c52-8a0b-4c7e-9d2f-0b5a1e3c7d94"
PAGES = [p for p in range(97) if p % 5 != 4]


def p6_claim_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Documents as blocks; each is answered with two spans, some of them wrong."""
    k, t = F.col("source_id"), F.col("text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    quality = F.when(k % 29 == 0, "conflicted").when(k % 31 == 0, "unreadable").when(k % 2 == 0, "verified").otherwise("unverified")
    blocks = docs.select("source_id", (k % 97).alias("page"), quality.alias("quality"), (k % 37 == 0).alias("fragment"), "text")
    replies = docs.filter(k % 23 != 0).select("source_id", F.when(k % 19 == 0, "timeout_output").cast("string").alias("failure"))
    space = F.instr(F.substring(t, F.lit(41), F.char_length(t)), " ")
    cut = docs.withColumn("e1", F.when(space > 0, F.lit(39) + space)).filter("e1 is not null").withColumn("e2", F.least(F.char_length(t), F.col("e1") + 31))
    none = F.lit(None).cast("string")
    one = cut.select("source_id", F.lit(0).alias("start"), F.col("e1").alias("end"), F.when(k % 13 == 0, "wrong").otherwise(F.substring(t, F.lit(1), F.col("e1"))).alias("quote"), F.lit("claim").alias("kind"), none.alias("reason"))
    start = F.when(k % 11 == 0, F.col("e1") - 3).otherwise(F.col("e1") + 1)
    two = cut.select("source_id", start.alias("start"), F.col("e2").alias("end"), F.substring(t, start + 1, F.col("e2") - start).alias("quote"), F.when(k % 7 == 0, "claim").otherwise("excluded").alias("kind"), F.when(k % 7 != 0, "marketing").alias("reason"))
    out = claims.discover(blocks, replies, one.union(two), namespace=NAMESPACE, pages=PAGES)
    return out.select("source_id", "page", "start", "end", "outcome", F.coalesce("reason", F.lit("-")).alias("reason"), F.md5(F.coalesce("quote", F.lit("-"))).alias("quote_md5"), F.coalesce("claim_id", F.lit("-")).alias("claim_id"))


P6 = r"""
WITH b AS (SELECT doc_id AS source_id, doc_id % 97 AS page, text, length(text) AS n, CASE WHEN doc_id % 29 = 0 THEN 'conflicted' WHEN doc_id % 31 = 0 THEN 'unreadable' ELSE 'fine' END AS quality, instr(substr(text, 41), ' ') AS space FROM documents),
r AS (SELECT *, CASE WHEN page % 5 = 4 THEN 'outside_declared_subset' WHEN source_id % 37 = 0 THEN 'source_continuation_fragment' WHEN quality <> 'fine' THEN quality WHEN coalesce(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '') = '' THEN 'empty_source' WHEN source_id % 23 = 0 THEN 'extraction_failed' WHEN source_id % 19 = 0 THEN 'timeout_output' END AS reason,
  CASE WHEN space > 0 THEN 39 + space END AS e1 FROM b),
o AS (SELECT *, CASE WHEN e1 IS NOT NULL THEN least(n, e1 + 31) END AS e2, CASE WHEN source_id % 11 = 0 THEN e1 - 3 ELSE e1 + 1 END AS s2 FROM r WHERE reason IS NULL),
cut AS (SELECT *, regexp_matches(substr(text, e2, 1), '^[\p{L}\p{N}]$') AND regexp_matches(substr(text, e2 + 1, 1), '^[\p{L}\p{N}]$') OR regexp_matches(substr(text, greatest(e2 - 1, 1), least(e2, 2)) || '|' || substr(text, e2 + 1, 2), '\d\|(\d|%|[,.]\d)|\d[,.]\|\d|[+−-]\|\d') AS right_cut,
  regexp_matches(substr(text, s2, 1), '^[\p{L}\p{N}]$') AND regexp_matches(substr(text, s2 + 1, 1), '^[\p{L}\p{N}]$') OR regexp_matches(substr(text, greatest(s2 - 1, 1), least(s2, 2)) || '|' || substr(text, s2 + 1, 2), '\d\|(\d|%|[,.]\d)|\d[,.]\|\d|[+−-]\|\d') AS left_cut,
  regexp_matches(substr(text, e1, 1), '^[\p{L}\p{N}]$') AND regexp_matches(substr(text, e1 + 1, 1), '^[\p{L}\p{N}]$') OR regexp_matches(substr(text, greatest(e1 - 1, 1), least(e1, 2)) || '|' || substr(text, e1 + 1, 2), '\d\|(\d|%|[,.]\d)|\d[,.]\|\d|[+−-]\|\d') AS first_cut,
  NOT regexp_matches(substr(text, 1, e1), '\S') AS blank1, s2 >= e2 OR NOT regexp_matches(substr(text, s2 + 1, e2 - s2), '\S') AS blank2 FROM o),
v AS (SELECT *, e1 IS NULL OR (source_id % 13 <> 0 AND NOT blank1 AND NOT first_cut AND source_id % 11 <> 0 AND NOT blank2 AND (source_id % 7 <> 0 OR NOT (left_cut AND s2 < n) AND NOT (right_cut AND e2 < n))) AS fine FROM cut),
spans AS (
  SELECT source_id, page, 0 AS start, e1 AS "end", 'claim' AS outcome, '-' AS reason, substr(text, 1, e1) AS quote FROM v WHERE fine AND e1 IS NOT NULL
  UNION ALL SELECT source_id, page, s2, e2, CASE WHEN source_id % 7 = 0 THEN 'claim' ELSE 'excluded' END, CASE WHEN source_id % 7 = 0 THEN '-' ELSE 'marketing' END, substr(text, s2 + 1, e2 - s2) FROM v WHERE fine AND e1 IS NOT NULL
  UNION ALL SELECT source_id, page, e1, s2, 'unknown', 'unprocessed_span', substr(text, e1 + 1, s2 - e1) FROM v WHERE fine AND e1 < s2 AND regexp_matches(substr(text, e1 + 1, s2 - e1), '\S')
  UNION ALL SELECT source_id, page, coalesce(e2, 0), n, 'unknown', 'unprocessed_span', substr(text, coalesce(e2, 0) + 1) FROM v WHERE fine AND regexp_matches(substr(text, coalesce(e2, 0) + 1), '\S')
  UNION ALL SELECT source_id, page, -1, -1, 'unknown', 'MODEL_SPAN_OR_SCHEMA_INVALID', '-' FROM v WHERE NOT fine
  UNION ALL SELECT source_id, page, -1, -1, CASE reason WHEN 'outside_declared_subset' THEN 'excluded' WHEN 'source_continuation_fragment' THEN 'excluded' WHEN 'conflicted' THEN 'conflict' WHEN 'unreadable' THEN 'unreadable' ELSE 'unknown' END, reason, '-' FROM r WHERE reason IS NOT NULL),
h AS (SELECT *, sha1(unhex('6f1d3c528a0b4c7e9d2f0b5a1e3c7d94') || encode(source_id || '|' || start || '|' || "end" || '|' || sha256(quote))) AS x FROM spans)
SELECT source_id, page, start, "end", outcome, reason, md5(quote) AS quote_md5, CASE WHEN outcome = 'claim' THEN x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', x[17:17]), 1) || x[18:20] || '-' || x[21:32] ELSE '-' END AS claim_id FROM h
"""


def _customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("document"), F.floor("c_acctbal").alias("created"), "c_mktsegment")


def _gone(spark, d):
    return table(spark, d, "customer").filter("c_custkey % 17 = 0").select(F.col("c_custkey").alias("document"))


def _owned(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("document"))


def _runs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("document"), F.to_date("o_orderdate").alias("created"), F.col("o_orderstatus").alias("status"))


def l1_numbered_documents(spark, d):
    return listing.numbered(listing.live(_customers(spark, d), _gone(spark, d), ["document"], owners=_owned(spark, d)), ["created", "document"]).select("document", "ordinal")


def l2_keyset_page(spark, d):
    return listing.keyset_page(_runs(spark, d), "created", "run", 50, (F.to_date(F.lit("1996-06-01")), 5000)).select("run", "created", "more")


def l3_runs_of_documents(spark, d):
    runs = _runs(spark, d).join(_customers(spark, d).select("document"), "document")
    return listing.live(runs, _gone(spark, d), ["document"], owners=_owned(spark, d)).select("run", "document", "status")


def l4_reuse_candidates(spark, d):
    docs = _customers(spark, d).select("document", (F.col("document") % 1000).alias("expires"), F.col("document").alias("content"))
    runs = _runs(spark, d).withColumn("status", F.when(F.col("status") == "F", "completed").when(F.col("status") == "P", "partial_blocked").otherwise("queued"))
    progress = runs.select("run", (F.col("run") % 3 != 0).alias("result_ready"))
    return listing.reuse_candidates(docs, runs, progress, _gone(spark, d), document_key="document", run_key="run", now=100).select("content", "run", "candidate")


def _revisions(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return o.withColumn("revision", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))


def l5_first_history(spark, d):
    r = _revisions(spark, d)
    heads = r.groupBy("o_custkey").agg(F.max("revision").alias("revision"))
    history = table(spark, d, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("day"))
    return listing.first_history(heads, r, history, ["o_custkey"], "day").select("o_custkey", "revision", "o_orderkey", "first_row")


def l6_active(spark, d):
    r = _revisions(spark, d)
    heads = r.groupBy("o_custkey").agg(F.max("revision").alias("revision"))
    pointers = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return listing.active(pointers, heads, r, ["o_custkey"]).select("o_custkey", "revision", "o_orderstatus")


def l9_spend_check(spark, d):
    money = lambda v: F.lit(v).cast("decimal(18,2)")
    o = table(spark, d, "orders")
    runs = o.select(
        F.col("o_orderkey").alias("run"), F.year("o_orderdate").alias("event"), F.to_date("o_orderdate").alias("day"), F.nullif(F.col("o_custkey") % 50, F.lit(0)).alias("grp"), money("1000.00").alias("asked"),
        money("250000.00").alias("run_cap"), money("3000000.00").alias("day_cap"), money("1e12").alias("event_cap"), F.when(F.col("o_custkey") % 3 == 0, money("20000000.00")).alias("group_cap"),
    )
    charges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    return listing.spend_check(runs, charges, "asked").select("run", "run_total", "day_total", "event_total", "group_total", "admitted").na.fill(0).withColumns({c: F.col(c).cast("double") for c in ("run_total", "day_total", "event_total", "group_total")})


def l13_prefix(spark, d):
    x = table(spark, d, "documents").select(F.concat("source", F.lit(":"), "doc_id").alias("key"))
    return listing.prefixed(x, "key", "src1:")


def l15_range_page(spark, d):
    return listing.range_page(table(spark, d, "events").select("event_id", "event_type"), "event_id", 500, 640, 100)


def l16_archive(spark, d):
    spend = table(spark, d, "orders").select(F.year("o_orderdate").alias("event"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("created"), F.when(F.col("o_orderstatus") == "F", "settled").otherwise("reserved").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    totals = spend.select("event").distinct().withColumn("amount", F.lit("1.00").cast("decimal(18,2)"))
    kept, rolled = listing.archived(spend, totals, 1500)
    return kept.groupBy("event").agg(F.count("*").alias("kept"), F.sum("amount").cast("double").alias("open")).join(rolled.select("event", F.col("amount").cast("double").alias("archived")), "event", "full_outer").select("event", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("open", F.lit(0.0)).alias("open"), "archived")


def t5_frozen_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return listing.frozen_page(listing.frozen(o, ["day", "o_orderkey"]), 1000, 100)


def p8_numeric_check(spark, d):
    """An order's cheapest and dearest line, in tenths, as observations of five kinds of claims, with every failure."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min(F.floor(F.col("l_extendedprice") * 10)).alias("lo"), F.max(F.floor(F.col("l_extendedprice") * 10)).alias("hi"))
    k = F.col("k")
    shown = lambda v: F.concat(F.expr(f"({v}) div 10"), F.lit("."), F.expr(f"({v}) % 10"))
    x = x.withColumn("shift", F.expr("(k div 5) % 3")).withColumn("b", F.when(k % 29 == 0, F.lit(0).cast("long")).when(k % 5 == 3, F.col("lo")).otherwise(F.col("hi"))).withColumn("c", F.when(k % 5 == 3, F.col("hi")).otherwise(F.col("lo")))
    x = x.withColumn("r", F.when(k % 5 == 0, F.col("lo") + F.col("shift")).when(k % 5 == 1, F.col("lo") + F.col("hi") + F.col("shift")).when(F.col("b") == 0, F.col("shift")).otherwise(F.expr("abs(c - b) * 1000 div b + 20 * shift")))
    displays = F.when(k % 31 == 0, F.array(F.lit("-"), shown("hi"))).when(k % 5 == 0, F.array(shown("lo"))).when(k % 5 == 1, F.array(shown("lo"), shown("hi"))).otherwise(F.array(shown("b"), shown("c")))
    kind = F.element_at(F.array(*[F.lit(n) for n in ("comparison", "sum", "reduction", "growth", "product_reduction")]), (k % 5 + 1).cast("int"))
    claims_ = x.select(
        k.alias("key"), kind.alias("kind"), F.lit(2).alias("found"), F.when(k % 37 == 0, 3).otherwise(2).alias("wanted"), (k % 41 != 0).alias("claim_verified"), (k % 43 == 0).alias("issues"), (k % 47 == 0).alias("footnotes_open"),
        displays.alias("displays"), shown("r").alias("reported"), F.when(k % 53 == 0, "soon").otherwise("2024").alias("reporting_period"), F.when((k % 59 == 0) | ((k % 5 == 4) & (k % 61 != 0)), "2024").otherwise("2023").alias("baseline_period"),
        (k % 67 != 0).alias("dimensions_ok"), (k % 71 != 0).alias("product_ok"), (k % 73 != 0).alias("aggregation_ok"),
    )
    out = numeric.check(claims_)
    return out.select("key", "status", F.coalesce("reason", F.lit("-")).alias("reason"), F.when(F.col("key") % 5 < 2, F.coalesce("computed", F.lit("-"))).otherwise("-").alias("computed"))


P8 = """
WITH x AS (SELECT l_orderkey AS k, min(CAST(floor(l_extendedprice * 10) AS BIGINT)) AS lo, max(CAST(floor(l_extendedprice * 10) AS BIGINT)) AS hi FROM lineitem GROUP BY 1),
y AS (SELECT *, k // 5 % 3 AS shift, CASE WHEN k % 29 = 0 THEN 0 WHEN k % 5 = 3 THEN lo ELSE hi END AS b, CASE WHEN k % 5 = 3 THEN hi ELSE lo END AS c FROM x),
z AS (SELECT *, CASE WHEN k % 5 = 0 THEN lo + shift WHEN k % 5 = 1 THEN lo + hi + shift WHEN b = 0 THEN shift ELSE abs(c - b) * 1000 // b + 20 * shift END AS r FROM y),
f AS (SELECT *, CASE WHEN k % 37 = 0 THEN 'observation_missing' WHEN k % 41 = 0 THEN 'claim_source_unresolved' WHEN k % 43 = 0 THEN 'source_issue_unresolved' WHEN k % 47 = 0 THEN 'footnote_conditions_unresolved' WHEN k % 31 = 0 THEN 'value_missing_or_unresolved'
  WHEN k % 53 = 0 THEN 'reporting_period_unresolved' WHEN k % 5 = 4 AND k % 71 = 0 THEN 'product_comparison_unaccepted' WHEN k % 5 IN (2, 3) AND k % 59 = 0 OR k % 5 = 4 AND k % 61 = 0 AND k % 59 <> 0 OR k % 67 = 0 THEN 'dimension_mismatch'
  WHEN k % 5 = 1 AND k % 73 = 0 THEN 'aggregation_relation_unresolved' WHEN k % 5 > 1 AND b = 0 THEN 'zero_baseline_interval' END AS reason FROM z),
m AS (SELECT *, CASE WHEN k % 5 < 2 THEN shift < 2 WHEN k % 5 = 3 THEN 2000 * ((2 * c - 1) - (2 * b + 1)) <= (2 * r + 1) * (2 * b + 1) AND 2000 * ((2 * c + 1) - (2 * b - 1)) >= (2 * r - 1) * (2 * b - 1)
  ELSE 2000 * ((2 * b - 1) - (2 * c + 1)) <= (2 * r + 1) * (2 * b - 1) AND 2000 * ((2 * b + 1) - (2 * c - 1)) >= (2 * r - 1) * (2 * b + 1) END AS meets,
  CASE WHEN k % 5 = 0 THEN lo WHEN k % 5 = 1 THEN lo + hi END AS v, CAST(1000000000000000000000000000000 AS HUGEINT) % CAST(CASE WHEN b = 0 THEN 1 ELSE b // gcd(abs(c - b) * 100, b) END AS HUGEINT) = 0 AS finite FROM f)
SELECT k AS key, CASE WHEN reason IN ('reporting_period_unresolved', 'product_comparison_unaccepted', 'dimension_mismatch', 'aggregation_relation_unresolved') THEN 'not_comparable' WHEN reason IS NOT NULL THEN 'not_computable' WHEN meets THEN 'consistent' ELSE 'inconsistent' END AS status,
  CASE WHEN reason IS NOT NULL THEN reason WHEN k % 5 > 1 AND NOT finite THEN 'non_terminating_decimal' ELSE '-' END AS reason, CASE WHEN reason IS NOT NULL OR k % 5 > 1 THEN '-' WHEN v % 10 = 0 THEN CAST(v // 10 AS VARCHAR) ELSE v // 10 || '.' || v % 10 END AS computed FROM m
"""

STATES = {"present": 0, "absent": 1, "unknown": 2, "conflict": 3}


def _state(k, a: int, b: int):
    """A state by key: present, absent, unknown or conflict in turn."""
    n = F.pmod(F.floor(k / a) + k * b, F.lit(4))
    return F.when(n == 0, "present").when(n == 1, "absent").when(n == 2, "unknown").otherwise("conflict")


def _state_sql(a: int, b: int) -> str:
    return f"CASE (CAST(floor(k / {a}) AS BIGINT) + k * {b}) % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'absent' WHEN 2 THEN 'unknown' ELSE 'conflict' END"


EXTRA = {"comparison_basis": (3, 1), "external_verification": (5, 1), "categorical_ordinal": (2, 1), "certification_provider": (7, 3), ladder.PRODUCT_DIRECT: (11, 1)}


def _flags(k):
    return [
        F.when(k % 29 == 0, "forecast").cast("string").alias("safe_harbor_category"), F.when(k % 11 < 4, "best of all").otherwise("").alias("superlative_quote"), (k % 2 == 0).alias("superlative_bound"),
        F.when(k % 11 < 6, F.when(k % 13 == 0, "unknown").otherwise("present")).cast("string").alias("has_superlative"), (k % 7 == 0).alias("product_variant"),
    ]


def _exceptions(track):
    def run(spark, d):
        k = F.col("k")
        x = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).select("k", *_flags(k), *[_state(k, *v).alias(n) for n, v in EXTRA.items()])
        if track != "management":
            x = x.withColumn("categorical_ordinal", F.when(k % 3 != 0, F.col("categorical_ordinal")))
        e = x.select("k", ladder.exceptions(track).alias("e"))
        joined = lambda c: F.concat_ws(",", f"e.{c}").alias(c)
        return e.select("k", F.coalesce("e.override", F.lit("-")).alias("override"), F.coalesce("e.cap", F.lit("-")).alias("cap"), joined("gaps"), joined("unresolved"), joined("rules"), F.coalesce("e.ordinal", F.lit("-")).alias("ordinal"))

    return run


def _exceptions_sql(track: str) -> str:
    states = ", ".join(f"{_state_sql(*v)} AS {n}" for n, v in EXTRA.items())
    direct = ladder.PRODUCT_DIRECT
    own = {
        "performance": ("CASE WHEN k % 7 = 0 THEN 'GAP-007' ELSE '' END", "''", "CASE WHEN k % 3 <> 0 THEN 'CATEGORICAL_ORDINAL' ELSE '' END", "'-'", "CASE WHEN k % 3 = 0 THEN '-' WHEN categorical_ordinal = 'present' AND certification_provider = 'present' THEN 'present' WHEN categorical_ordinal = 'absent' OR certification_provider = 'absent' THEN 'absent' WHEN categorical_ordinal = 'conflict' OR certification_provider = 'conflict' THEN 'conflict' ELSE 'unknown' END"),
        "management": (f"CASE WHEN k % 7 = 0 AND {direct} = 'present' THEN 'GAP-007' ELSE '' END", f"CASE WHEN k % 7 = 0 AND {direct} IN ('unknown', 'conflict') THEN '{direct}' ELSE '' END", f"CASE WHEN k % 7 = 0 AND {direct} = 'absent' THEN 'PRODUCT_NAMES_CAP' ELSE '' END", f"CASE WHEN k % 7 = 0 AND {direct} = 'absent' THEN 'E1' ELSE '-' END", "'-'"),
    }[track]
    return f"""WITH s AS (SELECT k, {states} FROM (SELECT c_custkey AS k FROM customer)), q AS (SELECT *, k % 11 < 6 AS said, k % 11 < 4 AND k % 13 <> 0 AND k % 2 = 0 AS bound FROM s),
p AS (SELECT *, said AND NOT bound AS loose, said AND bound AND comparison_basis = 'absent' AND external_verification = 'absent' AS over, said AND bound AND comparison_basis <> 'present' AND external_verification <> 'present' AND NOT (comparison_basis = 'absent' AND external_verification = 'absent') AS half FROM q),
u AS (SELECT *, CASE WHEN loose THEN 'has_superlative' WHEN half THEN array_to_string(list_filter([CASE WHEN comparison_basis <> 'absent' THEN 'comparison_basis' END, CASE WHEN external_verification <> 'absent' THEN 'external_verification' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS sup, {own[1]} AS prod FROM p)
SELECT k, CASE WHEN k % 29 <> 0 AND over THEN 'E0' ELSE '-' END AS override, CASE WHEN k % 29 = 0 OR over THEN '-' ELSE {own[3]} END AS cap, CASE WHEN k % 29 = 0 THEN CASE WHEN said THEN 'GAP-001,GAP-006' ELSE 'GAP-001' END WHEN over THEN '' ELSE {own[0]} END AS gaps,
CASE WHEN k % 29 = 0 OR over THEN '' WHEN sup <> '' AND prod <> '' THEN sup || ',' || prod ELSE sup || prod END AS unresolved, CASE WHEN k % 29 = 0 THEN '' WHEN over THEN 'SUPERLATIVE_E0' ELSE {own[2]} END AS rules, CASE WHEN k % 29 = 0 OR over THEN '-' ELSE {own[4]} END AS ordinal FROM u"""


GOAL_EXTRA = {"offset_plan": (13, 1), "science_based_verification": (17, 1), "offset_or_carbon_neutral_claim": (19, 1), "science_based_claim": (23, 1), "comparison_basis": (3, 1), "external_verification": (5, 1)}


def p10_goal_decision(spark, d):
    """The whole decision on goals: ladder, elements with their triggers, exceptions."""
    k = F.col("c_custkey")
    x = decisions._facts(spark, d, "goal").select("*", *_flags(k), *[_state(k, *v).alias(n) for n, v in GOAL_EXTRA.items()])
    out = ladder.decisions(x, "c_custkey", "goal")
    dash = lambda c: F.coalesce(c, F.lit("-")).alias(c)
    return out.select("c_custkey", "status", dash("grade"), dash("label"), dash("sublabel"), dash("floor"), dash("ceiling"), *[F.concat_ws(",", c).alias(c) for c in ("gaps", "missing", "unresolved", "excluded", "rules")])


def _goal_decision_sql() -> str:
    facts = decisions._fact_sql(ladder.GOAL_FACTS)
    extra = ", ".join(f"{_state_sql(*v).replace('k ', 'c_custkey ').replace('(k', '(c_custkey').replace('+ k', '+ c_custkey')} AS {n}" for n, v in GOAL_EXTRA.items())
    lists = {"missing": [], "unresolved": [], "excluded": []}
    for element, names in ladder.ELEMENTS["goal"].items():
        trigger = ladder.TRIGGERS.get(element)
        out = f"{trigger} = 'absent'" if trigger else "false"
        unsure = " OR ".join([*(f"{n} NOT IN ('present', 'absent')" for n in names), *([f"{trigger} <> 'present'"] if trigger else [])])
        lists["excluded"].append(f"CASE WHEN {out} THEN '{element}' END")
        lists["unresolved"].append(f"CASE WHEN NOT ({out}) AND ({unsure}) THEN '{element}' END")
        lists["missing"].append(f"CASE WHEN NOT ({out}) AND NOT ({unsure}) AND ({' OR '.join(f'{n} = ' + repr('absent') for n in names)}) THEN '{element}' END")
    joined = ", ".join(f"array_to_string(list_filter([{', '.join(v)}], lambda x: x IS NOT NULL), ',') AS {n}" for n, v in lists.items())
    absent = " AND ".join(f"{n} = 'absent'" for e in ("G3", "G4", "G5", "G6") for n in ladder.ELEMENTS["goal"][e])
    exception = _exceptions_sql("performance").replace("CASE WHEN k % 3 <> 0 THEN 'CATEGORICAL_ORDINAL' ELSE '' END", "''")
    return f"""WITH l AS ({decisions.ladder_sql("goal")}), e AS ({exception}), f0 AS (SELECT c_custkey, {facts}, {extra} FROM customer), f AS (SELECT c_custkey, {joined}, {absent} AS bare FROM f0),
j AS (SELECT l.*, e.override, e.gaps AS egaps, e.unresolved AS eopen, e.rules, f.missing, f.unresolved AS fopen, f.excluded, f.bare FROM l JOIN e ON e.k = l.c_custkey JOIN f USING (c_custkey)),
s AS (SELECT *, CASE WHEN egaps <> '' THEN 'blocked_rule_gap' WHEN eopen <> '' THEN 'blocked_evidence' WHEN override <> '-' THEN 'decided' ELSE status END AS final, CASE WHEN fopen <> '' AND eopen <> '' THEN fopen || ',' || eopen ELSE fopen || eopen END AS every FROM j),
g AS (SELECT *, CASE WHEN final <> 'decided' THEN '-' WHEN override <> '-' THEN override ELSE grade END AS own FROM s),
n AS (SELECT *, own = 'E1' AND bare AND missing = 'G3,G4,G5,G6' AND every = '' AND excluded = 'G7,G8' AS sample FROM g)
SELECT c_custkey, final AS status, own AS grade, CASE own WHEN '-' THEN '-' WHEN 'E0' THEN 'UNSUBSTANTIATED' WHEN 'E3' THEN 'SUBSTANTIATED' ELSE 'INCOMPLETE' END AS label, CASE WHEN sample THEN 'IMPL' ELSE '-' END AS sublabel,
CASE WHEN final = 'blocked_evidence' AND eopen = '' THEN floor ELSE '-' END AS floor, CASE WHEN final = 'blocked_evidence' AND eopen = '' THEN ceiling ELSE '-' END AS ceiling,
array_to_string(list_sort(list_distinct(list_filter(string_split(egaps, ',') || [CASE WHEN status = 'blocked_rule_gap' AND override = '-' THEN 'GAP-007' ELSE '' END, CASE WHEN own IN ('E1', 'E2') AND NOT sample THEN 'GAP-005' ELSE '' END], lambda x: x <> ''))), ',') AS gaps, missing, every AS unresolved, excluded, rules FROM n"""


def a4_partial_facts(spark, d):
    """Lines as votes of three replicas on elements of an order; some replicas fail, some votes are not bound."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    state = F.when(k % 7 == 0, "conflict").when(k % 5 == 0, "absent").when(k % 4 == 0, "unknown").when((k % 3 == 0) & (n % 3 == 2), "absent").otherwise("present")
    votes_ = li.filter((k % 11 != 0) | (n % 3 != 1)).select(
        "l_orderkey", F.floor((n - 1) / 3).cast("int").alias("element"), (n % 3).alias("replicate"), state.alias("state"), F.when(state == "present", "v").alias("value"), F.when(k % 13 != 0, "b").alias("binding"), F.lit("local_claim").alias("scope"), ((k % 17 != 0) | (n % 3 != 0)).alias("verified"),
    )
    out = None
    for profile in votes.PROFILES:
        own = votes.partial_facts(votes_, ["l_orderkey", "element"], profile).withColumn("profile", F.lit(profile))
        out = own if out is None else out.union(own)
    return out


A4 = """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), v AS (SELECT k, (n - 1) // 3 AS element, n, CASE WHEN k % 7 = 0 THEN 'conflict' WHEN k % 5 = 0 THEN 'absent' WHEN k % 4 = 0 THEN 'unknown' WHEN k % 3 = 0 AND n % 3 = 2 THEN 'absent' ELSE 'present' END AS state FROM l WHERE k % 11 <> 0 OR n % 3 <> 1),
a AS (SELECT k, element, count(*) AS votes, count(DISTINCT state) AS kinds, min(state) AS state, bool_and(k % 17 <> 0 OR n % 3 <> 0) AS fine, greatest(count(*) FILTER (state = 'present'), count(*) FILTER (state = 'absent'), count(*) FILTER (state IN ('unknown', 'conflict'))) AS agreement FROM v GROUP BY 1, 2)
SELECT k AS l_orderkey, element, CASE WHEN kinds > 1 THEN 'conflict' WHEN profile = 'v3' AND state = 'conflict' THEN 'conflict' WHEN votes < 3 THEN 'unknown' WHEN state = 'present' AND k % 13 <> 0 AND fine THEN 'present' WHEN profile <> 'v1' AND state = 'conflict' THEN 'conflict' ELSE 'unknown' END AS state, agreement, profile
FROM a CROSS JOIN (VALUES ('v1'), ('v2'), ('v3')) AS p(profile)"""

#: Texts that state a period, by key modulo 7.
PROSE = ("Report of 2024-01-01 ~ 2024-12-31.", "대상 기간은 2023년 1월 1일부터 12월 31일까지입니다.", "FY 2022 and fiscal year 2021", "January 1, 2020 to December 31, 2021", "2024년 3월부터 2024년 5월 까지", "2024.13.01 - 2024.14.02", "no period")
PROSE_SQL = "(VALUES (0, DATE '2024-01-01', DATE '2024-12-31', 'date_range', 0), (1, DATE '2023-01-01', DATE '2023-12-31', 'date_range', 0), (2, DATE '2022-01-01', DATE '2022-12-31', 'fiscal_year_calendar', 0), (2, DATE '2021-01-01', DATE '2021-12-31', 'fiscal_year_calendar', 1), (3, DATE '2020-01-01', DATE '2021-12-31', 'date_range', 0), (4, DATE '2024-03-01', DATE '2024-05-31', 'month_range', 0)) AS t(m, a, b, kind, nth)"


def _prose(spark, d):
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*[F.lit(x) for x in PROSE]), (k % 7 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.posexplode(D.prose_periods(text)).alias("nth", "p")).select("o_orderkey", "o_custkey", "nth", "p.start", "p.end", "p.kind")


def x23_prose_periods(spark, d):
    return _prose(spark, d).drop("o_custkey")


def p26_detected_period(spark, d):
    return D.detected_period(_prose(spark, d).withColumn("end", F.when(F.col("o_orderkey") % 35 != 1, F.col("end"))), "o_custkey").withColumns({"start": F.coalesce(F.col("start").cast("string"), F.lit("-")), "end": F.coalesce(F.col("end").cast("string"), F.lit("-"))})


NOTES = ("unit: tCO2e", "단위 : 천 kWh", "Unit: 3 t", "Scope: Scope 2", " Scope 1 ", "Scope 4", "단위:%p", "FY 2023")


def x12_notes(spark, d):
    """Notes as documents end them: with nothing, with white space of several kinds, or with more of their text."""
    k = F.col("doc_id")
    note = F.element_at(F.array(*[F.lit(x) for x in NOTES]), (F.char_length("text") % 8 + 1).cast("int"))
    text = F.concat(note, F.when(k % 4 == 0, "\u3000\n").when(k % 4 == 1, F.left("text", F.lit(2))).when(k % 4 == 2, "\r\n\t").otherwise(""))
    return table(spark, d, "documents").select(k, F.coalesce(T.unit_note(text), F.lit("-")).alias("unit"), F.coalesce(T.scope_note(text), F.lit("-")).alias("scope"), D.year_literal(text).alias("year"))


def q5_four_routes(spark, d):
    """Index pages, the same section, words and vectors; the claim's own source stands first."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    index = R.listed(docs.withColumn("query_id", F.col("id") % 200).join(items, "query_id", "left_semi").select("query_id", "id"))
    section = R.listed(docs.withColumn("query_id", F.expr("id div 50")).join(items, "query_id", "left_semi").select("query_id", "id"))
    lexical = R.top(retrieval.all_matches(spark, d), 20).select("query_id", "id", "rank")
    v = table(spark, d, "embeddings")
    vector = retrieval.vector_hits(v, v.join(items.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi")).select("query_id", "id", "rank")
    fused = R.fuse([index, section, lexical, vector], 13)
    own = docs.join(items.select(F.col("query_id").alias("id")), "id", "left_semi").select(F.col("id").alias("query_id"), "id", F.lit(0).alias("place"))
    return R.own_first(fused, own, 12).select("query_id", "rank", "id", F.coalesce("score", F.lit(0.0)).alias("score"))


def q7_table_context(spark, d):
    """Orders as tables, their lines as rows; each line has a note below it, and some notes repeat their row's text."""
    lines = sizing.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey")
    li = sizing.staged(lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("text")), "table-rows")
    t, n = F.col("l_orderkey") * 100, F.col("l_linenumber")
    rows = li.select(t.alias("table_id"), (t + n).alias("id"), n.alias("row_no"), "text")
    notes = li.select(t.alias("table_id"), (t + 50 + n).alias("id"), F.lit(None).cast("int").alias("row_no"), F.when(n % 2 == 0, F.col("text")).otherwise("x").alias("text"))
    edges = rows.select(F.col("id").alias("child"), F.col("table_id").alias("parent")).union(notes.select(F.col("id").alias("child"), (F.col("id") - 50).alias("parent")))
    claims_ = li.filter("l_linenumber = 2").select((t + 2).alias("claim"), t.alias("table_id"), F.lit(2).alias("row_no"))
    return R.table_context(claims_, rows.union(notes), edges)


ROUTES = retrieval.BM25 + retrieval.RANKED + retrieval.KNN.format(asked="vec_id IN (SELECT item_id FROM benchmark)").replace("WITH q AS", ", q2 AS").replace("JOIN q ON", "JOIN q2 ON").replace("q.label", "q2.label")

QUERIES = {
    "p6_claim_discovery": (p6_claim_discovery, P6),
    "l1_numbered_documents": (l1_numbered_documents, "SELECT c_custkey AS document, row_number() OVER (ORDER BY CAST(floor(c_acctbal) AS BIGINT), c_custkey) AS ordinal FROM customer WHERE c_custkey % 17 <> 0 AND c_mktsegment = 'BUILDING'"),
    "l2_keyset_page": (l2_keyset_page, "WITH p AS (SELECT o_orderkey AS run, CAST(o_orderdate AS DATE) AS created FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-06-01' OR CAST(o_orderdate AS DATE) = DATE '1996-06-01' AND o_orderkey < 5000), n AS (SELECT *, row_number() OVER (ORDER BY created DESC, run DESC) AS n FROM p) SELECT run, CAST(created AS VARCHAR) AS created, (SELECT count(*) FROM p) > 50 AS more FROM n WHERE n <= 50"),
    "l3_runs_of_documents": (l3_runs_of_documents, "SELECT o_orderkey AS run, o_custkey AS document, o_orderstatus AS status FROM orders WHERE o_custkey % 17 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "l4_reuse_candidates": (l4_reuse_candidates, "SELECT o_custkey AS content, o_orderkey AS run, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS BIGINT) AS candidate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_orderstatus IN ('F', 'P') AND o_orderkey % 3 <> 0 AND o_custkey % 1000 > 100 AND o_custkey % 17 <> 0"),
    "l5_first_history": (l5_first_history, "SELECT o_custkey, count(*) AS revision, max(o_orderkey) AS o_orderkey, min(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))) AS first_row FROM orders GROUP BY 1"),
    "l6_active": (l6_active, "SELECT o_custkey, count(*) AS revision, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1"),
    "l9_spend_check": (l9_spend_check, """WITH r AS (SELECT o_orderkey AS run, year(o_orderdate) AS event, CAST(o_orderdate AS DATE) AS day, nullif(o_custkey % 50, 0) AS grp, o_custkey % 3 = 0 AS capped FROM orders), c AS (SELECT l_orderkey AS run, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS spent FROM lineitem GROUP BY 1),
x AS (SELECT r.*, coalesce(spent, 0) AS spent FROM r LEFT JOIN c USING (run)), w AS (SELECT *, sum(spent) OVER (PARTITION BY event) AS e, sum(spent) OVER (PARTITION BY event, day) AS d, CASE WHEN grp IS NOT NULL THEN sum(spent) OVER (PARTITION BY event, grp) END AS g FROM x)
SELECT run, CAST(spent AS DOUBLE) AS run_total, CAST(d AS DOUBLE) AS day_total, CAST(e AS DOUBLE) AS event_total, CAST(coalesce(g, 0) AS DOUBLE) AS group_total, e + 1000 <= 1000000000000 AND d + 1000 <= 3000000 AND spent + 1000 <= 250000 AND (grp IS NULL OR NOT capped OR g + 1000 <= 20000000) AS admitted FROM w"""),
    "l13_prefix": (l13_prefix, "SELECT source || ':' || doc_id AS key FROM documents WHERE source || ':' || doc_id LIKE 'src1:%' ORDER BY 1"),
    "l15_range_page": (l15_range_page, "SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_id > 500 AND event_id <= 640) > 100 AS more FROM events WHERE event_id > 500 AND event_id <= 640 ORDER BY event_id LIMIT 100"),
    "l16_archive": (l16_archive, "WITH s AS (SELECT year(o_orderdate) AS event, o_orderstatus = 'F' AND date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) < 1500 AS old, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders) SELECT event, count(*) FILTER (NOT old) AS kept, CAST(coalesce(sum(amount) FILTER (NOT old), 0) AS DOUBLE) AS open, CAST(1 + coalesce(sum(amount) FILTER (old), 0) AS DOUBLE) AS archived FROM s GROUP BY 1"),
    "t5_frozen_page": (t5_frozen_page, "SELECT o_orderkey, CAST(day AS VARCHAR) AS day, ordinal FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS ordinal FROM orders) WHERE ordinal > 1000 AND ordinal <= 1100"),
    "p8_numeric_check": (p8_numeric_check, P8),
    "p11_exceptions_performance": (_exceptions("performance"), _exceptions_sql("performance")),
    "p11_exceptions_management": (_exceptions("management"), _exceptions_sql("management")),
    "p10_goal_decision": (p10_goal_decision, _goal_decision_sql()),
    "a4_partial_facts": (a4_partial_facts, A4),
    "x23_prose_periods": (x23_prose_periods, f"SELECT o_orderkey, nth, CAST(a AS VARCHAR) AS start, CAST(b AS VARCHAR) AS \"end\", kind FROM orders JOIN {PROSE_SQL} ON o_orderkey % 7 = m"),
    "p26_detected_period": (p26_detected_period, f"WITH c AS (SELECT o_custkey, a, CASE WHEN o_orderkey % 35 <> 1 THEN b END AS b FROM orders JOIN {PROSE_SQL} ON o_orderkey % 7 = m), g AS (SELECT o_custkey, count(DISTINCT CASE WHEN b IS NOT NULL THEN a || '/' || b END) AS n, bool_or(b IS NULL) AS open, min(a) AS a, min(b) AS b FROM c GROUP BY 1) SELECT o_custkey, CASE WHEN n = 1 AND NOT open THEN 'detected' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 AND NOT open THEN CAST(a AS VARCHAR) ELSE '-' END AS start, CASE WHEN n = 1 AND NOT open THEN CAST(b AS VARCHAR) ELSE '-' END AS \"end\" FROM g"),
    "x12_notes": (x12_notes, "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN -1 ELSE length(text) % 8 END AS k FROM documents) SELECT doc_id, CASE k WHEN 0 THEN 'tCO2e' WHEN 1 THEN '천 kWh' WHEN 6 THEN '%p' ELSE '-' END AS unit, CASE k WHEN 3 THEN 'Scope 2' WHEN 4 THEN 'Scope 1' ELSE '-' END AS scope, CASE k WHEN 7 THEN 2023 ELSE -1 END AS year FROM n"),
    "q5_four_routes": (q5_four_routes, ROUTES + """, i AS (SELECT item_id AS query_id FROM benchmark), r AS (SELECT query_id, id, rank FROM l UNION ALL SELECT query_id, id, rank FROM v
UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM documents JOIN i ON doc_id % 200 = query_id UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM documents JOIN i ON doc_id // 50 = query_id),
g0 AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r GROUP BY query_id, id), g AS (SELECT * FROM g0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 13), o AS (SELECT doc_id AS query_id, doc_id AS id FROM documents WHERE doc_id IN (SELECT query_id FROM i)),
m AS (SELECT coalesce(g.query_id, o.query_id) AS query_id, coalesce(g.id, o.id) AS id, g.score, o.id IS NOT NULL AS own FROM g FULL JOIN o ON g.query_id = o.query_id AND g.id = o.id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY own DESC, score DESC NULLS LAST, id) AS rank, id, coalesce(score, 0) AS score FROM m QUALIFY rank <= 12"""),
    "q7_table_context": (q7_table_context, """WITH l AS (SELECT l_orderkey, l_linenumber AS n, max(l_returnflag) AS text FROM lineitem GROUP BY ALL), c AS (SELECT l_orderkey FROM l WHERE n = 2)
SELECT l_orderkey * 100 + 2 AS claim, l_orderkey * 100 + n AS id, CASE WHEN n > 2 THEN 'later' ELSE 'kept' END AS role FROM l JOIN c USING (l_orderkey)
UNION ALL SELECT l_orderkey * 100 + 2, l_orderkey * 100 + 50 + n, CASE WHEN n > 2 THEN 'later' WHEN n = 2 THEN 'repeated' ELSE 'kept' END FROM l JOIN c USING (l_orderkey)
UNION ALL SELECT l_orderkey * 100 + 2, l_orderkey * 100, 'context' FROM c"""),
}
