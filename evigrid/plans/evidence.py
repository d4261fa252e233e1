"""Eligibility, anchors, packets, scoped decisions, worlds and hand-offs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import admission as M
from evigrid.operators import missing, records, sets, sizing, splitting
from evigrid.operators import retrieval as R
from evigrid.plans import structure
from evigrid.plans.admissions import SCOPES
from evigrid.sources.tables import table

GRAMMAR = splitting.Grammar()


def f5_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Which sentences of texts in the grammar's words may hold a claim; some count as cells with axes."""
    docs = sizing.dealt(table(spark, d, "documents").select("doc_id", "text"), "doc_id", each=4 << 20).select("doc_id", structure.told(F.col("text")).alias("text"))
    s = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "s"))
    cell = F.col("n") % 11 == 3
    value = F.when(cell, F.concat(F.lit("1,"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.when(F.col("n") % 2 == 0, "톤").otherwise(""))).when(F.col("n") % 17 == 5, F.concat(F.lit("GRI 1 "), "s")).when(F.col("n") % 13 == 7, F.concat(F.lit("auditor, sampling: "), "s")).otherwise(F.col("s"))
    axes = F.when(cell & (F.col("doc_id") % 3 == 0), F.array(F.lit("온실가스 2024년"), F.lit("kg"))).when(cell & (F.col("doc_id") % 3 == 1), F.array(F.lit("온실가스"))).otherwise(F.array().cast("array<string>"))
    kind = F.when(cell, "table_cell").otherwise("paragraph")
    return s.select("doc_id", "n", splitting.selectable_text(value, kind, axes).alias("eligible"))


def q10_anchors(spark, d):
    """Anchors of whole documents, as if each were a claim."""
    a = structure._docs(spark, d).select("doc_id", missing.anchors(F.concat("text", F.lit(" 2024 Scope 1 tCO2e"))).alias("a"))
    return a.select("doc_id", F.size("a.metric").cast("long").alias("metrics"), F.sha2(F.array_join("a.metric", ","), 256).alias("metric_sha256"), F.array_join("a.period", ",").alias("period"), F.array_join("a.boundary", ",").alias("boundary"))


def u8_worlds(spark, d):
    """An order's unreturned lines as unknown facts, and all ways in which they can turn out."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "N", F.concat(F.lit("L"), "l_linenumber"))).alias("unknown"))
    w = sets.worlds(o, "unknown")
    return w.select("l_orderkey", "world", F.array_join(F.array_sort(F.map_keys(F.map_filter("facts", lambda k, v: v))), ",").alias("true_facts"))


def s20_handoff(spark, d):
    """Orders as results; of some another state, of some nothing, was published before."""
    o = table(spark, d, "orders").groupBy("o_orderkey").agg(F.max("o_custkey").alias("c"), F.max("o_orderstatus").alias("s"), F.max("o_orderpriority").alias("p"))
    before = o.filter("c % 5 > 0").withColumn("s", F.when(F.col("c") % 7 == 0, "P").otherwise(F.col("s")))
    out = records.handed_off(o, before, "o_orderkey", ["o_orderkey", "c", "s"])
    return out.select("o_orderkey", "seal", "state")


def s21_reuse(spark, d):
    """Documents asked for again: the same text, language, source and period make the same key."""
    x = table(spark, d, "documents").select("doc_id", F.md5("text").alias("pdf"), F.col("lang").alias("policy"), F.coalesce("source", F.lit("-")).alias("selection"), F.lit("2024").alias("period"))
    done = x.filter("doc_id % 2 = 0").select("pdf", "policy", "selection", "period", F.col("doc_id").alias("result"), (F.col("doc_id") % 3 > 0).alias("ready"), F.col("doc_id").alias("at"))
    new = x.filter("doc_id % 2 = 1").unionAll(x.filter("doc_id % 10 = 0"))
    return records.reusable(new, done, ["pdf", "policy", "selection", "period"]).select("doc_id", "reused", "state")


def p7_packet(spark, d):
    """Orders as claims with their first line's part as own source; parts of their lines as hits; brands as tables."""
    lines = sizing.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_suppkey"), "l_orderkey")
    li = lines.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("p")).agg(F.min("l_linenumber").alias("n"), F.max("l_quantity").alias("score"), F.max("l_suppkey").alias("s"))
    first = li.groupBy("q").agg(F.min_by(F.struct("p", "n", "s"), F.struct("n", "p")).alias("f")).select("q", "f.*")
    claims = first.select(F.col("q").alias("claim"), F.col("p").alias("source_id"), F.lit(1).alias("place"), (F.col("s") % 10 > 0).alias("verified"), F.lit("t").alias("tenant"))
    part = table(spark, d, "part").groupBy("p_partkey").agg(F.max("p_brand").alias("root"), F.max("p_size").alias("size"))
    blocks = part.select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_partkey") % 23 == 0, "other").otherwise("t").alias("tenant"), F.md5(F.col("p_partkey").cast("string")).alias("text_hash"), (F.col("size") * 60).alias("tokens"), (F.col("size") * 10).alias("shared"))
    fused = li.select(F.col("q").alias("query_id"), F.col("p").alias("id"), "score", F.md5(F.when(F.col("s") % 13 == 0, "?").otherwise(F.col("p").cast("string"))).alias("hash"))
    tables = part.select(F.col("p_partkey").alias("source_id"), "root")
    out = R.packets(claims, fused, blocks, tables, spark.createDataFrame(SCOPES, "element string, scopes array<string>"), ["tenant"], total=6000)
    shown = F.transform("candidates", lambda c: F.concat_ws(":", c["rank"], c["id"], c["scope"], F.array_join(c["elements"], "+"), c["state"]))
    return out.select("claim", "blocked", F.array_join(shown, ",").alias("candidates"), F.array_join(F.transform("rejected", lambda x: x.cast("string")), ",").alias("rejected"))


POLICIES = ("v1", "v2")


def p14_scoped_decisions(spark, d):
    """Orders as decisions, returned lines as facts absent in a scope; in some another thing is wrong with the scope."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim"), F.concat(F.lit("f"), "l_linenumber").alias("fact"), F.when(F.col("l_returnflag") == "R", "absent_in_scope").when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 5 == 0), "conflict").otherwise("present").alias("state"))
    o, c, k = table(spark, d, "orders").groupBy("o_orderkey").agg(F.max("o_custkey").alias("c"), F.max("o_orderstatus").alias("s")), F.col("c"), F.col("o_orderkey")
    decisions = o.select(k.alias("claim"), c.alias("doc"), F.when(F.col("s") == "P", "blocked_evidence").otherwise("decided").alias("status"), F.concat(F.lit("E"), k % 4).alias("grade"))
    named = li.filter("state = 'absent_in_scope'").groupBy(F.col("claim").alias("o_orderkey")).agg(F.collect_set("fact").alias("absent"))
    pages = F.sequence(F.lit(1), (k % 3 + 1).cast("int"))
    scopes = o.filter("c % 17 <> 1").join(named, "o_orderkey", "left").select(
        k.alias("claim"), F.when(c % 17 == 2, c + 1).otherwise(c).alias("doc"), F.when(c % 17 != 3, "run").alias("run"), F.when(c % 17 == 4, F.array().cast("array<int>")).otherwise(pages).alias("selected"), F.when(c % 17 == 5, F.array(F.lit(99))).otherwise(F.when(c % 17 == 4, F.array().cast("array<int>")).otherwise(pages)).alias("inspected"),
        F.when(c % 17 == 6, "v9").otherwise("v2").alias("policy"), F.when(c % 17 == 7, F.array(F.lit("f1"), F.lit("f99"))).otherwise(F.col("absent")).alias("absent"), F.lit("r").alias("receipt"),
    )
    out = M.scoped_decisions(decisions, scopes, li, POLICIES)
    return out.select("claim", "status", "confirmed", F.col("basis").isNotNull().alias("has_basis"), F.coalesce("reason", F.lit("-")).alias("reason"))


QUERIES = {
    "f5_eligibility": (f5_eligibility, None),
    "q10_anchors": (q10_anchors, r"""WITH t AS (SELECT doc_id, text || ' 2024 Scope 1 tCO2e' AS q FROM documents), a AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(q, '(?i)Scope\s*[123]'))) AS bounds,
list_sort(list_distinct(list_filter(regexp_extract_all(q, '[A-Za-z][A-Za-z0-9-]*'), lambda x: len(x) >= 2 AND NOT regexp_full_match(x, '(?i)scope|tCO2(?:eq|e)?|MWh|GWh|MW|kWh|kg|tons|tonnes')))) AS metrics, list_sort(list_distinct(list_filter(regexp_extract_all(q, '[0-9]+'), lambda x: regexp_full_match(x, '(?:19|20)[0-9]{2}')))) AS periods FROM t)
SELECT doc_id, len(metrics) AS metrics, sha256(array_to_string(metrics, ',')) AS metric_sha256, array_to_string(periods, ',') AS period, array_to_string(bounds, ',') AS boundary FROM a"""),
    "u8_worlds": (u8_worlds, """WITH o AS (SELECT l_orderkey, coalesce(list_sort(list_distinct(list('L' || l_linenumber) FILTER (l_returnflag = 'N'))), []) AS u FROM lineitem GROUP BY 1), w AS (SELECT l_orderkey, u, unnest(range(CAST(pow(2, len(u)) AS BIGINT))) AS world FROM o)
SELECT l_orderkey, world, array_to_string(list_filter(u, lambda x, i: (world >> (i - 1)) & 1 = 1), ',') AS true_facts FROM w"""),
    "s20_handoff": (s20_handoff, """WITH o AS (SELECT o_orderkey, max(o_custkey) AS c, max(o_orderstatus) AS s FROM orders GROUP BY 1) SELECT o_orderkey, sha256('{"c":' || c || ',"o_orderkey":' || o_orderkey || ',"s":"' || s || '"}') AS seal, CASE WHEN c % 5 = 0 THEN 'new' WHEN c % 7 = 0 AND s <> 'P' THEN 'replaced' ELSE 'unchanged' END AS state FROM o"""),
    "s21_reuse": (s21_reuse, """WITH x AS (SELECT doc_id, text, lang, coalesce(source, '-') AS source FROM documents), d AS (SELECT text, lang, source, max(doc_id) FILTER (doc_id % 3 > 0) AS best FROM x WHERE doc_id % 2 = 0 GROUP BY ALL),
n AS (SELECT * FROM x WHERE doc_id % 2 = 1 UNION ALL SELECT * FROM x WHERE doc_id % 10 = 0) SELECT doc_id, coalesce(best, -1) AS reused, CASE WHEN d.text IS NULL THEN 'missing' WHEN best IS NULL THEN 'not_ready' ELSE 'reused' END AS state FROM n LEFT JOIN d ON n.text = d.text AND n.lang IS NOT DISTINCT FROM d.lang AND n.source = d.source"""),
    "p7_packet": (p7_packet, None),
    "p14_scoped_decisions": (p14_scoped_decisions, """WITH f AS (SELECT l_orderkey AS claim, count(*) FILTER (l_returnflag = 'R') > 0 AS has_absent, bool_or(l_returnflag = 'A' AND l_partkey % 5 = 0) AS conflict FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS claim, max(o_custkey) AS c, max(o_orderstatus) AS s FROM orders GROUP BY 1), x AS (SELECT o.*, coalesce(has_absent, false) AS has_absent, coalesce(conflict, false) AS conflict FROM o LEFT JOIN f USING (claim)),
r AS (SELECT claim, s, CASE WHEN c % 17 = 1 THEN 'scope_missing' WHEN c % 17 = 2 THEN 'scope_of_another_document' WHEN c % 17 = 3 THEN 'run_missing' WHEN c % 17 = 4 THEN 'no_pages_selected' WHEN c % 17 = 5 THEN 'pages_not_inspected' WHEN c % 17 = 6 THEN 'policy_unknown' WHEN conflict THEN 'fact_in_conflict' WHEN c % 17 = 7 THEN 'absent_facts_differ' WHEN NOT has_absent THEN 'no_absent_facts' ELSE '-' END AS reason FROM x)
SELECT claim, CASE WHEN s = 'P' THEN 'blocked_evidence' ELSE 'decided' END AS status, reason = '-' AND s <> 'P' AS confirmed, reason = '-' AND s <> 'P' AS has_basis, reason FROM r"""),
}
