"""Job states, pages, spans and other composites over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import graph, records
from evigrid.operators import sets as S
from evigrid.operators import windows as W
from evigrid.sources.tables import table
from evigrid.streaming import jobs


def z1_leases(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as the lease traffic of one job, folded by the same step as the stream."""
    k = F.col("event_id")
    action = F.when(F.col("event_type") == "purchase", "commit").when(F.col("event_type") == "click", "heartbeat").when(k % 11 == 3, "fail").otherwise("claim")
    # events a few minutes apart become seconds apart, so that leases are met while they run
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), k.alias("seq"), F.floor(F.unix_timestamp("ts") / 600).alias("at"), F.concat(F.lit("w"), k % 2).alias("owner"), action.alias("action"), (1 + k % 2).alias("token"))
    return jobs.replayed(e).select("job", "seq", "token", "verdict")


def z5_outbox(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_timestamp("ts").alias("due"), "event_type")
    return jobs.pending(e, e.filter("event_type = 'view'"), 1_705_000_000).select("event_id", "due")


def z6_delivery_once(spark, d):
    """An event's receives; the first is acknowledged for some."""
    e = table(spark, d, "events").select(F.col("event_id").alias("message"), F.explode(F.sequence(F.lit(0), (F.col("event_id") % 7).cast("int"))).alias("n"))
    return records.deliveries(e.withColumn("ack", (F.col("message") % 3 == 0) & (F.col("n") == 0)), "message", "ack")


def z10_page_ready(spark, d):
    c = table(spark, d, "conversations").select("conv_id", (F.char_length("text") > 40).alias("done"))
    return records.ready(c, c.filter("conv_id % 5 = 0").select("conv_id").distinct(), ["conv_id"], "done")


def sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def p20_page_plan(spark, d):
    """Pages (documents of a source) ranked by signal: capped per source, claims first, at most 10 in all per source."""
    x = table(spark, d, "documents").select("source", "doc_id", F.regexp_count("text", F.lit("tion")).cast("long").alias("signal"), F.round(F.regexp_count("text", F.lit("the")) * 1000.0 / F.greatest(F.char_length("text"), F.lit(200)), 6).alias("density"))
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("signal"), F.desc("density"), "doc_id"))
    return x.withColumn("place", r).filter("place <= 10")


def p25_section_map(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.datediff("ts", F.lit("2024-01-01")).alias("page"), F.lit(400).alias("last"))
    return records.section_map(e, "user_id", "page", "event_type", "last")


def p28_safe_harbor(spark, d):
    """Order priorities as the statements that a customer's record must hold."""
    o = table(spark, d, "orders")
    out = records.checklist(o, ["o_custkey"], "o_orderpriority", ["1-URGENT", "3-MEDIUM", "5-LOW"])
    return out.select("o_custkey", F.array_join("missing", ",").alias("missing"), "complete")


def p29_tombstones(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return records.retention(o.drop("o_orderstatus"), gone, o.filter("o_orderstatus = 'P'").select("o_orderkey"), "o_custkey", "o_orderkey")


def p27_rescore(spark, d):
    known = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("known"))
    need = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return known.select("l_orderkey", F.array_join(F.array_except(need, "known"), ",").alias("retag"), S.subset(need, F.col("known")).alias("rescorable"))


def p22_report_credit(spark, d):
    """A source has credit with verified documents of an index, a coverage and a standard."""
    x = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1"), "doc_id")
    kind = F.element_at(F.array(F.lit("index"), F.lit("coverage"), F.lit("standard"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int"))
    out = records.checklist(x.withColumn("kind", kind), ["source"], "kind", ["index", "coverage", "standard"])
    return out.select("source", F.array_join("missing", ",").alias("missing"), F.col("complete").alias("credit"))


def p30_review(spark, d):
    o = table(spark, d, "orders")
    reviews = o.select("o_custkey", F.col("o_orderkey").alias("at"), (1 + F.col("o_orderkey") % 3).alias("expected"), F.col("o_orderstatus").alias("resolution"))
    return records.reviewed(reviews, o.select("o_custkey", F.lit(1).alias("revision")).distinct(), ["o_custkey"]).withColumnRenamed("at", "seq")


def r2_note_targets(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    notes = n.select(F.concat(F.lit("note-"), "child").alias("note"), F.col("child").alias("target")).union(n.select(F.concat(F.lit("note-"), "parent"), "parent").distinct())
    return graph.note_targets(s.select(F.col("child").alias("id")), s.union(n), notes)


def r3_nearest_section(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    heads = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("title")).union(table(spark, d, "region").filter("r_regionkey < 3").select(F.concat(F.lit("r"), "r_regionkey"), "r_name"))
    out = graph.nearest_section(s.select(F.col("child").alias("id")), s.union(n), heads)
    return out.select("id", F.coalesce("section", F.lit("-")).alias("section"), F.coalesce("title", F.lit("-")).alias("title"))


def j26_bound_facts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("raw"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("unit"), F.col("o_custkey").alias("kind"))
    return records.bound(o, o.filter("o_orderkey % 2 = 0"), ["raw", "unit", "kind"]).select("o_orderkey", "bound")


def f6_batch(spark, d):
    x = table(spark, d, "documents").filter("lang = 'en'").select("doc_id", "n_chars")
    return records.batch(x, table(spark, d, "labels").select("doc_id"), "doc_id", ["n_chars", "doc_id"], 50)


def f11_search_complete(spark, d):
    """Turns as pages of a conversation; long ones are readable."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max(F.char_length("text")).alias("n"))
    sets = c.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.col("turn") + 1)).alias("searched"), F.array_sort(F.collect_set(F.when(F.col("n") > 30, F.col("turn") + 1))).alias("readable"), F.max(F.col("turn") + 1).alias("pages"))
    return sets.select("conv_id", records.search_complete(F.col("searched"), F.col("readable"), F.array_except("searched", "readable"), F.col("pages")).alias("complete"))


def t4_ranked_evidence(spark, d):
    x = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("lang") == "en", 1).otherwise(2).alias("priority"), "n_chars")
    return records.ranked_evidence(x, x.filter("doc_id % 50 = 0"), ["source"], "doc_id", "priority", "n_chars")


def a17_report(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").cast("string").alias("t"), F.when(F.col("doc_id") % 9 == 0, None).when(F.col("text").rlike(r"!!|\*\*\*"), "0").otherwise("1").alias("p"))
    out = records.classification_report(x, "t", "p", ["0", "1"])
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("coverage", "accuracy", "majority", "macro_f1", "selective_f1")])


def j24_continuations(spark, d):
    c = table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"])
    parts = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("h")))), lambda x: x["h"]), "").alias("joined"))
    return parts.select("conv_id", F.md5("joined").alias("digest"))


def x10_normal_forms(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    return x.select("doc_id", F.md5(T.citation_form(F.col("t"))).alias("citation"), F.md5(T.nfc(F.col("t"))).alias("nfc"))


def x40_signature(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2(F.to_json(F.struct("p_brand", "p_name", "p_size")), 256).alias("signature"))


def x41_json_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k is not null and k > 50")


def cube_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count("*").alias("n"))


QUERIES = {
    "z1_leases": (z1_leases, """WITH RECURSIVE e AS (SELECT user_id AS job, event_id AS seq, CAST(floor(floor(epoch(ts)) / 600) AS BIGINT) AS tick, 'w' || (event_id % 2) AS owner, CASE WHEN event_type = 'purchase' THEN 'commit' WHEN event_type = 'click' THEN 'heartbeat' WHEN event_id % 11 = 3 THEN 'fail' ELSE 'claim' END AS action, 1 + event_id % 2 AS given,
  row_number() OVER (PARTITION BY user_id ORDER BY floor(floor(epoch(ts)) / 600), event_id) AS n FROM events),
s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, '' AS holder, CAST(0 AS BIGINT) AS token, CAST(0 AS BIGINT) AS expires, 'pending' AS state, CAST(0 AS BIGINT) AS due, CAST(0 AS BIGINT) AS attempts, '' AS verdict FROM e
UNION ALL
SELECT job, n, seq, CASE verdict WHEN 'claimed' THEN owner WHEN 'pending' THEN '' WHEN 'failed' THEN '' ELSE holder END, CASE WHEN verdict = 'claimed' THEN token + 1 ELSE token END, CASE WHEN verdict IN ('claimed', 'renewed') THEN tick + 120 ELSE expires END,
  CASE WHEN verdict IN ('failed', 'committed') THEN verdict ELSE state END, CASE WHEN verdict IN ('pending', 'failed') THEN tick + CAST(pow(2, attempts) AS BIGINT) ELSE due END, CASE WHEN verdict = 'claimed' THEN attempts + 1 ELSE attempts END, verdict
FROM (SELECT e.*, s.holder, s.token, s.expires, s.state, s.due, s.attempts, CASE WHEN s.state <> 'pending' THEN 'refused_' || s.state
    WHEN e.action = 'claim' THEN CASE WHEN s.holder <> '' AND e.tick < s.expires THEN 'refused_leased' WHEN e.tick < s.due THEN 'refused_waiting' ELSE 'claimed' END
    WHEN s.holder = '' OR e.tick >= s.expires OR e.owner <> s.holder OR e.given <> s.token THEN 'refused_fenced' WHEN e.action = 'heartbeat' THEN 'renewed' WHEN e.action = 'fail' THEN CASE WHEN s.attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE 'committed' END AS verdict
  FROM s JOIN e ON e.job = s.job AND e.n = s.n + 1))
SELECT job, seq, token, verdict FROM s WHERE n > 0"""),
    "z5_outbox": (z5_outbox, "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS due FROM events WHERE epoch(ts) < 1705000001 AND event_type <> 'view'"),
    "z6_delivery_once": (z6_delivery_once, "SELECT event_id AS message, event_id % 7 + 1 AS receives, CASE WHEN event_id % 3 = 0 THEN 'handled' WHEN event_id % 7 >= 4 THEN 'dead' ELSE 'pending' END AS state FROM events"),
    "z10_page_ready": (z10_page_ready, "SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_and(coalesce(length(text) > 40, false)) AND conv_id % 5 <> 0"),
    "addition_sessions": (sessions, "WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g"),
    "p24_page_plan": (p20_page_plan, "WITH x AS (SELECT source, doc_id, len(regexp_extract_all(text, 'tion')) AS signal, round(len(regexp_extract_all(text, 'the')) * 1000.0 / greatest(length(text), 200), 6) AS density FROM documents) SELECT *, row_number() OVER (PARTITION BY source ORDER BY signal DESC, density DESC, doc_id) AS place FROM x QUALIFY place <= 10"),
    "p25_section_map": (p25_section_map, "WITH p AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS page, count(DISTINCT event_type) AS n, min(event_type) AS s FROM events GROUP BY 1, 2) SELECT user_id, page, CASE WHEN n > 1 THEN 'conflict' ELSE s END AS section, coalesce(lead(page) OVER (PARTITION BY user_id ORDER BY page) - 1, 400) AS ends FROM p"),
    "p28_safe_harbor": (p28_safe_harbor, "WITH c AS (SELECT o_custkey, list_filter(['1-URGENT', '3-MEDIUM', '5-LOW'], lambda x: NOT list_contains(list(DISTINCT o_orderpriority), x)) AS m FROM orders GROUP BY 1) SELECT o_custkey, array_to_string(m, ',') AS missing, len(m) = 0 AS complete FROM c"),
    "p29_tombstones": (p29_tombstones, "SELECT c_custkey AS o_custkey, count(o_orderkey) FILTER (o_orderstatus <> 'P') AS deleted, count(o_orderkey) FILTER (o_orderstatus = 'P') AS left, CASE WHEN count(o_orderkey) FILTER (o_orderstatus = 'P') = 0 THEN 'tombstone' ELSE 'incomplete' END AS state FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1"),
    "p27_rescore": (p27_rescore, "WITH k AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS known FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(known, x)), ',') AS retag, len(known) = 3 AS rescorable FROM k"),
    "p23_report_credit": (p22_report_credit, "WITH x AS (SELECT source, list(DISTINCT doc_id % 4) AS have FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1), m AS (SELECT source, list_filter(['index', 'coverage', 'standard'], lambda x: NOT list_contains(have, CASE x WHEN 'index' THEN 0 WHEN 'coverage' THEN 1 ELSE 2 END)) AS m FROM x) SELECT source, array_to_string(m, ',') AS missing, len(m) = 0 AS credit FROM m"),
    "p30_review": (p30_review, """WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey AS seq, 1 + o_orderkey % 3 AS expected, o_orderstatus AS resolution, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
s AS (SELECT DISTINCT o_custkey, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS expected, '' AS resolution, CAST(1 AS BIGINT) AS met, CAST(1 AS BIGINT) AS now FROM r
UNION ALL SELECT r.o_custkey, r.n, r.seq, r.expected, r.resolution, s.now, s.now + CASE WHEN r.expected = s.now THEN 1 ELSE 0 END FROM s JOIN r ON r.o_custkey = s.o_custkey AND r.n = s.n + 1)
SELECT o_custkey, seq, expected, resolution, met, CASE WHEN expected = met THEN 'accepted' ELSE 'revision_conflict' END AS verdict FROM s WHERE n > 0"""),
    "r2_note_targets": (r2_note_targets, "WITH x AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT 's' || s_suppkey AS id, 'note-n' || s_nationkey AS note, 1 AS distance FROM x UNION ALL SELECT 's' || s_suppkey, 'note-r' || n_regionkey, 2 FROM x"),
    "r3_nearest_section": (r3_nearest_section, "SELECT 's' || s_suppkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey WHEN r_regionkey < 3 THEN 'r' || r_regionkey ELSE '-' END AS section, CASE WHEN n_nationkey % 2 = 0 THEN n_name WHEN r_regionkey < 3 THEN r_name ELSE '-' END AS title FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "j26_bound_facts": (j26_bound_facts, "WITH o AS (SELECT o_orderkey, o_orderstatus AS raw, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS unit, o_custkey AS kind FROM orders) SELECT o_orderkey, EXISTS (SELECT 1 FROM o b WHERE b.o_orderkey % 2 = 0 AND b.raw = a.raw AND b.unit IS NOT DISTINCT FROM a.unit AND b.kind = a.kind) AS bound FROM o a"),
    "f6_batch": (f6_batch, "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars, doc_id LIMIT 50"),
    "f11_search_complete": (f11_search_complete, "WITH c AS (SELECT conv_id, turn, max(length(text)) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, count(*) = max(turn) + 1 AND min(turn) = 0 AND min(n) > 30 AS complete FROM c GROUP BY 1"),
    "t4_ranked_evidence": (t4_ranked_evidence, "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id % 50 <> 0, CASE WHEN doc_id % 50 <> 0 THEN CASE WHEN lang = 'en' THEN 1 ELSE 2 END END, CASE WHEN doc_id % 50 <> 0 THEN n_chars END DESC, doc_id) AS place FROM documents QUALIFY place <= 30"),
    "a17_report": (a17_report, r"""WITH x AS (SELECT quality AS t, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN regexp_matches(text, '!!|\*\*\*') THEN 0 ELSE 1 END AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) AS n, count(p) AS made, count(*) FILTER (t = p) AS hit, count(*) FILTER (t = 0) AS t0, count(*) FILTER (t = 1) AS t1, count(*) FILTER (p = 0) AS p0, count(*) FILTER (p = 1) AS p1, count(*) FILTER (t = 0 AND p = 0) AS h0, count(*) FILTER (t = 1 AND p = 1) AS h1, count(*) FILTER (t = 0 AND p IS NOT NULL) AS s0, count(*) FILTER (t = 1 AND p IS NOT NULL) AS s1 FROM x)
SELECT n, round(made / n, 6) AS coverage, round(hit / n, 6) AS accuracy, round(greatest(t0, t1) / n, 6) AS majority, round((2.0 * h0 / (t0 + p0) + 2.0 * h1 / (t1 + p1)) / 2, 6) AS macro_f1, round((2.0 * h0 / (s0 + p0) + 2.0 * h1 / (s1 + p1)) / 2, 6) AS selective_f1 FROM c"""),
    "j24_continuations": (j24_continuations, "WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2) SELECT conv_id, md5(string_agg(md5(text), '' ORDER BY turn)) AS digest FROM c GROUP BY 1"),
    "x2_normal_forms": (x10_normal_forms, r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS citation, md5(nfc_normalize(text)) AS nfc FROM documents"),
    "x40_signature": (x40_signature, """SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}') AS signature FROM part"""),
    "x41_json_path": (x41_json_path, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "s15_summary": (cube_summary, "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2"),
}
