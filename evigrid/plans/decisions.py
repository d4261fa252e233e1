"""Votes, ladders, numeric checks, reconciliation, geometry, graphs and grids over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.functions import periods as D
from evigrid.operators import geometry as G
from evigrid.operators import graph, grids, ladder, numeric, reconcile, sizing, votes
from evigrid.sources import html_tables
from evigrid.sources.tables import table

STATE = "CASE WHEN l_quantity > 45 THEN 'conflict' WHEN l_quantity > 40 THEN 'unknown' WHEN l_quantity > 38 THEN 'missing' WHEN l_returnflag = 'R' THEN 'absent' ELSE 'present' END"


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order stand for three replicates' votes in turn; of several of one replicate the greatest counts."""
    li = sizing.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_tax"), "l_orderkey")
    li = li.groupBy("l_orderkey", F.pmod(F.col("l_linenumber") - 1, F.lit(3)).alias("replicate")).agg(F.first("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"), F.max("l_linestatus").alias("value"), F.max("l_tax").alias("l_tax"), F.max("l_quantity").alias("q"))
    return li.withColumn("l_quantity", F.col("q")).select("l_orderkey", "replicate", F.expr(STATE).alias("state"), "value", (F.col("l_tax") < 0.07).alias("verified"))


def a5_resolved_votes(spark, d):
    return votes.resolve(_votes(spark, d), ["l_orderkey"])


def a3_strict_consensus(spark, d):
    return votes.strict_consensus(_votes(spark, d), ["l_orderkey"])


def a6_inventory(spark, d):
    return votes.inventory_state(_votes(spark, d), ["l_orderkey"])


def _facts(spark, d, track):
    c = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    cols = [F.when(F.pmod(F.floor(k / (n + 1)) + n * k, F.lit(7)) == 0, "unknown").when(F.pmod(F.floor(k / (n + 2)) + k, F.lit(3)) == 0, "absent").otherwise("present").alias(f) for n, f in enumerate(ladder.LADDERS[track][0])]
    return c.select("c_custkey", *cols)


def _ladder(track):
    def run(spark, d):
        out = ladder.decide(_facts(spark, d, track), "c_custkey", track)
        return out.select("c_custkey", "status", F.coalesce("grade", F.lit("-")).alias("grade"), F.coalesce("label", F.lit("-")).alias("label"), F.coalesce("floor", F.lit("-")).alias("floor"), F.coalesce("ceiling", F.lit("-")).alias("ceiling"), "worlds")

    return run


def _fact_sql(names):
    return ", ".join(f"CASE WHEN (CAST(floor(c_custkey / {n + 1}) AS BIGINT) + {n} * c_custkey) % 7 = 0 THEN 'unknown' WHEN (CAST(floor(c_custkey / {n + 2}) AS BIGINT) + c_custkey) % 3 = 0 THEN 'absent' ELSE 'present' END AS {f}" for n, f in enumerate(names))


def ladder_sql(track: str) -> str:
    """Brute force: every assignment of the facts that agrees with the known ones."""
    names, branches = ladder.LADDERS[track]
    worlds = " CROSS JOIN ".join(f"(VALUES (true), (false)) AS w{n}({f}_t)" for n, f in enumerate(names))
    agree = " AND ".join(f"({f} = 'unknown' OR ({f} = 'present') = {f}_t)" for f in names)

    def holds(b: ladder.Branch) -> str:
        of = lambda f: "(target_metric_t AND transition_plan_t)" if f == "exception_applies" else f"{f}_t"
        return "(" + " AND ".join(of(f) if v else f"NOT {of(f)}" for f, v in b.when) + ")"

    caps = "".join(f"WHEN {holds(b)} THEN '{b.grade}' " for b in branches if b.cap)
    rest = "".join(f"WHEN {holds(b)} THEN '{b.grade}' " for b in sorted(branches, key=lambda b: (b.grade, b.name), reverse=True) if not b.cap)
    return f"""WITH f AS (SELECT c_custkey, {_fact_sql(names)} FROM customer), g AS (SELECT c_custkey, CASE {caps}{rest} END AS grade FROM f CROSS JOIN {worlds} WHERE {agree}),
a AS (SELECT c_custkey, count(*) AS worlds, count(DISTINCT grade) AS n, bool_or(grade IS NULL) AS gap, min(grade) AS lo, max(grade) AS hi FROM g GROUP BY c_custkey),
s AS (SELECT *, CASE WHEN n + CAST(gap AS INTEGER) > 1 THEN 'blocked_evidence' WHEN n = 0 THEN 'blocked_rule_gap' ELSE 'decided' END AS status FROM a)
SELECT c_custkey, status, CASE WHEN status = 'decided' THEN lo ELSE '-' END AS grade, CASE WHEN status <> 'decided' THEN '-' WHEN lo = 'E0' THEN 'UNSUBSTANTIATED' WHEN lo = 'E3' THEN 'SUBSTANTIATED' ELSE 'INCOMPLETE' END AS label,
CASE WHEN status = 'blocked_evidence' AND NOT gap AND n > 1 THEN lo ELSE '-' END AS floor, CASE WHEN status = 'blocked_evidence' AND NOT gap AND n > 1 THEN hi ELSE '-' END AS ceiling, worlds FROM s"""


def p8_sum_check(spark, d):
    """An order's reported total (to one decimal) against the sum of its lines, each shown to one decimal."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,1)").cast("string").alias("raw"), "l_quantity")
    lo, hi = D.display_interval(F.col("raw"), F.lit(1))
    parts = li.select("l_orderkey", lo.alias("lo"), hi.alias("hi"), (F.col("l_quantity") > 48).alias("gone")).groupBy("l_orderkey").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.count("*").alias("found"), F.count_if("gone").alias("missing"))
    shift = F.when(F.col("l_orderkey") % 3 == 0, F.lit("0.3")).otherwise(F.lit("9999.0")).cast("decimal(18,1)")
    mid = ((F.col("lo") + F.col("hi")) / 2).cast("decimal(20,1)") + shift
    claims = parts.withColumn("rep", mid.cast("string"))
    rep_lo, rep_hi = D.display_interval(F.col("rep"), F.lit(1))
    claims = claims.select(F.col("l_orderkey").alias("key"), "lo", "hi", rep_lo.alias("rep_lo"), rep_hi.alias("rep_hi"), F.when(F.col("l_orderkey") % 10 == 0, 99).otherwise(F.col("found")).alias("wanted"), "found", "missing", (F.col("l_orderkey") % 7 != 0).alias("same_period"))
    return numeric.check_sum(claims).withColumn("reason", F.coalesce("reason", F.lit("-")))


def p8_growth(spark, d):
    y = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").cast("decimal(12,0)").alias("n"))
    a, b = y.select("o_orderpriority", F.col("y"), F.col("n").alias("cur")), y.select("o_orderpriority", (F.col("y") + 1).alias("y"), F.col("n").alias("base"))
    x = a.join(b, ["o_orderpriority", "y"])
    half = F.lit("0.5").cast("decimal(3,1)")
    lo, hi, fine = numeric.rate_interval((F.col("base") - half).cast("double"), (F.col("base") + half).cast("double"), (F.col("cur") - half).cast("double"), (F.col("cur") + half).cast("double"), "growth")
    return x.select("o_orderpriority", "y", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), fine.alias("computable"))


def _gates(k, kind):
    """Columns of policy and packet in which every line of the gate occurs."""
    other = F.when(k % 41 == 3, "count").when(k % 43 == 4, "unknown").otherwise(kind)
    return [
        (k % 23 != 0).alias("approved"), F.when(k % 29 == 1, 2).otherwise(1).alias("stage"), (k % 3 == 0).alias("synthetic_only"), (k % 31 != 3).alias("synthetic"), (k % 37 != 1).alias("enabled"),
        F.when(k % 17 == 2, "not_comparable").when(k % 19 == 3, "unknown").otherwise("comparable").alias("comparability"), F.when(k % 43 == 4, "unknown").when(k % 47 == 5, "count").otherwise(kind).alias("left_kind"),
        F.when(k % 47 == 5, "count").otherwise(other).alias("right_kind"), F.when(k % 2 == 0, F.concat(F.lit("x"), k)).alias("explanation"), (k % 3 == 0).alias("search_complete"), F.concat(F.lit("s"), k).alias("left_source"), F.concat(F.lit("f"), k % 5).alias("right_source"),
    ]


def _outcomes(x, arms):
    out = reconcile.cascade(x, arms).withColumn("sources", F.array_join(reconcile.source_ids(F.col("left_source"), F.col("right_source"), F.col("cited")), ","))
    return out.select("k", "execution_state", F.coalesce("status", F.lit("-")).alias("status"), "reason", F.array_join("reasons", ",").alias("reasons"), "sources", "review_required")


def p18_c1(spark, d):
    """Entity sets of each customer's market segments and order priorities, as two sides of a reconciliation."""
    sets = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))).alias("b"))
    k = F.col("k")
    start, end = F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date")
    x = sets.select("k", *_gates(k, "entity_set"), F.when(k % 53 != 6, F.col("a")).alias("left_value"), F.when(k % 59 == 7, F.array().cast("array<string>")).otherwise(F.col("b")).alias("right_value"), F.when(k % 61 != 8, start).alias("period_start"), end.alias("period_end"), start.alias("financial_start"), F.when(k % 13 == 9, F.date_sub(end, 1)).otherwise(end).alias("financial_end"), F.when(k % 11 == 10, "unknown").otherwise("consolidated").alias("consolidation"))
    return _outcomes(x, reconcile.entities_item())


def p18_c2(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    k = F.col("k")
    x = o.select("k", *_gates(k, "period"), F.when(k % 53 != 6, F.struct(F.col("a").alias("start"), F.col("b").alias("end"))).alias("left_value"), F.struct(F.col("a").alias("start"), F.when(k % 5 == 0, F.col("b")).otherwise(F.lit("1996-12-31").cast("date")).alias("end")).alias("right_value"), F.when(k % 7 != 0, F.lit("1995-01-01").cast("date")).alias("period_start"), F.lit("1995-06-30").cast("date").alias("period_end"))
    return _outcomes(x, reconcile.periods_item())


def p18_c3(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("capex"), F.max(F.col("o_totalprice").cast("decimal(18,2)")).alias("commitment"))
    k = F.col("k")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    zero = F.lit(0).cast("decimal(18,2)")
    x = o.select(
        "k", *_gates(k, "currency_amount"), F.when(k % 53 == 6, None).when(k % 67 == 1, zero).otherwise(F.col("commitment")).alias("left_value"), F.when(k % 71 == 2, zero).otherwise(F.col("capex")).alias("right_value"), F.when(k % 9 == 1, "performance").otherwise("goal").alias("track"), (k % 8 != 0).alias("triggered"),
        F.lit("KRW").alias("currency"), F.when(k % 13 == 1, "USD").otherwise("KRW").alias("left_unit"), F.lit("KRW").alias("right_unit"), (k % 12 != 5).alias("accounts_approved"), F.array(F.lit("a1"), F.lit("a2")).alias("allowed_accounts"), F.when(k % 14 == 3, F.array(F.lit("a1"), F.lit("a9"))).when(k % 15 == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("a2"))).alias("accounts"),
        F.when(k % 16 != 5, day(0)).alias("target_start"), day(700).alias("target_end"), F.when(k % 18 == 7, day(1)).otherwise(day(0)).alias("capex_start"), day(365).alias("capex_end"), day(0).alias("financial_start"), day(365).alias("financial_end"),
        F.when(k % 10 == 3, F.concat(F.lit("c"), k)).alias("commitment_source"), F.when(k % 4 == 3, F.lit("plan")).alias("funding_source"), F.when(k % 21 != 2, F.lit("0.1500").cast("decimal(6,4)")).alias("threshold"),
    )
    return _outcomes(x, reconcile.spending_item(numeric.within_threshold(F.col("left_value"), F.lit("0.1500"), F.col("right_value"))))


def p18_c4(spark, d):
    k = F.col("p_partkey")
    ids = lambda when, name: F.when(when, F.array(F.concat(F.lit(name), k), F.lit("both"))).otherwise(F.array().cast("array<string>"))
    required = F.when(k % 4 == 0, F.array(F.lit("calculation_basis"), F.lit("definition"))).otherwise(F.array(F.lit("definition"), F.lit("calculation_basis")))
    x = table(spark, d, "part").select(k.alias("k"), *_gates(k, "classification"), F.when(k % 53 != 6, "v").alias("left_value"), F.lit("w").alias("right_value"), ids(k % 2 == 0, "d").alias("definition_sources"), ids(k % 5 == 0, "c").alias("calculation_sources"), required.alias("required"))
    return _outcomes(x, reconcile.definition_item())


def x28_threshold(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("capex"), F.max(F.col("o_totalprice").cast("decimal(18,2)")).alias("commitment"))
    return o.select("o_custkey", numeric.within_threshold(F.col("commitment"), F.lit("0.1500"), F.col("capex")).alias("within"))


def _boxes(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
    base = (F.col("l_orderkey") % 200).cast("double")
    return li.select(F.floor(F.col("l_orderkey") / 50).alias("doc"), F.lit(1).alias("page"), F.lit("paragraph").alias("kind"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("p"), (F.col("l_linenumber") % 2).cast("string")).alias("parser"), base.alias("x0"), base.alias("y0"), (base + 40 + F.col("q") / 10).alias("x1"), (base + 20).alias("y1"), (F.col("p") % 5).cast("string").alias("text"))


def j2_overlap_pairs(spark, d):
    return G.matching_pairs(_boxes(spark, d))


def p1_fusion(spark, d):
    return G.fuse(_boxes(spark, d))


def x29_affine(spark, d):
    b = _boxes(spark, d).select("id", "x0", "y0", "x1", "y1")
    x0, y0, x1, y1 = G.apply_affine((0, 2, -1, 0, 100, 5), G.box_of())
    return b.select("id", F.round(x0, 6).alias("x0"), F.round(y0, 6).alias("y0"), F.round(x1, 6).alias("x1"), F.round(y1, 6).alias("y1"))


def _edges(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    return n.union(s).union(r)


def r1_ancestors(spark, d):
    return graph.ancestors(_edges(spark, d))


def r6_bundles(spark, d):
    blocks = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    notes = table(spark, d, "nation").select(F.concat(F.lit("note"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    return graph.bundles(blocks, _edges(spark, d), notes).groupBy("root").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("member")), ",").alias("names"))


def _sources(spark, d):
    """An inline table per nation: a header over two columns, stub names, numbers, dashes and blanks; some are broken."""
    k = F.col("n_nationkey")
    fact = F.when(k % 3 == 0, "-").when(k % 3 == 1, "n.m.").otherwise("-4.5")
    last = F.when(k % 8 == 5, F.lit("<td colspan=0>?</td>")).when(k % 8 == 6, F.lit("<td rowspan=2>-</td>")).when(k % 8 == 7, F.lit("")).otherwise(F.concat(F.lit("<td>"), fact, F.lit("</td>")))
    html = F.concat(F.lit("<table><tr><th rowspan=2>Metric</th><th colspan=2>2024</th></tr><tr><th>plan</th><th>fact</th></tr><tr><td>"), "n_name", F.lit("</td><td>1,"), F.lpad(k.cast("string"), 3, "0"), F.lit("</td>"), last, F.lit("</tr></table>"))
    return table(spark, d, "nation").select("n_nationkey", html.alias("html"))


def _cells(spark, d):
    html_tables.register(spark)
    name = f"inline_tables_{uuid.uuid4().hex}"
    _sources(spark, d).createOrReplaceTempView(name)
    out = spark.sql(f"SELECT n_nationkey AS tbl, status, row * 100 + col AS cell, row, col, row_span, col_span, text FROM {name}, LATERAL html_table_cells(html)")
    spark.catalog.dropTempView(name)
    return out


def s7_html_cells(spark, d):
    return _cells(spark, d).drop("cell").withColumn("text", F.coalesce("text", F.lit("-")))


def x33_slots(spark, d):
    return grids.slots(_cells(spark, d).filter("status = 'ok'")).groupBy("tbl").agg(F.count("*").alias("slots"), F.count_distinct("cell").alias("cells"))


def p2_observations(spark, d):
    out = grids.observations(_cells(spark, d).filter("status = 'ok'"), header_rows=2)
    return out.select("tbl", "r", "c", "header", "metric", "state", F.coalesce("value", F.lit("")).alias("value"))


#: The gate of every item, in the order of its lines; a key in one line may also be in a later one.
GATE = """CASE WHEN k % 23 = 0 THEN 'policy_unapproved' WHEN k % 29 = 1 THEN 'stage_not_supported' WHEN k % 3 = 0 AND k % 31 = 3 THEN 'synthetic_policy_real_packet' WHEN k % 37 = 1 THEN 'item_not_enabled'
WHEN k % 17 = 2 THEN 'not_comparable' WHEN k % 19 = 3 THEN 'comparability_unknown' WHEN k % 47 <> 5 AND k % 41 = 3 THEN 'kind_mismatch' WHEN k % 47 = 5 AND k % 43 = 4 THEN 'kind_mismatch' WHEN k % 43 = 4 THEN 'value_unresolved'"""
OWN = "WHEN k % 47 = 5 THEN 'kind_mismatch' WHEN k % 53 = 6 THEN 'value_unresolved'"
DIFFER = "WHEN k % 2 = 0 THEN '{0}' WHEN k % 3 = 0 THEN 'explanation_not_found' ELSE 'search_incomplete' END"
MATCHED = "'same_verified_entity_set', 'difference_explained', 'same_period', 'period_difference_explained', 'commitment_disclosed', 'capex_within_threshold', 'classification_basis_present'"


def _outcome(cte: str, cited: str = "''") -> str:
    """cte ends in r (k, reason); cited: the comma-led ids that a reason cites, in SQL."""
    return f"""{cte}, outcome AS (SELECT *, split_part(reason, ',', 1) AS first FROM r), done AS (SELECT *, CASE WHEN first IN ({MATCHED}) THEN 'matched' WHEN first IN ('not_comparable', 'period_out_of_scope', 'c3_trigger_absent') THEN 'not_applicable' WHEN first IN ('explanation_not_found', 'definition_not_found', 'calculation_basis_not_found') THEN 'needs_explanation' END AS status FROM outcome)
SELECT k, CASE WHEN status IS NULL THEN 'blocked' ELSE 'completed' END AS execution_state, coalesce(status, '-') AS status, first AS reason, reason AS reasons, 's' || k || ',f' || (k % 5) || {cited} || CASE WHEN first IN ('difference_explained', 'period_difference_explained') THEN ',x' || k ELSE '' END AS sources, status IS NULL AS review_required FROM done"""


VOTES = f"WITH v0 AS (SELECT l_orderkey, (l_linenumber - 1) % 3 AS replicate, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS value, max(l_tax) AS l_tax FROM lineitem GROUP BY ALL), v AS (SELECT l_orderkey, replicate, {STATE} AS state, value, l_tax < 0.07 AS verified FROM v0)"
BOXES = "WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT CAST(floor(l_orderkey / 50) AS BIGINT) AS doc, l_orderkey * 8 + l_linenumber AS id, l_linenumber % 2 AS parser, CAST(l_orderkey % 200 AS DOUBLE) AS x0, CAST(l_orderkey % 200 AS DOUBLE) AS y0, CAST(l_orderkey % 200 AS DOUBLE) + 40 + q / 10 AS x1, CAST(l_orderkey % 200 AS DOUBLE) + 20 AS y1 FROM l)"
QUERIES = {
    "a5_resolved_votes": (a5_resolved_votes, VOTES + ", a AS (SELECT l_orderkey, count(*) AS n, bool_or(state = 'conflict') AS c, bool_or(state IN ('unreadable', 'missing')) AS lost, count(*) FILTER (verified AND state IN ('present', 'absent')) AS valid, count(DISTINCT state || '|' || value) FILTER (verified AND state IN ('present', 'absent')) AS keys, min(state) FILTER (verified AND state IN ('present', 'absent')) AS s FROM v GROUP BY 1) SELECT l_orderkey, CASE WHEN c THEN 'conflict' WHEN n <> 3 OR lost THEN 'unknown' WHEN keys > 1 THEN 'conflict' WHEN valid >= 2 THEN s ELSE 'unknown' END AS resolved, valid FROM a"),
    "a3_strict_consensus": (a3_strict_consensus, VOTES + ", p AS (SELECT l_orderkey, state, value, count(DISTINCT replicate) AS votes FROM v GROUP BY ALL), b AS (SELECT l_orderkey, max(votes) AS agreement, CASE WHEN max(votes) >= 2 THEN arg_max(state, votes) END AS candidate, sum(votes) AS n, bool_or(state IN ('unknown', 'conflict')) AS open FROM p GROUP BY 1) SELECT l_orderkey, candidate, agreement, agreement = 3 AND n = 3 AND NOT open AS confirmed FROM b"),
    "a6_inventory_state": (a6_inventory, VOTES + " SELECT l_orderkey, CASE WHEN bool_or(state = 'conflict') OR (bool_or(state = 'present') AND NOT bool_and(state = 'present') AND NOT bool_or(state IN ('unknown', 'missing'))) THEN 'conflict' WHEN bool_and(state = 'present') THEN 'present' WHEN bool_or(state IN ('unknown', 'missing')) THEN 'unknown' ELSE 'absent_in_scope' END AS inventory FROM v GROUP BY 1"),
    "p10_goal_ladder": (_ladder("goal"), ladder_sql("goal")),
    "p10_performance_ladder": (_ladder("performance"), ladder_sql("performance")),
    "p10_management_ladder": (_ladder("management"), ladder_sql("management")),
    "p8_sum_check": (p8_sum_check, None),
    "p8_growth_interval": (p8_growth, "WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS y, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL) SELECT a.o_orderpriority, a.y, round(((a.n - 0.5) / (b.n + 0.5) - 1) * 100, 6) AS low, round(((a.n + 0.5) / (b.n - 0.5) - 1) * 100, 6) AS high, b.n > 0.5 AS computable FROM y a JOIN y b ON a.o_orderpriority = b.o_orderpriority AND a.y = b.y + 1"),
    "p18_c1_entities": (p18_c1, _outcome(f"WITH a AS (SELECT o_custkey AS k, list_sort(list(DISTINCT o_orderpriority)) AS ls, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'P')), []) AS rs FROM orders GROUP BY 1), r AS (SELECT k, {GATE} {OWN} WHEN k % 61 = 8 THEN 'c1_period_unresolved' WHEN k % 13 = 9 THEN 'c1_period_mismatch' WHEN k % 11 = 10 THEN 'c1_consolidation_unknown' WHEN k % 59 = 7 OR len(rs) = 0 THEN 'entity_set_empty' WHEN ls = rs THEN 'same_verified_entity_set' {DIFFER.format('difference_explained')} AS reason FROM a)")),
    "p18_c2_periods": (p18_c2, _outcome(f"WITH o AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), r AS (SELECT k, {GATE} {OWN} WHEN k % 7 <> 0 AND b < DATE '1995-01-01' OR a > DATE '1995-06-30' THEN 'period_out_of_scope' WHEN k % 5 = 0 OR b = DATE '1996-12-31' THEN 'same_period' {DIFFER.format('period_difference_explained')} AS reason FROM o)")),
    "p18_c3_spending": (p18_c3, _outcome(f"""WITH o AS (SELECT o_custkey AS k, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS capex, max(CAST(o_totalprice AS DECIMAL(18,2))) AS m FROM orders GROUP BY 1), r AS (SELECT k, {GATE} WHEN k % 9 = 1 OR k % 8 = 0 THEN 'c3_trigger_absent' {OWN} WHEN k % 13 = 1 THEN 'c3_currency_mismatch'
WHEN k % 12 = 5 OR k % 14 = 3 OR k % 15 = 4 THEN 'c3_policy_unapproved' WHEN k % 16 = 5 THEN 'c3_period_unresolved' WHEN k % 18 = 7 THEN 'c3_capex_period_mismatch' WHEN k % 67 = 1 OR m <= 0 THEN 'c3_commitment_not_positive' WHEN k % 71 = 2 OR capex <= 0 THEN 'c3_capex_not_positive'
WHEN k % 10 = 3 THEN 'commitment_disclosed' WHEN k % 21 = 2 THEN 'c3_policy_unapproved' WHEN m * 100 <= capex * 15 THEN 'capex_within_threshold' {DIFFER.format('difference_explained')} AS reason,
({GATE} ELSE '' END) <> '' OR k % 9 = 1 OR k % 8 = 0 AS early FROM o)""", "CASE WHEN early THEN '' ELSE CASE WHEN k % 10 = 3 THEN ',c' || k ELSE '' END || CASE WHEN k % 4 = 3 THEN ',plan' ELSE '' END END")),
    "p18_c4_definitions": (p18_c4, _outcome(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 2 = 0 AS d, p_partkey % 5 = 0 AS c FROM part), r AS (SELECT k, d, c, {GATE} {OWN} WHEN d AND c THEN 'classification_basis_present' WHEN k % 3 <> 0 THEN 'search_incomplete' WHEN d THEN 'calculation_basis_not_found' WHEN c THEN 'definition_not_found' WHEN k % 4 = 0 THEN 'calculation_basis_not_found,definition_not_found' ELSE 'definition_not_found,calculation_basis_not_found' END AS reason, ({GATE} {OWN} ELSE '' END) <> '' AS early FROM p)""",
        "CASE WHEN early THEN '' WHEN d AND c THEN CASE WHEN k % 4 = 0 THEN ',c' || k || ',both,d' || k ELSE ',d' || k || ',both,c' || k END WHEN d THEN ',d' || k || ',both' WHEN c THEN ',c' || k || ',both' ELSE '' END")),
    "x28_threshold": (x28_threshold, "SELECT o_custkey, max(CAST(o_totalprice AS DECIMAL(18,2))) * 100 <= sum(CAST(o_totalprice AS DECIMAL(18,2))) * 15 AS within FROM orders GROUP BY 1"),
    "j2_overlap_pairs": (j2_overlap_pairs, BOXES + ", p AS (SELECT a.doc, a.id AS l_id, b.id AS r_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM b a JOIN b ON a.doc = b.doc AND a.parser < b.parser) SELECT doc, 1 AS page, 'paragraph' AS kind, l_id, r_id, round(i / (u - i), 6) AS iou FROM p WHERE i / (u - i) >= 0.8"),
    "p1_fusion": (p1_fusion, None),
    "x29_affine": (x29_affine, BOXES + " SELECT id, round(100 - y1, 6) AS x0, round(2 * x0 + 5, 6) AS y0, round(100 - y0, 6) AS x1, round(2 * x1 + 5, 6) AS y1 FROM b"),
    "r1_ancestors": (r1_ancestors, "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region), c(node, ancestor, distance) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT node, parent, distance + 1 FROM c JOIN e ON ancestor = child) SELECT node, ancestor, min(distance) AS distance FROM c GROUP BY 1, 2"),
    "r6_bundles": (r6_bundles, "WITH m AS (SELECT 's' || s_suppkey AS root, unnest(['s' || s_suppkey, 'n' || s_nationkey, 'note' || s_nationkey, 'r' || n_regionkey, 'world']) AS member FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT root, count(*) AS members, string_agg(member, ',' ORDER BY member) AS names FROM m GROUP BY root"),
    "s7_html_cells": (s7_html_cells, """SELECT n_nationkey AS tbl, 'ok' AS status, r AS row, c AS col, dr AS row_span, dc AS col_span, CASE WHEN t <> '' THEN t WHEN c = 0 THEN n_name WHEN c = 1 THEN '1,' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') WHEN n_nationkey % 3 = 0 THEN '-' WHEN n_nationkey % 3 = 1 THEN 'n.m.' ELSE '-4.5' END AS text
FROM nation CROSS JOIN (VALUES (0, 0, 2, 1, 'Metric'), (0, 1, 1, 2, '2024'), (1, 1, 1, 1, 'plan'), (1, 2, 1, 1, 'fact'), (2, 0, 1, 1, ''), (2, 1, 1, 1, ''), (2, 2, 1, 1, '')) AS x(r, c, dr, dc, t) WHERE n_nationkey % 8 < 5
UNION ALL SELECT n_nationkey, CASE n_nationkey % 8 WHEN 5 THEN 'bad_span' WHEN 6 THEN 'row_span_past_end' ELSE 'ragged' END, -1, -1, -1, -1, '-' FROM nation WHERE n_nationkey % 8 >= 5"""),
    "x33_slots": (x33_slots, "SELECT n_nationkey AS tbl, 9 AS slots, 7 AS cells FROM nation WHERE n_nationkey % 8 < 5"),
    "p2_observations": (p2_observations, "SELECT n_nationkey AS tbl, 2 AS r, c, CASE c WHEN 1 THEN '2024 / plan' ELSE '2024 / fact' END AS header, n_name AS metric, CASE WHEN c = 1 OR n_nationkey % 3 = 2 THEN 'present' WHEN n_nationkey % 3 = 0 THEN 'missing' ELSE 'unreadable' END AS state, CASE WHEN c = 1 THEN '1' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') WHEN n_nationkey % 3 = 2 THEN '-4.5' ELSE '' END AS value FROM nation CROSS JOIN (VALUES (1), (2)) AS t(c) WHERE n_nationkey % 8 < 5"),
}
