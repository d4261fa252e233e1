"""Windows, joins, sets, orders and aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import periods as D
from evigrid.functions import text as T
from evigrid.operators import compare as C
from evigrid.operators import joins as J
from evigrid.operators import sets as S
from evigrid.operators import sizing
from evigrid.operators import windows as W
from evigrid.sources.tables import table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders")


def w1_route_ranks(spark, d):
    o = _orders(spark, d).groupBy("o_orderpriority", "o_custkey").agg(F.round(F.max("o_totalprice"), 2).alias("best"))
    r = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("best"), "o_custkey"))
    return o.withColumn("rank", r).filter("rank <= 20").select("o_orderpriority", "rank", "o_custkey", "best")


def w2_latest_revision(spark, d):
    return W.latest(_orders(spark, d).select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


def _chain(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("event_id")
    body = F.md5(F.concat_ws("|", "user_id", "event_id", "event_type"))
    e = e.withColumn("sequence", F.row_number().over(w)).withColumn("own", F.when(F.col("event_id") % 997 == 5, "forged").otherwise(body))
    return e.withColumn("previous", F.lag("own").over(w)).withColumn("body", body)


def w3_chain_verify(spark, d):
    return W.chain_verdicts(_chain(spark, d), ["user_id"], "sequence", "previous", "own", F.col("body"))


def w4_label_runs(spark, d):
    e = table(spark, d, "events").select("user_id", F.datediff("ts", F.lit("1970-01-01")).alias("day"))
    return W.islands(e, ["user_id"], "day", 3)


def w5_page_ranges(spark, d):
    return W.islands(table(spark, d, "conversations"), ["conv_id"], "turn")


def w6_section_ranges(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn").distinct()
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    c = c.join(last, "conv_id")
    return c.withColumn("ends", W.section_ends(c, ["conv_id"], "turn", F.col("last"))).select("conv_id", "turn", "ends")


def w7_carry_forward(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    kind = F.when(F.col("event_type") == "view", F.col("event_id"))
    return e.withColumn("container", W.carried(e, ["user_id"], ["event_id"], kind, F.col("event_type") == "purchase"))


def w8_previous_context(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text").dropDuplicates(["conv_id", "turn"])
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.coalesce(before, F.col("turn")).alias("context_from"))


def _spans(spark, d):
    li = sizing.dealt(table(spark, d, "lineitem").select("l_orderkey", F.datediff("l_shipdate", F.lit("1992-01-01")).alias("start"), F.col("l_quantity").cast("int").alias("n"), "l_linenumber"), "l_orderkey")
    return li.select(F.col("l_orderkey").alias("k"), "start", (F.col("start") + F.col("n") + 1).alias("end"), F.col("l_linenumber").alias("id"))


def w9_gaps(spark, d):
    return W.gaps(_spans(spark, d), ["k"], "start", "end")


def w10_occurrences(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return li.withColumn("occurrence", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")))


def w12_running_attempts(spark, d):
    o = _orders(spark, d).select("o_custkey", "o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    prior = F.max("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    o = o.withColumn("n", F.row_number().over(w))
    return o.withColumn("attempt", F.coalesce(prior, F.lit(0)) + 1).withColumn("allowed", F.col("attempt") <= 3).drop("n")


def w13_year_table(spark, d):
    y = _orders(spark, d).groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy("y")
    latest = F.first("n").over(Window.partitionBy("o_orderpriority").orderBy(F.desc("y")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return y.withColumn("before", F.lag("n").over(w)).withColumn("latest", latest)


def a9_budget_admission(spark, d):
    o = _orders(spark, d).select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    return o.withColumn("within", W.running_within(o, ["o_custkey"], ["o_orderkey"], "cost", 1_000_000))


def a20_nearest_rank(spark, d):
    return W.nearest_rank(table(spark, d, "events").select("event_type", F.round("value", 6).alias("value")), ["event_type"], "value", 0.95)


def r4_page_components(spark, d):
    return W.merged(_spans(spark, d), ["k"], "start", "end")


def s10_round_robin(spark, d):
    return W.interleave(table(spark, d, "part").select("p_partkey", "p_size", "p_brand"), "p_brand", ["p_size", "p_partkey"], 8, 40)


def t2_multi_key_order(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"[.!?]\s*$").alias("closed"), "n_chars")
    return x.orderBy(F.desc("closed"), "n_chars", "doc_id").limit(100)


def t3_capped_ranking(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.regexp_count("text", F.lit("the|le|der|el")).cast("long").alias("hits"))
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("hits"), "doc_id"))
    cap = F.when(F.col("lang") == "en", 8).otherwise(2)
    return x.withColumn("place", r).filter(F.col("place") <= cap).orderBy(F.desc("hits"), "doc_id").limit(10).select("doc_id", "lang", "hits")


def t5_paging(spark, d):
    return _orders(spark, d).select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(200).limit(100)


def t9_minimum(spark, d):
    return table(spark, d, "events").filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("first_id"))


def j1_citations(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("h"), F.col("n_chars").alias("n"))
    refs = table(spark, d, "labels").select("doc_id", "quality").join(x.select("doc_id", F.col("lang").alias("r_lang"), F.col("h").alias("r_h")), "doc_id")
    refs = refs.withColumn("r_lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("r_lang"))).withColumn("r_h", F.when(F.col("doc_id") % 5 == 0, "stale").otherwise(F.col("r_h")))
    refs = refs.union(refs.limit(0)).withColumn("doc_id", F.when(F.col("doc_id") % 11 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")))
    out = J.verified_refs(refs, x, "doc_id", [("r_lang", "lang", "label_mismatch"), ("r_h", "h", "text_mismatch")])
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


def j4_span_containment(spark, d):
    s = _spans(spark, d)
    return J.contained(s, s, "k", 16).filter("inner_id <> outer_id")


def j5_unique_scope(spark, d):
    o = _orders(spark, d).filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return J.unique_or_null(o, ["o_custkey"], "o_orderkey")


def j6_complete_bindings(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 50 == 0, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")))).alias("ids"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    return J.complete_lookup(li, p, "l_orderkey", "ids", "item", "price")


def j7_dimension_match(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment")).agg(F.count("*").alias("customers"))
    o = table(spark, d, "customer").join(_orders(spark, d), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment")).agg(F.count("*").alias("orders"))
    return J.pair_up(c, o, ["c_nationkey", "segment"])


def j9_year_over_year(spark, d):
    o = _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"), F.md5(F.concat_ws("|", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)"))).alias("content"))
    return C.compare(o.filter("y = 1996"), o.filter("y = 1995"), ["o_custkey", "o_orderpriority"], "content", "o_orderkey")


def p20_versions(spark, d):
    """Each customer's years of orders as report versions: is the one before the latest of the year before?"""
    v = _orders(spark, d).select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    now = v.groupBy("o_custkey").agg(F.max("y").alias("y"))
    return C.versions_verdict(now, v.join(now, ["o_custkey", "y"], "left_anti"), "o_custkey", "y").withColumn("reason", F.coalesce("reason", F.lit("-")))


def j10_label_map(spark, d):
    labels = table(spark, d, "nation").select("n_regionkey", F.array("n_nationkey", F.col("n_nationkey") + 1).alias("labels"))
    pages = table(spark, d, "supplier").select(F.col("s_nationkey").alias("label"), F.col("s_suppkey").alias("page"))
    each = labels.select("n_regionkey", F.explode("labels").alias("label")).distinct().join(pages, "label", "left")
    return each.groupBy("n_regionkey").agg(F.bool_and(F.col("page").isNotNull()).alias("resolved"), F.count(F.col("page")).alias("pages"), F.min("page").alias("first_page"))


def j11_assurance(spark, d):
    sup = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    covered = sup.groupBy("n_regionkey").agg(F.array_sort(F.collect_set("s_nationkey")).alias("covered"), F.min("s_suppkey").alias("k"))
    claims = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.array_sort(F.collect_set("c_nationkey")).alias("claimed"))
    both = claims.join(covered, "n_regionkey")
    level = F.when(F.col("c_mktsegment") == "MACHINERY", "none").otherwise("limited")
    verdict = J.coverage([J.axis_test(F.col("claimed"), F.col("covered"))], ambiguous=F.col("n_regionkey") == 4, excluded=F.col("c_mktsegment") == "FURNITURE", resolved=F.lit(True), level=level, complete=F.lit(True))
    return both.select("n_regionkey", "c_mktsegment", verdict.alias("verdict"))


def j13_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("unlabelled"))


def j14_claimable(spark, d):
    o = _orders(spark, d)
    running = o.filter("o_orderstatus = 'P'").select("o_custkey").distinct()
    quota = o.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n <= 20").select("o_custkey")
    return o.filter("o_orderstatus = 'O'").join(running, "o_custkey", "left_anti").join(quota, "o_custkey", "left_semi").groupBy("o_custkey").agg(F.min("o_orderkey").alias("next_run"))


def j17_valid_entry(spark, d):
    n = table(spark, d, "supplier").select("s_nationkey", F.to_date(F.date_add(F.lit("1992-01-01"), (F.col("s_suppkey") % 50 * 40).cast("int"))).alias("starts"), "s_suppkey").withColumn("ends", F.date_add("starts", 300))
    o = _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("s_nationkey"), F.to_date("o_orderdate").alias("as_of"))
    met = J.unique_at(o, n, "s_nationkey", "as_of", "starts", "ends", "s_suppkey").groupBy("o_orderkey").agg(F.sum("matches").alias("matches"), F.max("s_suppkey").alias("s_suppkey"))
    return met.select("o_orderkey", "matches", F.when(F.col("matches") == 1, F.col("s_suppkey")).alias("s_suppkey"))


def j18_as_of(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    cut = F.lit("2024-01-15").cast("timestamp")
    return e.filter(F.col("ts") <= cut).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


def j19_lookup(spark, d):
    m = table(spark, d, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return table(spark, d, "nation").join(F.broadcast(m), "n_regionkey", "left").select("n_name", F.coalesce("r_name", F.lit("undetermined")).alias("topic"))


def j21_proximity(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_timestamp("ts").alias("at"))
    return J.near(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), "user_id", "at", 900).select("user_id", "event_id")


def u_sets(spark, d):
    by = lambda t, k, v: table(spark, d, t).groupBy(k).agg(F.array_sort(F.collect_set(v)).alias(v))
    a = by("customer", "c_nationkey", "c_mktsegment").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("a"))
    b = table(spark, d, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("b"))
    x = a.join(b, "k", "left").withColumn("b", F.coalesce("b", F.array().cast("array<string>")))
    return x.select("k", S.same_set(F.col("a"), F.col("b")).alias("same"), S.subset(F.col("b"), F.col("a")).alias("within"), F.array_join(F.array_except("a", "b"), ",").alias("missing"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(S.ordered_union(F.col("b"), F.col("a"))).cast("long").alias("united"))


def u6_union_roles(spark, d):
    a = _orders(spark, d).filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    b = _orders(spark, d).filter("o_orderstatus = 'P'").select("o_custkey")
    return a.union(b).distinct()


def f1_optional_filter(spark, d):
    def listed(priority=None, status=None):
        out = _orders(spark, d)
        for col, value in (("o_orderpriority", priority), ("o_orderstatus", status)):
            out = out if value is None else out.filter(F.col(col) == value)
        return out

    return listed(status="F").groupBy("o_orderpriority").agg(F.count("*").alias("n")).union(listed("5-LOW", "O").groupBy(F.lit("low_open").alias("o_orderpriority")).agg(F.count("*").alias("n")))


def f2_facets(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    bucket = F.when(F.col("quality").isNull(), "hold").when(F.col("toxic") == 1, "provisional").otherwise("confirmed")
    found = F.instr(F.lower(F.concat_ws(" ", "source", "lang", "text")), "the") > 0
    return x.filter(found).groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def f4_declared_subset(spark, d):
    x = table(spark, d, "documents")
    reason = F.when(F.col("lang") != "en", "other_language").when(F.col("n_chars") < 200, "too_short")
    return x.groupBy(F.coalesce(reason, F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


def f12_readable(spark, d):
    letters = F.char_length(F.regexp_replace("text", "[^A-Za-zÀ-ÿ]", ""))
    return table(spark, d, "documents").select("doc_id", ((letters >= 80) & (F.regexp_count("text", F.lit(r"\(cid:")) < 3)).alias("readable"))


def f15_ordered_spans(spark, d):
    s = _spans(spark, d)
    w = Window.partitionBy("k").orderBy("start", "end", "id")
    return s.withColumn("fine", F.coalesce(F.lag("end").over(w) <= F.col("start"), F.lit(True))).groupBy("k").agg(F.bool_and("fine").alias("disjoint"))


def a1_summary(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    grade = F.when(F.col("quality").isNull(), None).when((F.col("quality") == 1) & (F.col("toxic") == 0), "E3").when(F.col("quality") == 1, "E2").otherwise("E0")
    n = lambda c: F.count_if(c)
    g = x.withColumn("g", grade)
    applicable = n(F.col("g").isNotNull())
    return g.groupBy("lang").agg(*[n(F.col("g") == e).alias(e) for e in ("E0", "E1", "E2", "E3")], n(F.col("g").isNull()).alias("undecided"), F.round(F.try_divide(n(F.col("g") == "E3"), F.nullif(applicable, F.lit(0))), 6).alias("rate"))


def a8_cost_totals(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"), F.col("l_returnflag").alias("snapshot"))
    state = F.when(F.count("cost") == 0, "unknown_cost").when(F.count("cost") < F.count("*"), "partial").otherwise("known")
    li = li.withColumn("cost", F.when(F.col("snapshot") != "R", F.col("cost")))
    return li.groupBy("l_suppkey").agg(F.sum("cost").alias("total"), state.alias("state"), F.when(F.count_distinct("snapshot") == 1, F.min("snapshot")).alias("price_list"))


def a10_caps(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,4)"))), F.lit(0).cast("decimal(28,4)")).alias("spent"))


def a13_signal_score(spark, d):
    hits = [(F.regexp_count("text", F.lit(p)), w, cap) for p, w, cap in (("the", 2, 5), ("tion", 3, 4), ("ment", 1, 10))]
    score = sum((F.least(c, F.lit(cap)) * w for c, w, cap in hits), F.lit(0))
    return table(spark, d, "documents").select("doc_id", score.cast("long").alias("score"))


def a15_metrics(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("y"), (~F.col("text").rlike(r"!!|\*\*\*| \| ")).alias("p"))
    tp, fp, fn = F.count_if(F.col("p") & F.col("y")), F.count_if(F.col("p") & ~F.col("y")), F.count_if(~F.col("p") & F.col("y"))
    return x.groupBy("lang").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(F.try_divide(tp, F.nullif(tp + fp, F.lit(0))), 6).alias("precision"), F.round(F.try_divide(tp, F.nullif(tp + fn, F.lit(0))), 6).alias("recall"))


def a17_confusion(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", F.when(F.col("text").rlike(r"!!|\*\*\*"), 0).otherwise(1).alias("predicted"))
    return x.groupBy("quality").pivot("predicted", [0, 1]).agg(F.count(F.lit(1))).select("quality", F.coalesce("0", F.lit(0)).alias("p0"), F.coalesce("1", F.lit(0)).alias("p1"))


def a18_browser_summary(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "click", "purchase")], F.round(F.sum(F.col("value").cast("decimal(18,4)")), 4).alias("seconds"))


def a19_failures(spark, d):
    o = _orders(spark, d).filter("o_orderstatus = 'P'")
    return o.groupBy(F.year("o_orderdate").alias("page"), "o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey"))).cast("array<string>"), ",").alias("ids"))


def a21_period_decision(spark, d):
    o = _orders(spark, d).groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("periods"), F.min(F.year("o_orderdate")).alias("period"), F.count_if(F.col("o_orderstatus") == "P").alias("unresolved"))
    return o.select("o_custkey", F.when((F.col("periods") == 1) & (F.col("unresolved") == 0), "detected").when(F.col("periods") == 0, "not_found").otherwise("ambiguous").alias("state"), F.when((F.col("periods") == 1) & (F.col("unresolved") == 0), F.col("period")).alias("period"))


def a22_capacity(spark, d):
    return table(spark, d, "documents").rollup("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def x_text(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    return x.select("doc_id", T.csv_safe(F.concat(F.when(F.col("doc_id") % 2 == 0, "=").otherwise(""), F.lit("a"))).alias("safe"), F.md5(T.normalized_key(F.col("t"))).alias("key_md5"), T.value_state(F.col("doc_id").cast("string")).alias("state"))


def x1_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"), F.md5(F.array_join(T.sentences(F.col("text")), "|")).alias("md5"))


def x19_periods(spark, d):
    k = F.col("o_orderkey")
    a, b = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", (k % 40 - 5).cast("int")), "yyyy-MM-dd")
    o = _orders(spark, d).select("o_orderkey", F.concat(a, F.lit("/"), b).alias("p"), F.when(k % 5 == 0, F.concat(F.year("o_orderdate"), F.lit("년"))).when(k % 5 == 1, F.concat(F.lit("fy "), F.year("o_orderdate"), F.lit(" Q2"))).when(k % 5 == 2, a).when(k % 5 == 3, F.concat(F.year("o_orderdate"), F.lit("-"), F.lit(1995))).otherwise(F.concat(a, F.lit(" ~ "), b)).alias("t"))
    p = D.parse_period(F.col("p"))
    return o.select("o_orderkey", D.is_supported_period(F.col("t")).alias("supported"), p["start"].alias("start"), p["end"].alias("end"))


def x24_year_apart(spark, d):
    o = _orders(spark, d).groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return o.select("o_custkey", D.one_year_apart(F.col("a"), F.col("b")).alias("apart"), (F.last_day("a") == F.to_date("a")).alias("month_end"))


def x27_amounts(spark, d):
    c = table(spark, d, "customer")
    money = F.col("c_acctbal").cast("decimal(12,2)")
    raw = F.when(money < 0, F.concat(F.lit("("), (-money).cast("string"), F.lit(")"))).otherwise(F.format_number(money.cast("double"), 2))
    unit = F.element_at(F.array(F.lit("원"), F.lit("천원"), F.lit("백만원"), F.lit("KRW"), F.lit(""), F.lit("억"), F.lit("조"), F.lit(None).cast("string"), F.lit("t")), (F.col("c_custkey") % 9 + 1).cast("int"))
    return c.select("c_custkey", D.normalize_amount(raw, unit).cast("decimal(30,4)").alias("amount"))


def x32_entity_set(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(S.entity_set(F.collect_list(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")))).alias("entities"))


def x35_page_refs(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("p. "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + F.col("p_partkey") % 4).cast("string"), F.lit(", "), F.col("p_size").cast("string")).alias("t"))
    return p.select("p_partkey", F.array_join(T.page_refs(F.col("t")).cast("array<string>"), ",").alias("pages"))


def s17_csv_sink(spark, d):
    return table(spark, d, "part").select("p_partkey", T.csv_safe(F.concat(F.when(F.col("p_size") % 5 == 0, "-").when(F.col("p_size") % 7 == 0, "@").otherwise(""), F.col("p_name"))).alias("cell"))


def z7_rate_buckets(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n")).filter("n > 1")


def z8_progress(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("progress"))


def z3_retry_delay(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 5).alias("attempt"), (F.col("event_id") % 7 != 0).alias("transient"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 100).alias("retry_after"))
    wait = F.coalesce(F.when(F.col("retry_after").isNotNull(), F.least(F.lit(60), F.col("retry_after"))), F.pow(F.lit(2.0), F.col("attempt")).cast("long"))
    pending = F.col("transient") & (F.col("attempt") < 3)
    return e.select("event_id", F.when(pending, "pending").otherwise("failed").alias("state"), F.when(pending, wait).alias("delay"))


SPAN = "SELECT l_orderkey AS k, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS start, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) + CAST(trunc(l_quantity) AS INTEGER) + 1 AS \"end\", l_linenumber AS id FROM lineitem"

QUERIES = {
    "w1_route_ranks": (w1_route_ranks, "WITH o AS (SELECT o_orderpriority, o_custkey, round(max(o_totalprice), 2) AS best FROM orders GROUP BY ALL) SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY best DESC, o_custkey) AS rank, o_custkey, best FROM o QUALIFY rank <= 20"),
    "w2_latest_revision": (w2_latest_revision, "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"),
    "w3_chain_verify": (w3_chain_verify, "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, md5(user_id || '|' || event_id || '|' || event_type) AS body FROM events), o AS (SELECT *, CASE WHEN event_id % 997 = 5 THEN 'forged' ELSE body END AS own FROM e) SELECT user_id, count(*) AS events, min(CASE WHEN own <> body THEN sequence END) AS first_break, arg_max(own, sequence) AS head FROM o GROUP BY user_id"),
    "w4_label_runs": (w4_label_runs, "WITH x AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS v FROM events), r AS (SELECT *, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS run FROM x) SELECT user_id, min(v) AS first, max(v) AS last, count(*) AS size FROM r GROUP BY user_id, run HAVING count(*) >= 3"),
    "w5_page_ranges": (w5_page_ranges, "WITH x AS (SELECT DISTINCT conv_id, turn AS v FROM conversations), r AS (SELECT *, v - row_number() OVER (PARTITION BY conv_id ORDER BY v) AS run FROM x) SELECT conv_id, min(v) AS first, max(v) AS last, count(*) AS size FROM r GROUP BY conv_id, run"),
    "w6_section_ranges": (w6_section_ranges, "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS ends FROM c JOIN l USING (conv_id)"),
    "w7_carry_forward": (w7_carry_forward, "WITH e AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS v, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, event_type, CASE WHEN r IS NULL OR v >= r THEN v END AS container FROM e"),
    "w8_previous_context": (w8_previous_context, "WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn) AS context_from FROM c"),
    "w9_gaps": (w9_gaps, f'WITH s AS ({SPAN}), g AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap_start FROM s) SELECT k, gap_start, start AS gap_end FROM g WHERE gap_start < start'),
    "w10_occurrences": (w10_occurrences, "SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS occurrence FROM lineitem"),
    "w12_running_attempts": (w12_running_attempts, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3 AS allowed FROM orders"),
    "w13_year_table": (w13_year_table, "WITH y AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL) SELECT *, lag(n) OVER (PARTITION BY o_orderpriority ORDER BY y) AS before, first_value(n) OVER (PARTITION BY o_orderpriority ORDER BY y DESC) AS latest FROM y"),
    "a9_budget_admission": (a9_budget_admission, "SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS cost, sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 1000000 AS within FROM orders"),
    "a20_nearest_rank": (a20_nearest_rank, "SELECT event_type, value FROM (SELECT event_type, round(value, 6) AS value FROM events) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) = ceil(0.95 * count(*) OVER (PARTITION BY event_type))"),
    "r4_page_components": (r4_page_components, f'WITH s AS ({SPAN}), g AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), p AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, "end", id) AS part FROM g) SELECT k, min(start) AS start, max("end") AS "end", count(*) AS spans FROM p GROUP BY k, part'),
    "s10_round_robin": (s10_round_robin, "SELECT p_partkey, p_size, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS turn FROM part QUALIFY turn <= 8 ORDER BY turn, p_brand LIMIT 40"),
    "t2_multi_key_order": (t2_multi_key_order, r"SELECT doc_id, regexp_matches(text, '[.!?]\s*$') AS closed, n_chars FROM documents ORDER BY closed DESC, n_chars, doc_id LIMIT 100"),
    "t3_capped_ranking": (t3_capped_ranking, "WITH x AS (SELECT doc_id, lang, len(regexp_extract_all(text, 'the|le|der|el')) AS hits FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hits DESC, doc_id) AS place FROM x) SELECT doc_id, lang, hits FROM r WHERE place <= CASE WHEN lang = 'en' THEN 8 ELSE 2 END ORDER BY hits DESC, doc_id LIMIT 10"),
    "t5_paging": (t5_paging, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200"),
    "t9_minimum": (t9_minimum, "SELECT user_id, min(event_id) AS first_id FROM events WHERE event_type = 'view' GROUP BY user_id"),
    "j1_citations": (j1_citations, "WITH r AS (SELECT doc_id FROM labels JOIN documents USING (doc_id)) SELECT CASE WHEN doc_id % 11 = 0 THEN 'not_found' WHEN doc_id % 7 = 0 THEN 'label_mismatch' WHEN doc_id % 5 = 0 THEN 'text_mismatch' ELSE 'verified' END AS verdict, count(*) AS n FROM r GROUP BY 1"),
    "j4_span_containment": (j4_span_containment, f'WITH s AS ({SPAN}) SELECT i.k, i.id AS inner_id, o.id AS outer_id FROM s i JOIN s o ON i.k = o.k AND i.id <> o.id AND o.start <= i.start AND i.start < i."end" AND i."end" <= o."end"'),
    "j5_unique_scope": (j5_unique_scope, "SELECT o_custkey, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"),
    "j6_complete_bindings": (j6_complete_bindings, "WITH i AS (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 50 = 0 THEN -l_partkey - 1 ELSE l_partkey END AS item FROM lineitem), m AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS wanted, count(p_partkey) AS found, sum(CAST(p_retailprice AS DECIMAL(18,2))) AS total FROM i LEFT JOIN part ON p_partkey = item GROUP BY l_orderkey) SELECT l_orderkey, wanted, found, CASE WHEN wanted = found THEN 'complete' ELSE 'observation_missing' END AS state, CASE WHEN wanted = found THEN total END AS total FROM m"),
    "j7_dimension_match": (j7_dimension_match, "WITH c AS (SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS customers FROM customer GROUP BY ALL), o AS (SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS segment, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL) SELECT c.c_nationkey, c.segment, customers, orders FROM c JOIN o ON c.c_nationkey IS NOT DISTINCT FROM o.c_nationkey AND c.segment IS NOT DISTINCT FROM o.segment"),
    "j9_year_over_year": (j9_year_over_year, """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, year(o_orderdate) AS y, o_orderstatus || '|' || CAST(o_totalprice AS DECIMAL(18,2)) AS content FROM orders WHERE year(o_orderdate) IN (1995, 1996)),
n AS (SELECT *, count(*) FILTER (y = 1996) OVER w AS n_now, count(*) FILTER (y = 1995) OVER w AS n_before FROM o WINDOW w AS (PARTITION BY o_custkey, o_orderpriority)),
a AS (SELECT * FROM n WHERE y = 1996), b AS (SELECT * FROM n WHERE y = 1995)
SELECT o_custkey, o_orderpriority, CASE WHEN y = 1996 THEN o_orderkey ELSE -1 END AS current_id, CASE WHEN y = 1995 THEN o_orderkey ELSE -1 END AS prior_id, 'ambiguous' AS change, 'comparison_key_not_unique' AS reason FROM n WHERE n_now > 1 OR n_before > 1
UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey, -1, 'new', 'target_new_in_current_version' FROM a WHERE n_now = 1 AND n_before = 0
UNION ALL SELECT o_custkey, o_orderpriority, -1, o_orderkey, 'removed_candidate', 'target_missing_from_current_version' FROM b WHERE n_before = 1 AND n_now = 0
UNION ALL SELECT a.o_custkey, a.o_orderpriority, a.o_orderkey, b.o_orderkey, 'modified', 'target_content_changed' FROM a JOIN b USING (o_custkey, o_orderpriority) WHERE a.n_now = 1 AND a.n_before = 1 AND a.content <> b.content"""),
    "p20_versions": (p20_versions, "WITH v AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS n FROM v) SELECT o_custkey, r.y AS y, CASE WHEN p.y = r.y - 1 THEN 'completed' ELSE 'not_run' END AS state, CASE WHEN p.y IS NULL THEN 'prior_document_version_missing' WHEN p.y <> r.y - 1 THEN 'prior_document_version_not_previous_year' ELSE '-' END AS reason FROM r LEFT JOIN (SELECT o_custkey, y FROM r WHERE n = 2) p USING (o_custkey) WHERE n = 1"),
    "j10_label_map": (j10_label_map, "WITH l AS (SELECT n_regionkey, n_nationkey AS label FROM nation UNION SELECT n_regionkey, n_nationkey + 1 FROM nation) SELECT n_regionkey, bool_and(s_suppkey IS NOT NULL) AS resolved, count(s_suppkey) AS pages, min(s_suppkey) AS first_page FROM l LEFT JOIN supplier ON s_nationkey = label GROUP BY n_regionkey"),
    "j11_assurance": (j11_assurance, "WITH s AS (SELECT n_regionkey, list(DISTINCT s_nationkey) AS covered FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), c AS (SELECT n_regionkey, c_mktsegment, list(DISTINCT c_nationkey) AS claimed FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT n_regionkey, c_mktsegment, CASE WHEN n_regionkey = 4 THEN 'undetermined' WHEN c_mktsegment = 'FURNITURE' OR c_mktsegment = 'MACHINERY' OR NOT list_has_all(covered, claimed) THEN 'not_covered' ELSE 'covered' END AS verdict FROM c JOIN s USING (n_regionkey)"),
    "j13_anti": (j13_anti, "SELECT lang, count(*) AS unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang"),
    "j14_claimable": (j14_claimable, "SELECT o_custkey, min(o_orderkey) AS next_run FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderstatus = 'P') AND (SELECT count(*) FROM orders q WHERE q.o_custkey = o.o_custkey) <= 20 GROUP BY o_custkey"),
    "j17_valid_entry": (j17_valid_entry, "WITH n AS (SELECT s_nationkey, s_suppkey, DATE '1992-01-01' + CAST(s_suppkey % 50 * 40 AS INTEGER) AS starts FROM supplier), o AS (SELECT o_orderkey, c_nationkey, CAST(o_orderdate AS DATE) AS as_of FROM orders JOIN customer ON o_custkey = c_custkey) SELECT o_orderkey, count(s_suppkey) AS matches, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS s_suppkey FROM o LEFT JOIN n ON s_nationkey = c_nationkey AND starts <= as_of AND as_of < starts + 300 GROUP BY o_orderkey"),
    "j18_as_of": (j18_as_of, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY user_id"),
    "j19_lookup": (j19_lookup, "SELECT n_name, CASE WHEN n_regionkey < 3 THEN r_name ELSE 'undetermined' END AS topic FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "j21_proximity": (j21_proximity, "SELECT user_id, event_id FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND a.user_id = b.user_id AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 900)"),
    "u1_u5_sets": (u_sets, "WITH a AS (SELECT c_nationkey AS k, list(DISTINCT c_mktsegment) AS a, coalesce(list(DISTINCT c_mktsegment) FILTER (c_acctbal > 5000), []) AS b FROM customer GROUP BY 1) SELECT k, len(b) > 0 AND list_has_all(a, b) AND list_has_all(b, a) AS same, list_has_all(a, b) AS within, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missing, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS united FROM a"),
    "u6_union_roles": (u6_union_roles, "SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"),
    "f1_optional_filter": (f1_optional_filter, "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT 'low_open', count(*) FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'O' HAVING count(*) > 0"),
    "f2_facets": (f2_facets, "SELECT lang, CASE WHEN quality IS NULL THEN 'hold' WHEN toxic = 1 THEN 'provisional' ELSE 'confirmed' END AS bucket, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE instr(lower(source || ' ' || lang || ' ' || text), 'the') > 0 GROUP BY 1, 2"),
    "f4_declared_subset": (f4_declared_subset, "SELECT CASE WHEN lang <> 'en' THEN 'other_language' WHEN n_chars < 200 THEN 'too_short' ELSE 'selected' END AS reason, count(*) AS n FROM documents GROUP BY 1"),
    "f12_readable": (f12_readable, r"SELECT doc_id, length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) >= 80 AND len(regexp_extract_all(text, '\(cid:')) < 3 AS readable FROM documents"),
    "f15_ordered_spans": (f15_ordered_spans, f'WITH s AS ({SPAN}), f AS (SELECT k, coalesce(lag("end") OVER (PARTITION BY k ORDER BY start, "end", id) <= start, true) AS fine FROM s) SELECT k, bool_and(fine) AS disjoint FROM f GROUP BY k'),
    "a1_summary": (a1_summary, "WITH g AS (SELECT lang, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 'E3' WHEN quality = 1 THEN 'E2' ELSE 'E0' END AS g FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, count(*) FILTER (g = 'E0') AS \"E0\", count(*) FILTER (g = 'E1') AS \"E1\", count(*) FILTER (g = 'E2') AS \"E2\", count(*) FILTER (g = 'E3') AS \"E3\", count(*) FILTER (g IS NULL) AS undecided, round(count(*) FILTER (g = 'E3') / nullif(count(g), 0), 6) AS rate FROM g GROUP BY lang"),
    "a8_cost_totals": (a8_cost_totals, "WITH l AS (SELECT l_suppkey, l_returnflag AS snapshot, CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS cost FROM lineitem) SELECT l_suppkey, sum(cost) AS total, CASE WHEN count(cost) = 0 THEN 'unknown_cost' WHEN count(cost) < count(*) THEN 'partial' ELSE 'known' END AS state, CASE WHEN count(DISTINCT snapshot) = 1 THEN min(snapshot) END AS price_list FROM l GROUP BY l_suppkey"),
    "a10_caps": (a10_caps, "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) END), 0) AS spent FROM events GROUP BY 1"),
    "a13_signal_score": (a13_signal_score, "SELECT doc_id, CAST(2 * least(len(regexp_extract_all(text, 'the')), 5) + 3 * least(len(regexp_extract_all(text, 'tion')), 4) + least(len(regexp_extract_all(text, 'ment')), 10) AS BIGINT) AS score FROM documents"),
    "a15_metrics": (a15_metrics, r"WITH x AS (SELECT lang, quality = 1 AS y, NOT regexp_matches(text, '!!|\*\*\*| \| ') AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM x GROUP BY lang) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"),
    "a17_confusion": (a17_confusion, r"WITH x AS (SELECT quality, CASE WHEN regexp_matches(text, '!!|\*\*\*') THEN 0 ELSE 1 END AS p FROM documents JOIN labels USING (doc_id)) SELECT quality, count(*) FILTER (p = 0) AS p0, count(*) FILTER (p = 1) AS p1 FROM x GROUP BY quality"),
    "a18_browser_summary": (a18_browser_summary, "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, round(sum(CAST(value AS DECIMAL(18,4))), 4) AS seconds FROM events GROUP BY user_id"),
    "a19_failures": (a19_failures, "SELECT year(o_orderdate) AS page, o_orderpriority, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2"),
    "a21_period_decision": (a21_period_decision, "WITH o AS (SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n, min(year(o_orderdate)) AS p, count(*) FILTER (o_orderstatus = 'P') AS u FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN n = 1 AND u = 0 THEN 'detected' WHEN n = 0 THEN 'not_found' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 AND u = 0 THEN p END AS period FROM o"),
    "a22_capacity": (a22_capacity, "SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)"),
    "x1_sentences": (x1_sentences, None),
    "x4_x13_text": (x_text, r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '''=a' ELSE 'a' END AS safe, md5(replace(lower(nfc_normalize(trim(regexp_replace(text, '\s+', ' ', 'g')))), 'ß', 'ss')) AS key_md5, 'present' AS state FROM documents"),
    "x19_periods": (x19_periods, "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER) AS b FROM orders) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN year(a) <= 1995 WHEN 4 THEN a <= b ELSE true END AS supported, CASE WHEN a <= b THEN a END AS start, CASE WHEN a <= b THEN b END AS \"end\" FROM o"),
    "x24_year_apart": (x24_year_apart, "WITH o AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) SELECT o_custkey, year(b) = year(a) + 1 AND month(a) = month(b) AND day(a) = day(b) AS apart, last_day(a) = CAST(a AS DATE) AS month_end FROM o"),
    "x27_amounts": (x27_amounts, "SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) * CASE c_custkey % 9 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 5 THEN 100000000 WHEN 6 THEN 1000000000000 WHEN 8 THEN NULL ELSE 1 END AS DECIMAL(30,4)) AS amount FROM customer"),
    "x32_entity_set": (x32_entity_set, "SELECT n_regionkey, '[' || string_agg('\"' || lower(n_name) || '\"', ',' ORDER BY lower(n_name)) || ']' AS entities FROM nation GROUP BY 1"),
    "x35_page_refs": (x35_page_refs, "SELECT p_partkey, array_to_string(range(p_size, p_size + p_partkey % 4 + 1), ',') AS pages FROM part"),
    "s17_csv_sink": (s17_csv_sink, "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '''-' WHEN p_size % 7 = 0 THEN '''@' ELSE '' END || p_name AS cell FROM part"),
    "z3_retry_delay": (z3_retry_delay, "SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 5 < 3 THEN 'pending' ELSE 'failed' END AS state, CASE WHEN event_id % 7 <> 0 AND event_id % 5 < 3 THEN CASE WHEN event_id % 3 = 0 THEN least(60, event_id % 100) ELSE CAST(pow(2, event_id % 5) AS BIGINT) END END AS delay FROM events"),
    "z7_rate_buckets": (z7_rate_buckets, "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1"),
    "z8_progress": (z8_progress, "SELECT user_id, max(event_id) AS progress FROM events GROUP BY user_id"),
}

#: The registry's digest rules, on the SQL side: columns that SQL must convert.
DIGEST = {
    "w3_chain_verify": "coalesce(first_break, -1) AS first_break",
    "w7_carry_forward": "coalesce(container, -1) AS container",
    "w13_year_table": "coalesce(before, -1) AS before",
    "a9_budget_admission": "CAST(cost AS DOUBLE) AS cost",
    "j5_unique_scope": "coalesce(o_orderkey, -1) AS o_orderkey",
    "j6_complete_bindings": "CAST(total AS DOUBLE) AS total",
    "j17_valid_entry": "coalesce(s_suppkey, -1) AS s_suppkey",
    "a8_cost_totals": "CAST(total AS DOUBLE) AS total",
    "a10_caps": "CAST(spent AS DOUBLE) AS spent, CAST(day AS VARCHAR) AS day",
    "a18_browser_summary": "CAST(seconds AS DOUBLE) AS seconds",
    "a21_period_decision": "coalesce(period, -1) AS period",
    "x19_periods": 'CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end"',
    "x27_amounts": "CAST(amount AS DOUBLE) AS amount",
    "z3_retry_delay": "coalesce(delay, -1) AS delay",
}
for _name, _columns in DIGEST.items():
    QUERIES[_name] = (QUERIES[_name][0], f"SELECT * REPLACE ({_columns}) FROM ({QUERIES[_name][1]})")
