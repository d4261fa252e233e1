"""Gates, statuses and remaining scalar operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigrid.functions import periods as D
from evigrid.functions import text as T
from evigrid.operators import retrieval as R
from evigrid.operators import windows as W
from evigrid.sources.tables import table


def q12_merged_windows(spark, d):
    e = table(spark, d, "events").filter("event_type = 'click'").select("user_id", F.unix_timestamp("ts").alias("at"))
    return W.merged(e.select("user_id", (F.col("at") - 600).alias("start"), (F.col("at") + 600).alias("end")), ["user_id"], "start", "end")


def f8_policy_gate(spark, d):
    k = F.col("p_partkey")
    reason = F.when(k % 11 == 0, "policy_unapproved").when(k % 7 == 0, "stage_not_supported").when(k % 5 == 0, "synthetic_policy_real_packet").when(k % 3 == 0, "item_not_enabled").otherwise("open")
    return table(spark, d, "part").select(k, reason.alias("reason"))


def f10_validity(spark, d):
    x = table(spark, d, "supplier").select("s_suppkey", F.date_add(F.lit("1995-01-01"), (F.col("s_suppkey") * 11 % 900).cast("int")).alias("starts"))
    ends = F.when(F.col("s_suppkey") % 4 != 0, F.date_add("starts", 200))
    return x.select("s_suppkey", D.valid_at(F.lit("1996-06-01").cast("date"), F.col("starts"), ends).alias("valid"))


def j3_table_compatibility(spark, d):
    """Cells pair up only where their parents pair up."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parents = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b")).filter("a < b")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    left, right = li.select(F.col("l_orderkey").alias("a"), "l_linenumber"), li.select(F.col("l_orderkey").alias("b"), "l_linenumber")
    return parents.join(left, "a").join(right, ["b", "l_linenumber"]).select("a", "b", "l_linenumber")


def j15_head_revision(spark, d):
    o = table(spark, d, "orders").withColumn("rev", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    heads = o.groupBy("o_custkey").agg(F.max("rev").alias("rev")).select("o_custkey", F.concat("o_custkey", F.lit(":"), F.lpad(F.col("rev").cast("string"), 10, "0")).alias("k"))
    rows = o.select(F.concat("o_custkey", F.lit(":"), F.lpad(F.col("rev").cast("string"), 10, "0")).alias("k"), "o_orderkey", "o_orderstatus")
    return heads.join(rows, "k").select("o_custkey", "o_orderkey", "o_orderstatus")


def j16_using(spark, d):
    r = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    return r.join(F.broadcast(n), ["nation"]).groupBy("n_name").agg(F.count("*").alias("n"))


def w14_cumulative(spark, d):
    x = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y"), "l_returnflag").agg(F.count("*").alias("n"))
    return x.withColumn("running", F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("y")))


def x11_number_literal(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.format_number("p_retailprice", 2)).when(F.col("p_partkey") % 4 == 1, "-").when(F.col("p_partkey") % 4 == 2, F.col("p_name")).otherwise(F.col("p_size").cast("string")).alias("cell"))
    return x.select("p_partkey", T.value_state(F.col("cell")).alias("state"), F.coalesce(T.number_literal(F.col("cell")), F.lit("")).alias("value"))


def x25_display_interval(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(12,1)").cast("string").alias("raw"))
    low, high = D.display_interval(F.col("raw"), F.lit(1000))
    return x.select("p_partkey", F.round(low.cast("double"), 4).alias("low"), F.round(high.cast("double"), 4).alias("high"))


QUERIES = {
    "q12_merged_windows": (q12_merged_windows, 'WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - 600 AS start, CAST(floor(epoch(ts)) AS BIGINT) + 600 AS "end" FROM events WHERE event_type = \'click\'), g AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), p AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, "end") AS part FROM g) SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS spans FROM p GROUP BY user_id, part'),
    "f8_policy_gate": (f8_policy_gate, "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'policy_unapproved' WHEN p_partkey % 7 = 0 THEN 'stage_not_supported' WHEN p_partkey % 5 = 0 THEN 'synthetic_policy_real_packet' WHEN p_partkey % 3 = 0 THEN 'item_not_enabled' ELSE 'open' END AS reason FROM part"),
    "f10_validity": (f10_validity, "SELECT s_suppkey, DATE '1995-01-01' + CAST(s_suppkey * 11 % 900 AS INTEGER) <= DATE '1996-06-01' AND (s_suppkey % 4 = 0 OR DATE '1996-06-01' < DATE '1995-01-01' + CAST(s_suppkey * 11 % 900 AS INTEGER) + 200) AS valid FROM supplier"),
    "j3_table_compatibility": (j3_table_compatibility, "WITH p AS (SELECT min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY o_custkey, o_orderpriority HAVING min(o_orderkey) < max(o_orderkey)), l AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT a, b, x.l_linenumber FROM p JOIN l x ON x.l_orderkey = a JOIN l y ON y.l_orderkey = b AND x.l_linenumber = y.l_linenumber"),
    "j15_head_revision": (j15_head_revision, "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1"),
    "j16_using": (j16_using, "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "w13_running_totals": (w14_cumulative, "WITH x AS (SELECT year(l_shipdate) AS y, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY y) AS BIGINT) AS running FROM x"),
    "x11_number_literal": (x11_number_literal, "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'missing' WHEN 2 THEN 'unreadable' ELSE 'present' END AS state, CASE p_partkey % 4 WHEN 0 THEN printf('%.2f', p_retailprice) WHEN 3 THEN CAST(p_size AS VARCHAR) ELSE '' END AS value FROM part"),
    "x25_display_interval": (x25_display_interval, "SELECT p_partkey, round(CAST((CAST(p_retailprice AS DECIMAL(12,1)) - 0.05) * 1000 AS DOUBLE), 4) AS low, round(CAST((CAST(p_retailprice AS DECIMAL(12,1)) + 0.05) * 1000 AS DOUBLE), 4) AS high FROM part"),
}
