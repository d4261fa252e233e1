"""Joins by containment, proximity, validity and uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verified_refs(refs: DataFrame, blocks: DataFrame, key: str, checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Each reference with its verdict: the first failing check in order (reference column, block column, reason), or
    `verified`; a reference without a block is `not_found`."""
    own = blocks.select(F.col(key), *[F.col(b).alias(f"_b{n}") for n, (_, b, _) in enumerate(checks)], F.lit(True).alias("_found"))
    verdict = F.when(F.col("_found").isNull(), "not_found")
    for n, (r, _, reason) in enumerate(checks):
        verdict = verdict.when(~F.col(r).eqNullSafe(F.col(f"_b{n}")), reason)
    out = refs.join(own, key, "left").withColumn("verdict", verdict.otherwise("verified"))
    return out.drop("_found", *[f"_b{n}" for n in range(len(checks))])


def contained(inner: DataFrame, outer: DataFrame, key: str, width: int) -> DataFrame:
    """Spans (key, start, end, id) inside spans of the same key: inner_id, outer_id. The outer spans are posted in every
    stretch of `width` they touch, so that the join is an equi-join on (key, stretch) instead of a range scan."""
    o = outer.select(F.col(key), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("id").alias("outer_id")).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("o_start") / width), F.floor(F.col("o_end") / width))))
    i = inner.select(F.col(key), F.col("start").alias("i_start"), F.col("end").alias("i_end"), F.col("id").alias("inner_id")).withColumn("stretch", F.floor(F.col("i_start") / width))
    return i.join(o, [key, "stretch"]).filter("o_start <= i_start and i_start < i_end and i_end <= o_end").select(key, "inner_id", "outer_id")


def unique_or_null(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value where exactly one row matches, else null: ambiguity is not resolved by choosing."""
    return df.groupBy(*keys).agg(F.count("*").alias("matches"), F.when(F.count("*") == 1, F.first(value)).alias(value))


def unique_at(points: DataFrame, entries: DataFrame, key: str, at: str, starts: str, ends: str, value: str, *, days: int = 64) -> DataFrame:
    """points with matches and value: how many entries of the key are valid at the day (from starts, before ends; a null end
    is open), and the value (a whole number) where it is exactly one, else null.

    No point meets the entries themselves: their begins and ends are counted by key and day, and running sums of counts and
    of values say what holds from each such day to the next. These spans are posted in stretches of `days`."""
    kind = dict(entries.dtypes)[value]
    proper = F.col(value).isNotNull() & F.col(starts).isNotNull() & (F.col(ends).isNull() | (F.col(ends) > F.col(starts)))
    turns = entries.filter(proper).select(key, F.col(value).cast("decimal(20,0)").alias("_v"), F.inline(F.array(F.struct(F.col(starts).alias("_from"), F.lit(1).alias("_d")), F.struct(F.col(ends).alias("_from"), F.lit(-1).alias("_d")))))
    turns = turns.filter("_from is not null").groupBy(key, "_from").agg(F.sum("_d").alias("_d"), F.sum(F.when(F.col("_d") > 0, F.col("_v")).otherwise(-F.col("_v"))).alias("_v"))
    w = Window.partitionBy(key).orderBy("_from")
    spans = turns.select(key, "_from", F.lead("_from").over(w).alias("_until"), F.sum("_d").over(w).alias("_n"), F.sum("_v").over(w).alias("_v")).filter("_n > 0").withColumn("_v", F.when(F.col("_n") == 1, F.col("_v").cast(kind)))
    stretch = lambda day: F.floor(F.unix_date(day) / days)
    closed = spans.filter("_until is not null").withColumn("_s", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.date_sub("_until", 1))))).withColumnRenamed(key, "_key")
    still = spans.filter("_until is null").select(F.col(key).alias("_key2"), F.col("_from").alias("_since"), F.col("_n").alias("_n2"), F.col("_v").alias("_v2"))
    met = points.join(closed, (F.col(key) == F.col("_key")) & (stretch(F.col(at)) == F.col("_s")) & (F.col("_from") <= F.col(at)) & (F.col(at) < F.col("_until")), "left")
    met = met.join(still, (F.col(key) == F.col("_key2")) & (F.col("_since") <= F.col(at)), "left")
    return met.select(*points.columns, F.coalesce("_n", "_n2", F.lit(0)).alias("matches"), F.coalesce("_v", "_v2").alias(value))


def near(left: DataFrame, right: DataFrame, key: str, position: str, distance: int) -> DataFrame:
    """Rows of `left` with a row of `right` under the same key at most `distance` away: both sides meet in stretches of
    that width, the right side posted in its own and both neighbours."""
    r = right.select(F.col(key), F.col(position).alias("_p")).withColumn("_s", F.explode(F.array(*[F.floor(F.col("_p") / distance) + d for d in (-1, 0, 1)])))
    rows = left.withColumn("_s", F.floor(F.col(position) / distance))
    return rows.join(r, (rows[key] == r[key]) & (rows["_s"] == r["_s"]) & (F.abs(rows[position] - r["_p"]) <= distance), "left_semi").drop("_s")


def complete_lookup(owners: DataFrame, items: DataFrame, owner: str, ids: str, item: str, value: str) -> DataFrame:
    """Sums over a list of item ids; a missing id leaves the sum null with the state observation_missing."""
    each = owners.select(owner, F.size(ids).alias("wanted"), F.explode_outer(ids).alias(item))
    met = each.join(items.select(item, value, F.lit(1).alias("_met")), item, "left").groupBy(owner).agg(F.first("wanted").alias("wanted"), F.count("_met").alias("found"), F.sum(value).alias("total"))
    full = F.col("wanted") == F.col("found")
    return met.select(owner, "wanted", "found", F.when(full, "complete").otherwise("observation_missing").alias("state"), F.when(full, F.col("total")).alias("total"))


def axis_test(claimed: Column, covered: Column) -> Column:
    """Is the claim's set within the covered set? An empty side is unknown."""
    return F.when((F.size(claimed) == 0) | (F.size(covered) == 0), "unknown").when(F.size(F.array_except(claimed, covered)) == 0, "yes").otherwise("no")


def coverage(axes: Sequence[Column], *, ambiguous: Column, excluded: Column, resolved: Column, level: Column, complete: Column) -> Column:
    """covered, not_covered or undetermined of an assurance statement for a claim; exclusions dominate."""
    no, yes = F.lit(False), F.lit(True)
    for a in axes:
        no, yes = no | (a == "no"), yes & (a == "yes")
    return (
        F.when(ambiguous, "undetermined").when(excluded, "not_covered").when(~resolved, "undetermined").when((level == "none") | no, "not_covered")
        .when(yes & complete & level.isin("limited", "reasonable"), "covered").otherwise("undetermined")
    )


def pair_up(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe equi-join on several keys."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return left.join(right, on).drop(*[right[k] for k in keys])
