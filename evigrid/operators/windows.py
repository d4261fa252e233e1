"""Ordered patterns as window expressions: revisions, chains, islands, section ranges, gaps, running limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first by `order`. The rank limit is applied map-side before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def islands(df: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive distinct integers per key: keys, first, last, size."""
    once = df.select(*keys, F.col(value).cast("long").alias("v")).distinct()
    run = once.withColumn("run", F.col("v") - F.row_number().over(Window.partitionBy(*keys).orderBy("v")))
    return run.groupBy(*keys, "run").agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("size")).filter(F.col("size") >= least).drop("run")


def section_ends(df: DataFrame, keys: Sequence[str], start: str, end_of_all: Column) -> Column:
    """The next section's start minus one, or the end of the whole."""
    return F.coalesce(F.lead(start).over(Window.partitionBy(*keys).orderBy(start)) - 1, end_of_all)


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, reset: Column) -> Column:
    """The last non-null value since the last reset row (whose own value starts afresh)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last_reset = F.max(F.when(reset, F.struct(*order))).over(w)
    last_value = F.max(F.when(value.isNotNull(), F.struct(*order, value.alias("_v")))).over(w)
    after = last_reset.isNull() | (F.struct(*[last_value[c] for c in order]) >= last_reset)
    return F.when(after, last_value["_v"])


def gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Stretches that no span covers, between ordered spans."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("gap_start", reach).filter(F.col("gap_start") < F.col(start)).select(*keys, "gap_start", F.col(start).alias("gap_end"))


def merged(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching spans."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).over(w)
    return df.withColumn("_part", part).groupBy(*keys, "_part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("spans")).drop("_part")


def chain_verdicts(df: DataFrame, keys: Sequence[str], sequence: str, previous: str, own: str, recomputed: Column) -> DataFrame:
    """Per chain: is it gapless from 1, does each event name its predecessor's hash, and does each hash recompute?"""
    w = Window.partitionBy(*keys).orderBy(sequence)
    fine = (F.col(sequence) == F.row_number().over(w)) & F.col(previous).eqNullSafe(F.lag(own).over(w)) & (F.col(own) == recomputed)
    return df.withColumn("_fine", fine).groupBy(*keys).agg(F.count("*").alias("events"), F.min(F.when(~F.col("_fine"), F.col(sequence))).alias("first_break"), F.max_by(own, sequence).alias("head"))


def running_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, limit: float | int) -> Column:
    """Does the running sum up to and with the row stay within the limit?"""
    return F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) <= limit


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, share: float) -> DataFrame:
    """by, value: the value at place ceil(share * n) of each group's order. Values are counted map-side, so a large group
    is not sorted in one task."""
    return df.groupBy(*by).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias(value))


def interleave(df: DataFrame, kind: str, order: Sequence[str], each: int, most: int) -> DataFrame:
    """Round robin over kinds: the first of each, then the second, with at most `each` per kind and `most` in all."""
    own = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return df.withColumn("turn", own).filter(F.col("turn") <= each).orderBy("turn", kind).limit(most)
