"""Listings of documents and runs, their pages, and the books kept about them."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.operators import sizing


def live(rows: DataFrame, tombstones: DataFrame, key: Sequence[str], *, owners: DataFrame | None = None) -> DataFrame:
    """Rows without a tombstone; with owners (already those of one user), only those owned."""
    out = rows.join(tombstones, list(key), "left_anti")
    return out if owners is None else out.join(owners, list(key), "left_semi")


def numbered(rows: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """rows with their place in the whole order, from 1. Rows are sorted into ranges, and each range starts after the rows
    of those before it, so no task sees all rows. The ranges are staged: a lost one must come back as it was."""
    ranged = sizing.staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(before, "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")


def after(created: str, key: str, position: tuple | None) -> Column:
    """Rows that follow a position in an order by created and key, both descending."""
    if position is None:
        return F.lit(True)
    return (F.col(created) < position[0]) | ((F.col(created) == position[0]) & (F.col(key) < position[1]))


def keyset_page(rows: DataFrame, created: str, key: str, limit: int, position: tuple | None = None) -> DataFrame:
    """The next `limit` rows, newest first, and `more`: does another page follow? One row more than the page is read, by a
    limit that each task applies first."""
    read = rows.filter(after(created, key, position)).orderBy(F.desc(created), F.desc(key)).limit(limit + 1)
    nth = F.row_number().over(Window.orderBy(F.desc(created), F.desc(key)))
    out = read.withColumn("_nth", nth).withColumn("more", F.max("_nth").over(Window.partitionBy(F.lit(0))) > limit)
    return out.filter(F.col("_nth") <= limit).drop("_nth")


def range_page(rows: DataFrame, sequence: str, last: int, cutoff: int, limit: int) -> DataFrame:
    """The next rows of a frozen stretch of a log: after `last`, up to the cutoff that the first page has pinned."""
    read = rows.filter((F.col(sequence) > last) & (F.col(sequence) <= cutoff)).orderBy(sequence).limit(limit + 1)
    out = read.withColumn("_nth", F.row_number().over(Window.orderBy(sequence))).withColumn("more", F.max("_nth").over(Window.partitionBy(F.lit(0))) > limit)
    return out.filter(F.col("_nth") <= limit).drop("_nth")


def prefixed(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with the prefix, in the order of the key; a scan can prune by it."""
    return rows.filter(F.col(key).startswith(prefix)).orderBy(key)


def reuse_candidates(documents: DataFrame, runs: DataFrame, progress: DataFrame, tombstones: DataFrame, *, document_key: str, run_key: str, now: int, statuses: Sequence[str] = ("completed", "partial_blocked")) -> DataFrame:
    """Finished runs of living documents with a ready result, newest first within each document content."""
    kept = live(documents.filter(F.col("expires") > now), tombstones, [document_key])
    out = runs.filter(F.col("status").isin(*statuses)).join(progress.filter("result_ready").select(run_key), run_key, "left_semi").join(kept, document_key)
    rank = F.row_number().over(Window.partitionBy("content").orderBy(F.desc("created"), run_key))
    return out.withColumn("candidate", rank)


def active(pointers: DataFrame, heads: DataFrame, revisions: DataFrame, key: Sequence[str]) -> DataFrame:
    """What the active pointers stand for: pointer -> head -> revision."""
    return pointers.join(heads, list(key)).join(revisions, [*key, "revision"])


def first_history(heads: DataFrame, revisions: DataFrame, history: DataFrame, key: Sequence[str], row: str) -> DataFrame:
    """Head revisions with the first row of their history."""
    begun = history.groupBy(*key).agg(F.min(row).alias("first_row"))
    return heads.join(revisions, [*key, "revision"]).join(begun, list(key), "left")


def spend_check(runs: DataFrame, charges: DataFrame, bound: str) -> DataFrame:
    """runs: run, event, day, grp, run_cap, day_cap, event_cap, group_cap and the amount `bound` that a run asks for;
    charges: run, amount (decimal). Adds the four totals and admitted: no cap would be passed. Each total is summed once
    per event, day, run and group, before it meets the runs."""
    per_run = runs.select("run", "event", "day", "grp").join(charges.groupBy("run").agg(F.sum("amount").alias("spent")), "run", "left").withColumn("spent", F.coalesce("spent", F.lit(0).cast("decimal(38,4)")))
    out = runs.join(per_run.select("run", F.col("spent").alias("run_total")), "run")
    for name, keys in (("event_total", ["event"]), ("day_total", ["event", "day"]), ("group_total", ["event", "grp"])):
        out = out.join(per_run.groupBy(*keys).agg(F.sum("spent").alias(name)), keys, "left")
    fits = (F.col("event_total") + F.col(bound) <= F.col("event_cap")) & (F.col("day_total") + F.col(bound) <= F.col("day_cap")) & (F.col("run_total") + F.col(bound) <= F.col("run_cap"))
    return out.withColumn("admitted", fits & (F.col("grp").isNull() | F.col("group_cap").isNull() | (F.col("group_total") + F.col(bound) <= F.col("group_cap"))))


def archived(spend: DataFrame, totals: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """(spend rows that stay, totals with the others added). Settled rows from before the cutoff leave only their sum per
    event; what is not settled stays whatever its age."""
    old = (F.col("status") == "settled") & (F.col("created") < cutoff)
    rolled = sizing.together(spend.filter(old).select("event", "amount"), totals.select("event", "amount")).groupBy("event").agg(F.sum("amount").alias("amount"))
    return spend.filter(~F.coalesce(old, F.lit(False))), rolled


def frozen(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """A list as it is now: staged with its ordinals, so that later pages never see later rows."""
    return sizing.staged(numbered(rows, order), "frozen")


def frozen_page(snapshot: DataFrame, position: int, limit: int) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 rows")
    return snapshot.filter((F.col("ordinal") > position) & (F.col("ordinal") <= position + limit))


def cursor(secret: bytes, scope: Sequence[str], position: int, expires: int) -> str:
    """A signed position of one listing."""
    body = json.dumps([list(scope), position, expires], separators=(",", ":"))
    return body + "." + hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()


def position_of(secret: bytes, scope: Sequence[str], text: str, now: int) -> int:
    """The position of a cursor; a forged, foreign or expired one is an error."""
    body, _, sign = text.rpartition(".")
    if not hmac.compare_digest(sign, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()):
        raise ValueError("the cursor is not signed")
    own, position, expires = json.loads(body)
    if own != list(scope):
        raise ValueError("the cursor is of another listing")
    if expires <= now:
        raise ValueError("the cursor has expired")
    return position
