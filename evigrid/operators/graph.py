"""Closures over parent edges, iterated until nothing new is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrid.operators import sizing


def ancestors(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """edges: child, parent. Returns node, ancestor, distance (the least). A node that is its own ancestor is an error.
    nodes (one column): only the ancestors of these, and only cycles that one of these is in.

    Each round extends the newest pairs by one step and keeps those not met before, so the work is that of the closure,
    not of its paths, and a cycle of any length is met in the round of its length. Edges and rounds are staged; edges are
    worked out once and not told apart, only the pairs that come of them."""
    step = edges.select(F.col("child").alias("at"), F.col("parent").alias("next")).filter("at is not null and next is not null")
    step = sizing.staged(step, "edges")
    begin = step
    if nodes is not None:
        begin = step.join(sizing.unsent(nodes.select(F.col(nodes.columns[0]).alias("at"))), "at", "left_semi")
    newest = sizing.staged(begin.select(F.col("at").alias("node"), F.col("next").alias("ancestor"), F.lit(1).alias("distance")).distinct(), "ancestors")
    every, rounds = newest, 1
    while not newest.isEmpty():
        if not newest.filter("node = ancestor").isEmpty():
            raise ValueError("cycle in parent edges")
        rounds += 1
        found = newest.join(step, F.col("ancestor") == F.col("at")).select("node", F.col("next").alias("ancestor")).distinct()
        newest = sizing.staged(found.join(every.select("node", "ancestor"), ["node", "ancestor"], "left_anti").withColumn("distance", F.lit(rounds)), "ancestors")
        every = sizing.together(every, newest)
    return every


def bundles(blocks: DataFrame, edges: DataFrame, attached: DataFrame) -> DataFrame:
    """For each block: itself, its ancestors, and what is attached (captions, footnotes) to any of these. blocks: id;
    attached: id, target. Returns root, member."""
    own = blocks.select(F.col("id").alias("root"), F.col("id").alias("member"))
    core = sizing.together(own, ancestors(edges).select(F.col("node").alias("root"), F.col("ancestor").alias("member")).join(blocks.select(F.col("id").alias("root")), "root", "left_semi"))
    extra = core.join(attached.select(F.col("target").alias("member"), F.col("id").alias("extra")), "member").select("root", F.col("extra").alias("member"))
    return sizing.together(core, extra).distinct()


def note_targets(roots: DataFrame, parents: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that hold for an observation: those of its own blocks and of their ancestors. roots: id; parents: child,
    parent; notes: note, target. Returns id, note, distance (0: its own block; the least, if a note is met twice)."""
    reach = sizing.together(roots.select("id", F.col("id").alias("target"), F.lit(0).alias("distance")), ancestors(parents).select(F.col("node").alias("id"), F.col("ancestor").alias("target"), "distance").join(roots.select("id").distinct(), "id", "left_semi"))
    return reach.join(notes.select("target", "note"), "target").groupBy("id", "note").agg(F.min("distance").alias("distance"))


def nearest_section(blocks: DataFrame, edges: DataFrame, headings: DataFrame) -> DataFrame:
    """The closest ancestor over section edges that is a heading (id, title); null without one. Of several at the same
    distance none is taken. blocks: id. Returns id, section, title."""
    up = ancestors(edges).withColumnRenamed("node", "id").join(headings.select(F.col("id").alias("ancestor"), "title"), "ancestor")
    near = up.join(up.groupBy("id").agg(F.min("distance").alias("distance")), ["id", "distance"]).groupBy("id").agg(F.count("*").alias("n"), F.min("ancestor").alias("section"), F.min("title").alias("title"))
    return blocks.select("id").join(near.filter("n = 1").drop("n"), "id", "left")
