"""Boxes and affine maps as arithmetic on columns; matching and fusing of blocks from several parsers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.operators import firstfit

Box = tuple[Column, Column, Column, Column]


def box_of(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; null geometry gives null, never zero."""
    both = area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))
    known = F.lit(True)
    for c in (*a, *b):
        known = known & c.isNotNull()
    return F.when(known, F.try_divide(both, area(a) + area(b) - both))


def covers(outer: Box, inner: Box) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (inner[2] <= outer[2]) & (inner[3] <= outer[3])


def apply_affine(m: Sequence[Column | float], b: Box) -> Box:
    """The box around the four mapped corners, for (x, y) -> (a x + c y + e, b x + d y + f)."""
    a, b_, c, d, e, f = (x if isinstance(x, Column) else F.lit(float(x)) for x in m)
    xs = [a * x + c * y + e for x in (b[0], b[2]) for y in (b[1], b[3])]
    ys = [b_ * x + d * y + f for x in (b[0], b[2]) for y in (b[1], b[3])]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def invert_affine(m: Sequence[float]) -> tuple[float, ...]:
    a, b, c, d, e, f = m
    det = a * d - b * c
    if det == 0:
        raise ValueError("the map cannot be inverted")
    return d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det


def matching_pairs(blocks: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of blocks of different parsers on one page and of one kind with IoU of at least `least` (over 0.5).

    Such boxes differ in width and height by less than a factor of 1 / least, so they stand in the same or in
    neighbouring size classes of that base. Their intersection is at least least / (1 + least) of the sum of both widths
    (and heights), so their centres lie at most (1 - least) / (1 + least) of the larger width apart. The grid is that of
    the right box's class, its cells twice as wide as the reach of any partner: a right box is posted in the (at most four)
    cells that its reach touches, a left box in its own cell of the grids of its nine classes. A pair meets in one cell: an
    equi-join, with no pair lost and no dense cell of small boxes for the large ones."""
    if not 0.5 < least <= 1:
        raise ValueError("least must be over 0.5 and at most 1")
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    base = max(1 / least, 1.01) + 1e-9
    # the first parser of all is never a right box and the last never a left one: such rows are not posted
    ends = blocks.agg(F.min("parser").alias("_first"), F.max("parser").alias("_last"))
    size = blocks.filter((width > 0) & (height > 0)).crossJoin(F.broadcast(ends)).withColumn("cw", F.floor(F.log(width) / math.log(base)).cast("int")).withColumn("ch", F.floor(F.log(height) / math.log(base)).cast("int"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    reach = lambda c: F.pow(F.lit(base), F.col(c) + 2) * ((1 - least) / (1 + least)) * (1 + 1e-9) + 1e-9
    cell = lambda at, c: F.floor(at / (2 * reach(c))).cast("long")
    kept = ("id", "parser", "x0", "y0", "x1", "y1")
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    touched = lambda at, c: F.explode(F.array_distinct(F.array(cell(at - reach(c), c), cell(at + reach(c), c))))
    own = lambda side: ["doc", "page", "kind", "gw", "gh", "gx", "gy", *[F.col(c).alias(f"{side}{c}") for c in kept]]
    left = size.filter(F.col("parser") < F.col("_last")).withColumn("gw", near("cw")).withColumn("gh", near("ch")).withColumn("gx", cell(x, "gw")).withColumn("gy", cell(y, "gh")).select(*own("l_"))
    right = size.filter(F.col("parser") > F.col("_first")).withColumn("gw", F.col("cw")).withColumn("gh", F.col("ch")).withColumn("gx", touched(x, "cw")).withColumn("gy", touched(y, "ch")).select(*own("r_"))
    # what is posted is several times the table, which Spark's estimate does not know: no side is sent to all
    both = left.join(right.hint("merge"), ["doc", "page", "kind", "gw", "gh", "gx", "gy"]).filter("l_parser < r_parser")
    return both.withColumn("iou", iou(box_of("l_"), box_of("r_"))).filter(F.col("iou") >= least).select("doc", "page", "kind", "l_id", "r_id", F.round("iou", 6).alias("iou"))


def fuse(blocks: DataFrame, least: float = 0.8) -> DataFrame:
    """Greedy groups per page and kind: a block joins the first group all of whose members it overlaps by `least`. The
    order (parser, id) matters, so the fold runs over the blocks of one page. Groups with differing texts have no winner."""
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")

    def fold(table: pa.Table) -> pa.RecordBatch:
        page, parser, text = firstfit.page_numbers(table), firstfit.codes(table.column("parser")), firstfit.codes(table.column("text"))
        boxes = np.column_stack([table.column(c).to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1")])
        # blocks of one page, parser and box are one class, that does not fit itself
        values, first, of = np.unique(np.column_stack((page, parser, boxes)), axis=0, return_index=True, return_inverse=True)
        own = parser[first]
        near = firstfit.partners(len(values), firstfit.fitting(page[first], boxes[first], lambda a, b, both, whole: (both >= least * whole) & (own[a] != own[b]), least))
        groups = firstfit.first_fit(of.ravel().tolist(), near)
        at = np.array([g[0] for g in groups])
        agree = np.array([len(g) == 1 or (text[g] == text[g[0]]).all() for g in groups])
        head = table.select(["doc", "page", "kind", "id"]).take(at).combine_chunks()
        doc, number, kind, one = (head.column(c).combine_chunks() for c in head.column_names)
        columns = [doc, number, kind, one, pa.array([len(g) for g in groups], pa.int32()), pc.if_else(pa.array(agree), one, None), pa.array([None if x else "text_conflict" for x in agree], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc", "page", "kind", "first_id", "members", "winner", "issue"])

    rows = blocks.select(F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), "kind", F.col("id").cast("long").alias("id"), "parser", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], "text")
    order = [F.col(c).asc_nulls_last() for c in ("parser", "id")]
    return firstfit.by_pages(rows, order, fold, "doc long, page int, kind string, first_id long, members int, winner long, issue string")
