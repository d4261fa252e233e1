"""Fusion of several parsers' graphs of one document into one: blocks that show the same region become one block, edges
follow them, and disagreement stays visible.

Versions (fixed values): 1 asks for equal context; 2 lets cells differ in their parser's grid numbers; 3 admits blocks of
invalid geometry; 4 asks that cells' tables match too; 5 lets parsers' names and versions in the context differ.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.operators import firstfit, sizing

LEAST = 0.8
BOX = ("x0", "y0", "x1", "y1")
GRID, MIXED = ("row number=", "column number="), ("mixed_parser_name=", "mixed_parser_version=")
#: Quality, and issue kind and state.
ISSUES = {"conflict": ("parse_conflict", "open"), "invalid": ("source_geometry_invalid", "unreadable"), "unlocated": ("source_unlocated", "open")}
BLOCK = "doc long, page int, kind string, source_id string, members array<struct<run:string,native:string>>, families array<string>, quality string, winner int, text string, issue string, issue_state string"


def context_of(context: Column, kind: Column, version: int) -> Column:
    """The part of a block's context that must agree."""
    dropped = (() if version < 5 else MIXED, GRID if version >= 2 else ())
    keep = lambda c, prefixes: F.filter(c, lambda x: ~_starts(x, prefixes)) if prefixes else c
    every = keep(F.coalesce(context, F.array().cast("array<string>")), dropped[0])
    return F.when(kind == "table_cell", keep(every, dropped[1])).otherwise(every)


def _starts(x: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | x.startswith(p)
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of at least LEAST; boxes are rows of x0, y0, x1, y1."""
    both = np.maximum(0.0, np.minimum(a[:, 2], b[:, 2]) - np.maximum(a[:, 0], b[:, 0])) * np.maximum(0.0, np.minimum(a[:, 3], b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))
    return _alike(both, firstfit.area(a) + firstfit.area(b) - both)


def _alike(both: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(both, whole, out=np.zeros_like(both), where=whole > 0) >= LEAST


def fused_blocks(blocks: DataFrame, *, tenant: str, manifest: str, version: int = 3, mixed: bool = False) -> DataFrame:
    """One row for each fused block: doc, page, kind, source_id, members (in order), families, quality (conflicted,
    unlocated, unverified), winner (0, or null in a conflict), text (the winner's), issue and issue_state.

    blocks: doc, parser, run, family, native, page, kind, x0, y0, x1, y1, invalid (geometry off the page), text, context,
    table_native. In the order of parser, run, page and native id a block joins the first group all of whose members it
    matches: same page and kind, equal context as the version asks, and boxes that overlap. The order decides, so the
    blocks of one page and kind are folded together; a cell carries its table, so no other page is looked at."""
    if version not in (1, 2, 3, 4, 5) or (version == 5 and not mixed):
        raise ValueError("no such version of fusion" if version not in (1, 2, 3, 4, 5) else "version 5 needs mixed parsers")
    known = blocks
    if version < 3:
        known = known.withColumn("invalid", F.when(F.col("invalid"), F.raise_error(F.lit("this version of fusion admits no invalid geometry")).cast("boolean")).otherwise(F.lit(False)))
    located = ~F.coalesce(F.col("invalid"), F.lit(False)) & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    box = [F.when(located, F.col(c).cast("double")).alias(c) for c in BOX]
    context = F.to_json(context_of(F.col("context"), F.col("kind"), version)).alias("context")
    names = [F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), "kind", "parser", "run", "family", "native"]
    rows = known.select(*names, *box, located.alias("located"), F.coalesce("invalid", F.lit(False)).alias("invalid"), "text", context, "table_native")
    if version >= 4:
        of_table = ("page", "located", "context", *BOX)
        tables = rows.filter("kind = 'table'").select("doc", "run", F.col("native").alias("table_native"), *[F.col(c).alias(f"table_{c}") for c in of_table])
        rows = rows.join(sizing.unsent(tables), ["doc", "run", "table_native"], "left")

    def fold(table: pa.Table) -> pa.RecordBatch:
        column = lambda c: table.column(c).combine_chunks()
        flag = lambda c: column(c).fill_null(False).to_numpy(zero_copy_only=False)
        corners = lambda prefix: _corners([column(prefix + c) for c in BOX])
        seen, page, boxes = flag("located"), firstfit.page_numbers(table), corners("")
        tables = None
        if version >= 4:
            is_table = pc.equal(column("kind"), "table").fill_null(False).to_numpy(zero_copy_only=False)
            tables = (is_table, is_table | ~column("table_native").is_valid().to_numpy(zero_copy_only=False), flag("table_located"), firstfit.codes(column("table_page")), firstfit.codes(column("table_context")), corners("table_"))
        groups = _grouped(page, seen, firstfit.codes(column("context")), boxes, tables)
        flat = np.array([k for g in groups for k in g])
        starts = np.cumsum([0, *(len(g) for g in groups)])
        doc, number, kind = (column(c).take(flat[starts[:-1]]) for c in firstfit.PAGE)
        members = pa.StructArray.from_arrays([column("run").take(flat), column("native").take(flat)], ["run", "native"])
        run, native, family, text, invalid = column("run").to_pylist(), column("native").to_pylist(), column("family").to_pylist(), column("text").to_pylist(), flag("invalid")
        out = []
        for g in groups:
            keys = tuple((run[k], native[k]) for k in g)
            conflict = len(g) > 1 and len({unicodedata.normalize("NFC", x or "") for x in {text[k] for k in g}}) > 1
            state = "conflicted" if conflict else "unverified" if seen[g[0]] else "unlocated"
            issue = (None, None) if state == "unverified" else ISSUES["invalid" if any(invalid[k] for k in g) else "conflict" if conflict else "unlocated"]
            own = str(uuid.uuid5(space, f"{tenant}:{keys}"))
            out.append((own, sorted({family[k] for k in g}), state, None if conflict else 0, None if conflict else text[g[0]], *issue))
        own, families, quality, winner, said, issue, state = zip(*out, strict=True)
        texts = [pa.array(x, pa.string()) for x in (quality, said, issue, state)]
        columns = [doc, number, kind, pa.array(own), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), members), pa.array(families, pa.list_(pa.string())), texts[0], pa.array(winner, pa.int32()), *texts[1:]]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in BLOCK.replace("struct<run:string,native:string>", "s").split(", ")])

    space = uuid.UUID(manifest)
    return firstfit.by_pages(rows, [F.col(c).asc_nulls_last() for c in ("parser", "run", "native")], fold, BLOCK)


def _corners(columns: Sequence[pa.Array]) -> np.ndarray:
    return np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns]), nan=0.0, posinf=np.inf, neginf=-np.inf)


#: What is known of blocks' tables: whether a block is one, has none, and its table's placing, page, context and box.
Tables = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _tables_fit(tables: Tables | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if tables is None:
        return np.ones(len(a), bool)
    is_table, free, placed, at, axes, outer = tables
    return is_table[a] | (free[a] & free[b]) | (placed[a] & placed[b] & (at[a] == at[b]) & (axes[a] == axes[b]) & _overlap(outer[a], outer[b]))


def _grouped(page: np.ndarray, seen: np.ndarray, context: np.ndarray, boxes: np.ndarray, tables: Tables | None) -> list[list[int]]:
    """The groups (ascending positions) of blocks that stand page by page and in their order."""
    told = [page, seen, context, boxes, *(tables or ())]
    # blocks of which all this is equal are one class
    _, first, of = np.unique(np.column_stack(told).astype(float), axis=0, return_index=True, return_inverse=True)

    def fits(a: np.ndarray, b: np.ndarray, both: np.ndarray, whole: np.ndarray) -> np.ndarray:
        a, b = first[a], first[b]
        return _alike(both, whole) & seen[a] & seen[b] & (context[a] == context[b]) & _tables_fit(tables, a, b)

    near = firstfit.partners(len(first), firstfit.fitting(page[first], boxes[first], fits, LEAST))
    for k in np.flatnonzero(seen[first] & _overlap(boxes[first], boxes[first]) & _tables_fit(tables, first, first)).tolist():
        near[k].add(k)
    return firstfit.first_fit(of.ravel().tolist(), near)


#: Pages of at most so many blocks, of which no more than so many have one box, are grouped many at a time.
SMALL_PAGE, SAME_BOX = 512, 8
COUNTS = ("blocks", "met", "conflicted", "invalid", "unlocated")


def fused_counts(blocks: DataFrame, versions: Sequence[int]) -> DataFrame:
    """doc, page, kind, version, blocks, met (of several members), conflicted, invalid (by their issue) and unlocated: how
    many fused_blocks there are of each page in each version. Versions before 3 get blocks of valid geometry only.

    All versions are told from one pass over the blocks, which are joined to their tables and dealt by page once."""
    if not set(versions) <= {1, 2, 3, 4, 5}:
        raise ValueError("no such version of fusion")
    located = ~F.coalesce(F.col("invalid"), F.lit(False)) & F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    box = [F.when(located, F.col(c).cast("double")).alias(c) for c in BOX]
    context = F.to_json(F.coalesce("context", F.array().cast("array<string>"))).alias("context")
    names = [F.col("doc").cast("long").alias("doc"), F.col("page").cast("int").alias("page"), "kind", "parser", "run", "native"]
    rows = blocks.select(*names, *box, located.alias("located"), "invalid", "text", context, "table_native")
    if max(versions, default=0) >= 4:
        own = F.struct("page", "located", "context", *BOX)
        tables = rows.filter("kind = 'table'").groupBy("doc", "run", F.col("native").alias("table_native")).agg(F.collect_list(own).alias("tables"))
        rows = rows.join(sizing.unsent(tables), ["doc", "run", "table_native"], "left")

    def fold(table: pa.Table) -> pa.RecordBatch:
        return _counted(table, versions)

    schema = "doc long, page int, kind string, version int, " + ", ".join(f"{c} long" for c in COUNTS)
    return firstfit.by_pages(rows, [F.col(c).asc_nulls_last() for c in ("parser", "run", "native")], fold, schema)


def _contexts(values: pa.Array, cell: np.ndarray, version: int) -> np.ndarray:
    """context_of as numbers. values: JSON of the whole contexts; each different one is looked at once."""
    coded = values.dictionary_encode(null_encoding="encode")
    own, mixed = coded.indices.to_numpy(zero_copy_only=False), MIXED if version >= 5 else ()
    known: dict[tuple | None, int] = {}
    keep = lambda x, prefixes: [e for e in x if e is not None and not e.startswith(prefixes)] if prefixes else x
    numbers = np.zeros((2, len(coded.dictionary)), np.int64)
    for k, text in enumerate(coded.dictionary.to_pylist()):
        every = None if text is None else keep(json.loads(text), mixed)
        for of_cell in (0, 1):
            form = None if every is None else tuple(keep(every, GRID if of_cell and version >= 2 else ()))
            numbers[of_cell, k] = known.setdefault(form, len(known))
    return numbers[cell.astype(int), own]


def _counted(table: pa.Table, versions: Sequence[int]) -> pa.RecordBatch:
    column = lambda c: table.column(c).combine_chunks()
    flag = lambda x: x.fill_null(False).to_numpy(zero_copy_only=False)
    is_kind = lambda name: flag(pc.equal(column("kind"), name))
    page, seen, boxes, invalid = firstfit.page_numbers(table), flag(column("located")), _corners([column(c) for c in BOX]), flag(column("invalid"))
    coded = column("text").fill_null("").dictionary_encode()
    normal: dict[str, int] = {}
    text = np.array([normal.setdefault(unicodedata.normalize("NFC", x), len(normal)) for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    cell, first = is_kind("table_cell"), np.flatnonzero(np.diff(page, prepend=-1))
    valid = ~invalid & column("invalid").is_valid().to_numpy(zero_copy_only=False)
    row = np.arange(table.num_rows)  # a row for each table of its block, where there are more
    if max(versions) >= 4:
        lists, is_table = column("tables"), is_kind("table")
        many = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(row, np.maximum(many, 1))
        of = np.full(len(row), -1)
        of[many[row] > 0] = np.arange(many.sum())
        inner, none = lists.flatten(), of < 0
        of = pa.array(of, mask=none)
        part = lambda c: inner.field(c).take(of)
        is_table = is_table[row]
        own = (is_table, is_table | ~column("table_native").is_valid().to_numpy(zero_copy_only=False)[row], flag(part("located")), firstfit.codes(part("page")))
        outer = _corners([part(c) for c in BOX])
    sides = {}  # blocks once, and once for each of their tables: what stands on a page alike in all versions, and its pairs
    out = []
    for version in versions:
        at = row if version >= 4 and len(row) > table.num_rows else np.arange(table.num_rows)
        if len(at) not in sides:
            sides[len(at)] = _pairs(page[at], seen[at], boxes[at])
        small, a, b = sides[len(at)]
        context = _contexts(column("context"), cell, version)[at]
        tables = (*own, _contexts(part("context"), np.zeros(len(row), bool), version), outer) if version >= 4 else None
        there = np.ones(len(at), bool) if version >= 3 else valid[at]
        fine = (context[a] == context[b]) & there[a] & there[b] & _tables_fit(tables, a, b)
        group = firstfit.small_first_fit(page[at], a[fine], b[fine])
        rest = np.flatnonzero(~small & there)
        if len(rest):
            for g in _grouped(page[at][rest], seen[at][rest], context[rest], boxes[at][rest], tables and tuple(x[rest] for x in tables)):
                group[rest[g]] = rest[g[0]]
        least, most, size, off = text[at].copy(), text[at].copy(), np.bincount(group, minlength=len(at)), np.zeros(len(at), bool)
        np.minimum.at(least, group, text[at])
        np.maximum.at(most, group, text[at])
        np.logical_or.at(off, group, invalid[at])
        head = np.flatnonzero((group == np.arange(len(at))) & there)
        conflict = least[head] != most[head]
        unlocated = ~conflict & ~seen[at][head]
        told = [np.ones(len(head)), size[head] > 1, conflict, off[head] & (conflict | unlocated), unlocated]
        number = page[at][head] - page[0]
        counts = [np.bincount(number, weights=x.astype(float), minlength=len(first)).astype(np.int64) for x in told]
        some = np.flatnonzero(counts[0])
        out.append([*(column(c).take(pa.array(first[some])) for c in firstfit.PAGE), pa.array(np.full(len(some), version, np.int32)), *(pa.array(c[some]) for c in counts)])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], [*firstfit.PAGE, "version", *COUNTS])


def _pairs(page: np.ndarray, seen: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which blocks stand on small pages, and the pairs (a before b) of those whose boxes overlap."""
    order = np.lexsort((*boxes.T, page))
    new = np.concatenate(([True], (np.diff(page[order]) > 0) | (np.diff(boxes[order], axis=0) != 0).any(axis=1)))
    alike = np.diff(np.flatnonzero(np.append(new, True)))
    own = page - page[0]
    crowded = np.zeros(own[-1] + 1, bool)
    # blocks without a box meet nothing, however many they are
    crowded[own[order[new]][(alike > SAME_BOX) & seen[order[new]]]] = True
    small = ~(crowded | (np.bincount(own) > SMALL_PAGE))[own]
    some = np.flatnonzero(small & seen)
    fits = lambda a, b, both, whole: _alike(both, whole)
    found = list(firstfit.fitting(page[some], boxes[some], fits, LEAST))
    a, b = (some[np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)])] for k in (0, 1))
    return small, np.minimum(a, b), np.maximum(a, b)


def aliases(fused: DataFrame) -> DataFrame:
    """doc, run, native, source_id: what each parser's block became."""
    return fused.select("doc", "source_id", F.explode("members").alias("m")).select("doc", "m.run", "m.native", "source_id")


def fused_edges(fused: DataFrame, edges: DataFrame) -> DataFrame:
    """doc, source_id, target_id, relation, each once. edges: doc, run, source_native, target_native, relation; an edge to a
    block that no parser gave is an error."""
    names = aliases(fused)
    out = edges
    for side in ("source", "target"):
        own = names.select("doc", "run", F.col("native").alias(f"{side}_native"), F.col("source_id").alias(f"_{side}"))
        out = out.join(sizing.unsent(own), ["doc", "run", f"{side}_native"], "left")
    known = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit("dangling native edge")).cast("string")).otherwise(F.col(c))
    return out.select("doc", known("_source").alias("source_id"), known("_target").alias("target_id"), "relation").distinct()
