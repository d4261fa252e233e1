"""Greedy groups of boxes on pages: a box joins the first group all of whose members it fits.

A page is folded in its order, but only over boxes that can fit each other: these come from a sweep over the tops of many
pages at once, in numpy. The fold itself then costs a step for each pair that fits, not for each pair of box and group."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

PAGE = ("doc", "page", "kind")
#: Pairs looked at in one step of numpy.
PAIRS = 1 << 20


def codes(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers, null as one of them."""
    coded = values.dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def page_numbers(table: pa.Table) -> np.ndarray:
    """The number of each row's page (rows of one page stand together)."""
    new = np.zeros(table.num_rows, bool)
    for c in PAGE:
        k = codes(table.column(c))
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def by_pages(blocks: DataFrame, order: Sequence[Column], fold: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """fold over tables of whole pages with their rows in the given order. A task holds a batch and what it has of the page
    that the batch breaks off, whatever its number of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last rows that are held tell whether a page has ended in this batch at all
            at = page_numbers(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch] if held else [batch]))[-batch.num_rows :]
            cut = int(np.searchsorted(at, at[-1])) if at[-1] else 0
            if at[-1]:
                yield fold(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield fold(pa.Table.from_batches(held))

    return blocks.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(run, schema)


def fitting(page: np.ndarray, boxes: np.ndarray, fits: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b), each once, of boxes of one page for which `fits` (a, b, both areas, whole areas) is true; never of a box
    with itself. Boxes (x0, y0, x1, y1) without an area meet nothing.

    With IoU of at least `least` the intersection is as high as `least` of either box, so the lower top lies at most
    1 - least of the height of the box with the higher top below it."""
    height = boxes[:, 3] - boxes[:, 1]
    sound = np.flatnonzero((boxes[:, 2] - boxes[:, 0] > 0) & (height > 0) & np.isfinite(boxes).all(axis=1))
    sound = sound[np.lexsort((boxes[sound, 1], page[sound]))]
    n, top, own = len(sound), boxes[sound, 1], page[sound]
    reach = top + height[sound] * ((1 - least) * (1 + 1e-9) + 1e-9)
    # tops and reaches in one order: the tops up to a reach, of its page
    order = np.lexsort((np.repeat((0, 1), n), np.concatenate((top, reach)), np.concatenate((own, own))))
    until = np.empty(n, np.int64)
    until[order[order >= n] - n] = np.cumsum(order < n)[order >= n]
    count = until - np.arange(n) - 1
    ends = np.cumsum(count)
    begin = 0
    while begin < n:
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        c = count[begin:end]
        i = np.repeat(np.arange(begin, end), c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        a, b = sound[i], sound[j]
        both = np.maximum(0.0, np.minimum(boxes[a, 2], boxes[b, 2]) - np.maximum(boxes[a, 0], boxes[b, 0]))
        near = both > 0
        a, b, both = a[near], b[near], both[near]
        both = both * np.maximum(0.0, np.minimum(boxes[a, 3], boxes[b, 3]) - np.maximum(boxes[a, 1], boxes[b, 1]))
        whole = area(boxes[a]) + area(boxes[b]) - both
        good = (whole > 0) & fits(a, b, both, whole)
        yield a[good], b[good]
        begin = end


def area(boxes: np.ndarray) -> np.ndarray:
    return (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])


def partners(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[set[int]]:
    """The partners of each of n."""
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            near[x].add(y)
            near[y].add(x)
    return near


def first_fit(classes: Sequence[int], near: Sequence[set[int]]) -> list[list[int]]:
    """The groups (positions, ascending) of items that are given by their class, the oldest group first. near: the classes
    that a class fits, maybe itself. Only a group whose first member fits can be joined. Groups only grow, so one that a
    class did not fit is not asked for it again."""
    groups: list[list[int]] = []
    held: list[set[int]] = []
    begun: dict[int, list[int]] = {}
    asked: dict[int, dict[int, int]] = {}
    own: dict[int, int] = {}
    for at, c in enumerate(classes):
        mates = near[c]
        found = None
        if c in mates and c in own:
            found = own[c]
        elif mates:
            found = _first(c, mates, held, begun, asked)
        if found is None:
            found = len(groups)
            groups.append([])
            held.append(set())
            begun.setdefault(c, []).append(found)
        groups[found].append(at)
        held[found].add(c)
        own[c] = found
    return groups


def small_first_fit(page: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first member of each item's group, for items that stand page by page and in their order; (a, b), a before b, are
    all pairs that fit. The items of all pages that have one place in the order are put at once, so this is for many
    small pages: a step is one of numpy for each place."""
    n = len(page)
    group, size = np.arange(n), np.ones(n, np.int64)
    if not len(a):
        return group
    place = np.arange(n) - np.maximum.accumulate(np.where(np.diff(page, prepend=page[0] - 1) > 0, np.arange(n), 0))
    order = np.lexsort((b, place[b]))
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.diff(place[b], prepend=-1, append=n)).tolist()
    for begin, end in zip(cuts, cuts[1:], strict=False):
        # an item fits a group if it fits as many of its members as there are; the oldest group is the one that begins first
        met, times = np.unique(b[begin:end] * n + group[a[begin:end]], return_counts=True)
        item, found = np.divmod(met, n)
        whole = times == size[found]
        item, found = item[whole], found[whole]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        item, found = item[first], found[first]
        group[item] = found
        size[found] += 1
    return group


def _first(c: int, mates: set[int], held: list[set[int]], begun: dict[int, list[int]], asked: dict[int, dict[int, int]]) -> int | None:
    past = asked.setdefault(c, {})
    heads = [(begun[d][past.get(d, 0)], d) for d in mates if d in begun and past.get(d, 0) < len(begun[d])]
    heapq.heapify(heads)
    while heads:
        g, d = heads[0]
        if held[g] <= mates:
            return g
        k = past[d] = past.get(d, 0) + 1
        if k < len(begun[d]):
            heapq.heapreplace(heads, (begun[d][k], d))
        else:
            heapq.heappop(heads)
    return None
