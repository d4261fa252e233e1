"""Choosing whole bundles of pages under a cap."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SELECTION = "selected_pages array<int>, evidence_only_pages array<int>, selected_bundles array<string>, missing_pages array<int>, status string"


def pages_of(bits: int) -> list[int]:
    return [k for k in range(bits.bit_length()) if bits >> k & 1]


def bits_of(pages: list[int]) -> int:
    out = 0
    for p in pages:
        out |= 1 << p
    return out


def joined_groups(bundles: list[tuple[str, int]]) -> list[tuple[int, list[str]]]:
    """(page set, bundle ids) of bundles that share pages, directly or over others, by their first bundle; ids in the order
    in which they are reached from it. Page sets are bitmaps."""
    left, groups = list(bundles), []
    while left:
        names, pages = [left[0][0]], left[0][1]
        left = left[1:]
        while met := [x for x in left if x[1] & pages]:
            left = [x for x in left if not x[1] & pages]
            names += [x[0] for x in met]
            for x in met:
                pages |= x[1]
        groups.append((pages, names))
    return groups


def select_bundles(bundles: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """One row per claims row. bundles: key, place (their order), bundle, pages, complete; claims: key, claim, pages, cap.

    In the order of their first bundle, groups of bundles that share pages are taken whole, as long as the pages of the
    claim and of all that was taken are at most `cap`; a later group can still fit when an earlier one did not. missing_pages
    are those of groups left out; status is evidence_bundle_incomplete if one was, or if any bundle is not complete, else
    candidate_only. A claim without pages, with pages of no number, or with more than its cap gets selection_invalid.
    A claim's document has few bundles; each claim is folded by itself."""
    name = F.col("bundle").cast("string")
    own = bundles.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", name.alias("bundle"), F.array_sort(F.array_distinct("pages")).alias("pages"), "complete"))).alias("_bundles"))
    rows = claims.join(own, key, "left")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = [c for c in claims.columns if c not in ("pages", "cap")]
    return rows.mapInArrow(_fold(kept), ", ".join([f"{c} {kind[c]}" for c in kept] + [SELECTION]))


def _fold(kept: list[str]) -> Callable:
    names = [x.split()[0] for x in SELECTION.split(", ")]

    def chosen(pages: list[int] | None, cap: int | None, bundles: list[dict] | None) -> tuple:
        if not pages or cap is None or any(p is None or p < 1 for p in pages) or len(set(pages)) != len(pages) or len(pages) > cap:
            return None, None, None, None, "selection_invalid"
        claimed = bits_of(pages)
        taken, missing, ids, short = claimed, 0, [], any(not b["complete"] for b in bundles or [])
        for bits, own in joined_groups([(b["bundle"], bits_of([p for p in b["pages"] if p is not None and p > 0])) for b in bundles or []]):
            if (taken | bits).bit_count() <= cap:
                taken |= bits
                ids += own
            else:
                missing |= bits & ~taken
                short = True
        return pages_of(taken), pages_of(taken & ~claimed), ids, pages_of(missing), "evidence_bundle_incomplete" if short else "candidate_only"

    types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string()]

    def run(batches):
        for batch in batches:
            out = [chosen(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("pages", "cap", "_bundles")), strict=True)]
            made = [pa.array([x[k] for x in out], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, *names])

    return run
