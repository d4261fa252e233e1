"""Suffix-array dedup: bytes covered by a WINDOW-byte string that starts more than once anywhere, found by
difference-cover blockwise suffix sorting.

Suffix buckets. The suffixes to sort are the window starts. Consecutive windows are bucketed by their minimizer, the
KMER-byte string of least hash inside the window (the leftmost of equals), with the SIDE bytes before it where the window
holds them, else the SIDE bytes after it, which it then holds: equal windows have equal minimizers at equal places, and so
equal contexts. A run of windows with one minimizer occurrence and one side is a segment. A context that occurs once in
the corpus belongs to windows that occur once, so its bucket needs no sorting; equal segments (by two 64-bit hashes, of
context and segment) are all repeats. Tasks reduce equal segments to one before they are shuffled, so a passage in very
many documents costs its bucket one record a task. Only the distinct segments of a repeated context are sorted, each
suffix bucket in one task, whose size does not grow with the corpus. A bucket with many distinct segments is split by
stretches of PLACES places of the minimizer in the window, and by all the bytes that every window of a stretch shares.

Sorting. Positions whose index modulo PERIOD is in the difference cover are the sample; its ranks come from PERIOD-byte
names and three doublings. Windows are named by their first PERIOD bytes, and longer ties are resolved by the ranks of
the cover samples at the shift that the two positions' residues share. Neighbours in that order are then compared byte
by byte.

Texts are keyed by a 64-bit hash of the whole text; equal texts are worked on once or twice a task and share their
result. Defined results: a null text is empty; matches never cross texts; texts under WINDOW bytes lose nothing;
repeated rows are repeats of each other; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, KMER = 200, 48
SIDE = (WINDOW - KMER) // 2
#: A perfect difference set, every difference modulo PERIOD occurs.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
CHUNK = 2 << 20
_PLACE_BITS = np.uint64(24)
#: Contexts with more distinct segments than this are split by the minimizer's place.
WIDE, PLACES = 4096, 16
#: Segments that a task reduces at once, before they are shuffled.
REDUCED = 400_000


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i with a full window."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, offset, windows, minimizer place in the first window, context hash, segment hash) of all segments of
    the documents, at most 16 MB in all."""
    size = np.diff(ends)
    empty = np.zeros(0, np.int64)
    if len(raw) < WINDOW or not (size >= WINDOW).any():
        return (empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    sums = common.prefix_hash(raw)
    at = np.arange(len(raw) - KMER + 1)
    kmer = common.span_hash(sums, at, at + KMER)
    least = sliding_min(kmer >> _PLACE_BITS << _PLACE_BITS | at.astype(np.uint64), WINDOW - KMER + 1)
    doc = np.flatnonzero(size >= WINDOW)
    count = size[doc] - WINDOW + 1
    starts = np.repeat(ends[doc] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    own = least[starts]
    first = np.ones(len(starts), bool)
    first[1:] = own[1:] != own[:-1]
    first[np.cumsum(count) - count] = True
    head = np.flatnonzero(first)
    n = np.diff(np.append(head, len(starts)))
    a, owner = starts[head], np.repeat(doc, count)[head]
    at = (own[head] & np.uint64((1 << 24) - 1)).astype(np.int64)
    left = np.clip(at - a - SIDE + 1, 0, n)  # windows that hold SIDE bytes before the minimizer: the first ones
    one, two = np.flatnonzero(left), np.flatnonzero(left < n)
    context = np.concatenate([common.span_hash(sums, at[one] - SIDE, at[one] + KMER), ~common.span_hash(sums, at[two], at[two] + KMER + SIDE)])
    owner, at = np.concatenate([owner[one], owner[two]]), np.concatenate([at[one], at[two]])
    a, n = np.concatenate([a[one], a[two] + left[two]]), np.concatenate([left[one], (n - left)[two]])
    return owner, a - ends[owner], n, at - a, context, common.span_hash(sums, a, a + n + WINDOW - 1)


def chunks_of(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, document of each piece, offset of each piece): texts over CHUNK bytes in pieces that overlap by a window."""
    if len(raw) <= CHUNK:
        yield raw, ends, np.arange(len(ends) - 1), np.zeros(len(ends) - 1, np.int64)
        return
    for d, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        for c in range(a, max(a + 1, b - WINDOW + 1), CHUNK):
            piece = raw[c : min(b, c + CHUNK + WINDOW - 1)]
            yield piece, np.array([0, len(piece)]), np.array([d]), np.array([c - a])


_SEGMENT = np.dtype([("h", "<u8"), ("g", "<u8"), ("key", "<i8"), ("off", "<u4"), ("n", "u1"), ("place", "u1")])
_RUN = np.dtype([("key", "<i8"), ("a", "<u4"), ("b", "<u4")])
_REQUEST = np.dtype([("key", "<i8"), ("h", "<u8"), ("off", "<u4"), ("n", "u1"), ("place", "u1"), ("wide", "u1")])


def runs_of(rec: np.ndarray) -> np.ndarray:
    out = np.empty(len(rec), _RUN)
    out["key"], out["a"] = rec["key"], rec["off"]
    out["b"] = out["a"] + rec["n"]
    return out


def by_segment(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(records by context and segment, the first of each context, the first of each segment)."""
    rec = rec[np.lexsort((rec["g"], rec["h"]))]
    new_h, new_g = np.ones(len(rec), bool), np.ones(len(rec), bool)
    new_h[1:] = rec["h"][1:] != rec["h"][:-1]
    new_g[1:] = new_h[1:] | (rec["g"][1:] != rec["g"][:-1])
    return rec, new_h, new_g


def _scan(n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One record of each distinct segment, by bucket; runs of windows that repeat within the task, anywhere."""

    def reduced(records: list[np.ndarray]) -> pa.RecordBatch:
        rec, _, new = by_segment(np.concatenate(records))
        again = ~new
        again[:-1] |= ~new[1:]
        runs, rec = np.unique(runs_of(rec[again])), rec[new]
        bucket, blob = common.dealt(rec, (common.mix(rec["h"] ^ np.uint64(91)) % np.uint64(n_buckets)).astype(np.int64))
        bucket2, blob2 = common.dealt(runs, (common.mix(runs["key"].astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64))
        none = lambda n: [None] * n
        return pa.RecordBatch.from_arrays([pa.array(bucket + bucket2, pa.int32()), pa.array(blob + none(len(blob2)), pa.binary()), pa.array(none(len(blob)) + blob2, pa.binary())], ["bucket", "blob", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, int] = {}
        records: list[np.ndarray] = []
        for batch in common.slices(batches, "text"):
            keys = batch.column("key").to_pylist()
            fresh = []
            for k, key in enumerate(keys):  # two of equal texts tell all
                met[key] = met.get(key, 0) + 1
                if met[key] <= 2:
                    fresh.append(k)
            if len(met) > 2_000_000:
                met.clear()
            raw, ends = common.text_bytes(batch.column("text").take(pa.array(fresh, pa.int64())))
            own = np.array(keys, np.int64)[fresh]
            for piece, piece_ends, docs, base in chunks_of(raw, ends):
                doc, off, n, place, h, g = segments(piece, piece_ends)
                record = np.empty(len(doc), _SEGMENT)
                for name, value in (("h", h), ("g", g), ("key", own[docs[doc]]), ("off", off + base[doc]), ("n", n), ("place", place)):
                    record[name] = value
                records.append(record)
                if sum(map(len, records)) > REDUCED:
                    yield reduced(records)
                    records = []
        if records:
            yield reduced(records)
        common.trim()

    return run


def _repeated(n_groups: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket of contexts: runs of windows already known as repeats (kind 0), and segments to be sorted (kind 1)."""

    def run(group: pa.Table) -> pa.Table:
        rec = common.gathered(group.column("blob"), _SEGMENT)
        known = common.gathered(group.column("runs"), _RUN)
        rec = rec[np.argsort(rec["h"], kind="stable")]
        again = np.zeros(len(rec), bool)
        again[1:] = rec["h"][1:] == rec["h"][:-1]
        again[:-1] |= again[1:]
        rec, new_h, new_g = by_segment(rec[again])
        twice = ~new_g
        twice[:-1] |= ~new_g[1:]
        distinct = np.bincount((np.cumsum(new_h) - 1)[new_g])[np.cumsum(new_h) - 1] if len(rec) else twice.astype(int)
        runs = np.unique(np.concatenate([known, runs_of(rec[twice])]))
        asked = new_g & (distinct > 1)
        wanted = np.empty(int(asked.sum()), _REQUEST)
        for name in ("key", "h", "off", "n", "place"):
            wanted[name] = rec[name][asked]
        wanted["wide"] = distinct[asked] > most
        common.trim()
        return by_text([runs, wanted], n_groups)

    return run


def by_text(parts: list[np.ndarray], n_groups: int) -> pa.Table:
    kinds, groups, blobs = [], [], []
    for kind, records in enumerate(parts):
        group, blob = common.dealt(records, (common.mix(records["key"].astype(np.uint64)) % np.uint64(n_groups)).astype(np.int64))
        kinds += [kind] * len(group)
        groups += group
        blobs += blob
    return pa.table({"kind": pa.array(kinds, pa.int32()), "group": pa.array(groups, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _per_text(kind: np.dtype) -> Callable[[pa.Table], pa.Table]:
    """The records of each text as one binary value."""

    def run(group: pa.Table) -> pa.Table:
        rec = common.gathered(group.column("blob"), kind)
        keys, blobs = common.dealt(rec, rec["key"].copy())
        return pa.table({"key": pa.array(keys, pa.int64()), "records": pa.array(blobs, pa.binary())})

    return run


def _covered(group: pa.Table) -> pa.Table:
    """Runs of repeated windows -> for each text, its maximal removed byte spans as (start, end) pairs."""
    rec = np.sort(common.gathered(group.column("blob"), _RUN), order=("key", "a"))
    stop = rec["b"].astype(np.int64) + WINDOW - 1
    first = np.ones(len(rec), bool)
    first[1:] = rec["key"][1:] != rec["key"][:-1]
    nth = np.cumsum(first) - 1
    lift = nth << 33  # offsets of later texts lie above all of earlier ones
    reach = np.maximum.accumulate(stop + lift)
    start = rec["a"].astype(np.int64) + lift
    head = np.ones(len(rec), bool)
    head[1:] = start[1:] > reach[:-1]
    index = np.flatnonzero(head)
    spans = np.stack([start[index], np.append(reach[index[1:] - 1], reach[-1:])], 1) - lift[index][:, None]
    begin = np.flatnonzero(first[index])
    ends = np.append(begin[1:], len(index))
    return pa.table({"key": pa.array(rec["key"][index][begin]), "spans": pa.array([spans[a:b].astype("<i4").tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary())})


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: set[int] = set()
    for batch in batches:
        keys = batch.column("key").to_pylist()
        fresh = []
        for k, key in enumerate(keys):
            if key not in met:
                met.add(key)
                fresh.append(k)
        if len(met) > 2_000_000:
            met.clear()
        yield batch.take(pa.array(fresh, pa.int64()))


def _extract(n_sorts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the asked segments, dealt to the suffix buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raw, ends = common.text_bytes(batch.column("text"))
            size = [len(x) // _REQUEST.itemsize for x in batch.column("records").to_pylist()]
            rec = np.frombuffer(b"".join(batch.column("records").to_pylist()), _REQUEST)
            at = np.repeat(ends[:-1], size) + rec["off"]
            n, place, h, off = rec["n"].astype(np.int64), rec["place"].astype(np.int64), rec["h"], rec["off"].astype(np.int64)
            key = rec["key"]
            # a wide bucket's segments are cut where the minimizer's place in the window enters another stretch
            stretch = np.where(rec["wide"] > 0, PLACES, 1 << 20)
            low = np.where(rec["wide"] > 0, (place - n + 1) // stretch, 0)
            pieces = np.where(rec["wide"] > 0, place // stretch - low + 1, 1)
            row = np.repeat(np.arange(len(rec)), pieces)
            q = np.where(rec["wide"][row] > 0, (place // stretch)[row] - (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)), 0)
            # windows w of the piece have place - w in [q * stretch, (q + 1) * stretch)
            from_ = np.where(rec["wide"][row] > 0, np.maximum(0, place[row] - (q + 1) * stretch[row] + 1), 0)
            upto = np.where(rec["wide"][row] > 0, np.minimum(n[row], place[row] - q * stretch[row] + 1), n[row])
            key_of = common.mix(h[row] + common.mix((q + 1 + (rec["wide"][row].astype(np.int64) << 32)).astype(np.uint64)))
            if (wide := np.flatnonzero(rec["wide"][row])).size:  # every window of a stretch holds the bytes from begin to end
                sums = common.prefix_hash(raw)
                begin = (at + place)[row][wide] - q[wide] * PLACES
                key_of[wide] += common.span_hash(sums, begin, begin + WINDOW - PLACES + 1)
            bucket = (common.mix(key_of) % np.uint64(n_sorts)).astype(np.int64)
            begin, windows = at[row] + from_, upto - from_
            order = np.argsort(bucket, kind="stable")
            begin, windows, bucket, row, from_ = begin[order], windows[order], bucket[order], row[order], from_[order]
            length = windows + WINDOW - 1
            text = raw[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
            ends_t = np.concatenate([[0], np.cumsum(length)])
            head = np.empty(len(row), _RUN)
            head["key"], head["a"] = key[row], off[row] + from_
            head["b"] = head["a"] + windows
            each, first = np.unique(bucket, return_index=True)
            stop = np.append(first[1:], len(bucket))[: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array([head[a:b].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary()), pa.array([text[ends_t[a] : ends_t[b]].tobytes() for a, b in zip(first, stop, strict=True)], pa.binary())], ["bucket", "heads", "texts"])

    return run


def shared_shift() -> np.ndarray:
    """The least shift by which two residues both meet the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    return np.array([[int(np.flatnonzero(inside[a : a + PERIOD] & inside[b : b + PERIOD])[0]) for b in range(PERIOD)] for a in range(PERIOD)])


def cover_ranks(words: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the sample positions among all of them, by at least WINDOW bytes; others hold 0. words[p]: bytes p..p+7."""
    sample = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    rank = np.zeros(n + 16 * PERIOD, np.int64)
    rank[sample] = named(words, sample)
    width = PERIOD
    while width < WINDOW:
        both = rank[sample] << 32 | rank[sample + width]
        rank[sample] = np.unique(both, return_inverse=True)[1] + 1
        width *= 2
    return rank


def named(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """1-based ranks of the PERIOD-byte strings at the given positions, equal for equal strings."""
    parts = [words[at], words[at + 8], words[at + 16], words[at + 24] >> np.uint64(8)]
    order = np.lexsort(parts[::-1])
    new = np.zeros(len(at), bool)
    for p in parts:
        new[1:] |= p[order][1:] != p[order][:-1]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def repeated_windows(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the WINDOW-byte strings at `starts` occur at several of them."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(2 * WINDOW + 8 * PERIOD, np.uint8)])
    words = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k : len(padded) - 7 + k]
    name = named(words, starts)
    tied = np.bincount(name)[name] > 1
    out = np.zeros(len(starts), bool)
    at, name = starts[tied], name[tied]
    if not len(at):
        return out
    rank = cover_ranks(words, n + WINDOW)
    shift = shared_shift()
    residue = at % PERIOD
    members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
    place = np.zeros(len(at), np.int64)
    for a in range(PERIOD):
        if not len(members[a]):
            continue
        own = members[a]
        own = own[np.argsort(name[own] << 32 | rank[at[own] + shift[a, a]], kind="stable")]
        for b in range(PERIOD):
            if len(members[b]):
                keys = name[own] << 32 | rank[at[own] + shift[a, b]]
                place[members[b]] += np.searchsorted(keys, name[members[b]] << 32 | rank[at[members[b]] + shift[a, b]], side="left")
    order = np.argsort(place, kind="stable")
    x, y = at[order[:-1]], at[order[1:]]
    same = np.arange(len(x))
    for t in range(0, WINDOW, 8):
        same = same[words[x[same] + t] == words[y[same] + t]]
    hit = np.zeros(len(at), bool)
    hit[order[same]] = hit[order[same + 1]] = True
    out[tied] = hit
    return out


def _sort_bucket(n_groups: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        head = common.gathered(group.column("heads"), _RUN)
        text = common.gathered(group.column("texts"), np.dtype(np.uint8))
        windows = (head["b"] - head["a"]).astype(np.int64)
        begin = np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1)
        row = np.repeat(np.arange(len(head)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = repeated_windows(text, begin[row] + nth)
        common.trim()
        edge = np.ones(len(row), bool)
        edge[1:] = (row[1:] != row[:-1]) | ~hit[:-1]
        first = np.flatnonzero(hit & edge)
        last = np.ones(len(row), bool)
        last[:-1] = (row[1:] != row[:-1]) | ~hit[1:]
        last = np.flatnonzero(hit & last)
        runs = np.empty(len(first), _RUN)
        runs["key"], runs["a"] = head["key"][row[first]], head["a"][row[first]] + nth[first]
        runs["b"] = head["a"][row[last]] + nth[last] + 1
        return by_text([runs], n_groups)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        raw, ends = common.text_bytes(batch.column("text"))
        kept, removed, spans = [], [], []
        for a, b, span in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
            text = raw[a:b].tobytes()
            pairs = np.frombuffer(span or b"", "<i4").reshape(-1, 2).tolist()
            cuts = [0, *(x for p in pairs for x in p), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            removed.append(len(text) - len(kept[-1]))
            spans.append(pairs)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])


def removed_spans(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """key (xxhash64 of the text) and spans (pairs of 32-bit offsets), for each distinct text that loses bytes."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    texts = common.small_batches(docs).select(F.xxhash64(text).alias("key"), text)
    n_buckets, n_groups = common.buckets(docs, 8 << 20, 8), common.buckets(docs, 8 << 20, 8)
    runs = "kind int, group int, blob binary"
    met = common.staged(texts.mapInArrow(_scan(n_buckets), "bucket int, blob binary, runs binary").groupBy("bucket").applyInArrow(_repeated(n_groups, WIDE), runs), "repeats-met")
    wanted = met.filter("kind = 1").select("group", "blob").groupBy("group").applyInArrow(_per_text(_REQUEST), "key long, records binary")
    single = texts.mapInArrow(_once, "key long, text string")
    asked = single.join(wanted, "key").select("text", "records")
    found = common.staged(asked.mapInArrow(_extract(common.buckets(docs, 2 << 20, 8)), "bucket int, heads binary, texts binary").groupBy("bucket").applyInArrow(_sort_bucket(n_groups), runs), "repeats-found")
    return met.filter("kind = 0").union(found).select("group", "blob").groupBy("group").applyInArrow(_covered, "key long, spans binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans (the removed byte ranges) and kept (the remaining bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("key"))
    kind = docs.schema[id_col].dataType.simpleString()
    spans = common.staged(removed_spans(docs, text_col=text_col), "repeats-spans")
    out = rows.join(spans, "key", "left").select("id", "text", "spans").mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, spans array<array<int>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def cut(docs: DataFrame, *, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of each document and kept, its remaining bytes."""
    out = remove_repeats(docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text")), id_col="row", text_col="text")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "kept")
