"""Periodic runs of words, by bit-parallel lags.

The words of a text are numbered, and bit b of all its word numbers is one big integer, a plane. For a lag q, each plane
XOR itself shifted by q tells where bit b of the words q apart differs; the OR of these is where the words differ, and a
stretch of zeros there is a stretch of period q. Shift-doubling AND keeps the places from which max(q, least - q) zeros
follow, so long stretches stand alone and are read off as starts and ends. A stretch that a shorter lag has given already
has that smaller period.

Lags up to 15 are all tried. A run of lag q in [2g, 4g), g = 8, 16, ... matches itself over at least 2g words, hence over
one whole block of g words that starts at a multiple of g; so only distances from such blocks to later equal ones (by
hash, which can only add lags) are tried. At most 2n distances per g are looked at, and those inside a run whose period
divides them are left out, so a text of one repeated word costs no more than others. Every lag that is tried goes
through the planes, and the others cannot hold a run.

Defined results: a null or empty text has no words and no runs; a null id is kept; repeated rows are each worked on; an
empty table has an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN = "start long, length long, period long"
_ALL = 16


def planes(codes: np.ndarray) -> list[int]:
    """The bits of all numbers, lowest first: bit i of plane b is bit b of codes[i]."""
    most = int(codes.max(initial=0))
    return [int.from_bytes(np.packbits((codes >> b) & 1, bitorder="little").tobytes(), "little") for b in range(most.bit_length())]


def ones(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def stretches(bits: list[int], n: int, q: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of period q and of at least max(least, 2 * q) words."""
    differ = 0
    for plane in bits:
        differ |= plane ^ (plane >> q)
    same = ~differ & ((1 << (n - q)) - 1)
    need, have = max(q, least - q), 1
    while have < need and same:
        step = min(have, need - have)
        same &= same >> step
        have += step
    if not same:
        return []
    first, last = ones(same & ~(same << 1), n), ones(same & ~(same >> 1), n)
    return list(zip(first.tolist(), (last + need + q).tolist(), strict=True))


def _window_hash(sums: np.ndarray, g: int) -> np.ndarray:
    _, down = common.powers(len(sums))
    return (sums[g:] - sums[:-g]) * down[: len(sums) - g]


def lags(sums: np.ndarray, g: int, cover: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Distances in [2g, 4g) between a block of g words at a multiple of g and an equal stretch after it. cover: for each
    place the end and the period of a run over it (0 and 1 if none)."""
    h = _window_hash(sums, g)
    n = len(h)
    order = np.argsort(h, kind="stable")
    group = np.zeros(n, np.int64)
    group[order] = np.concatenate([[0], np.cumsum(h[order][1:] != h[order][:-1])])
    keys = group[order] * n + order  # ascending
    block = np.arange(0, n, g)
    low = np.searchsorted(keys, group[block] * n + np.minimum(block + 2 * g, n))
    high = np.searchsorted(keys, group[block] * n + np.minimum(block + 4 * g, n))
    many = high - low
    if not many.any():
        return []
    begin = np.repeat(block, many)
    q = order[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())] - begin
    end, period = cover[0][begin], cover[1][begin]
    inside = (begin + q + g <= end) & (q % period == 0) & (period <= g)
    return np.unique(q[~inside]).tolist()


def runs(codes: np.ndarray, least: int = 12) -> np.ndarray:
    """[run, (start, length, period)] of one text's word numbers, by start and period."""
    n = len(codes)
    found: dict[tuple[int, int], int] = {}
    if n < least:
        return np.zeros((0, 3), np.int64)
    bits = planes(codes)
    ends, periods = np.zeros(n, np.int64), np.ones(n, np.int64)

    def tried(q: int) -> None:
        for a, b in stretches(bits, n, q, least):
            if (a, b) not in found:
                found[a, b] = q
                new = np.flatnonzero(ends[a:b] < b) + a
                ends[new], periods[new] = b, q

    for q in range(1, min(_ALL, n // 2 + 1)):
        tried(q)
    up, _ = common.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(common.mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    g = _ALL // 2
    while 4 * g <= n:  # a run of lag 2g or more has 4g words or more
        again = lags(sums, g, (ends, periods))
        for q in again:
            if 2 * q <= n:
                tried(q)
        if len(again) == 0 and not _repeats(sums, g):
            break
        g *= 2
    return np.array(sorted((a, b - a, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)


def _repeats(sums: np.ndarray, g: int) -> bool:
    """Does any stretch of g words occur twice? If not, no longer one does."""
    h = np.sort(_window_hash(sums, g))
    return bool((h[1:] == h[:-1]).any())


def _found(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        for batch in common.slices(batches, "text"):
            raw, ends = common.text_bytes(batch.column("text"))
            size, each, kept = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                codes, _ = common.word_codes(raw[a:b], np.array([0, b - a]), common.WordIds())
                got = runs(codes, least)
                size.append(len(codes))
                each.append([{"start": s, "length": m, "period": q} for s, m, q in got.tolist()])
                kept.append(_collapsed(raw[a:b], got, len(codes)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size, pa.int64()), pa.array(each, kind), pa.array(kept, pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def _collapsed(raw: np.ndarray, got: np.ndarray, n: int) -> str:
    """The words that are in no run after that run's first period, joined by one space."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, got[:, 0] + got[:, 2], 1)
    np.add.at(edge, got[:, 0] + got[:, 1], -1)
    drop, at, out = np.cumsum(edge[:-1]) > 0, 0, []
    for c, d in common.parts(raw, True):
        words = raw[c:d].tobytes().split()
        gone = drop[at : at + len(words)]
        at += len(words)
        out += [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if gone.any() else words
    return b" ".join(out).decode("utf-8", "replace")


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str | Column = "text", least: int = 12) -> DataFrame:
    """Per document: id, n_words, runs (maximal stretches of smallest period q with at least max(least, 2q) words; by
    start, then period) and collapsed (the text with every run cut to its first period)."""
    rows = common.small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text") if isinstance(text_col, str) else text_col.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_found(least), f"id {kind}, n_words long, runs array<struct<{RUN.replace(' ', ':')}>>, collapsed string".replace(",:", ",")).withColumnRenamed("id", id_col)
