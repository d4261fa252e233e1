"""Offset maps between a raw text and the forms that are shown or compared: line ends, canonical composition, joined words.

A map is an array of stretches (raw, text, raw_len, text_len, exact) that tile both texts in order. In an exact stretch,
character stands for character and every offset has its counterpart; any other stretch (a line end of two characters, a
composed character, a deleted space) has its two edges only. Maps are composed stretch by stretch, and inverted by reading their other side, so a
map is as long as its text has changes, not as it has characters. All offsets count code points.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: raw and text offsets, their lengths, and whether inner offsets correspond.
Stretch = tuple[int, int, int, int, bool]
ALIGNED = "text string, map array<struct<raw: int, text: int, raw_len: int, text_len: int, exact: boolean>>"

#: Unit words that no join may make, take part in, or cut.
PROTECTED = "년 월 일 톤 원 억 만 천 백 십 미터 제곱 세제곱 킬로미터 밀리미터 그램 밀리그램 밀리리터 헥타르 와트 킬로와트 메가와트 기가와트 와트시 킬로와트시 메가와트시 시간 초 분 도 퍼센트 개 명 대 건 리터 킬로그램".split()
#: Fixed value: punctuation that may stand around a word that is joined.
AROUND = ".,;:()[]“”\"'•"


class _Map:
    """Stretches of a map in the making; neighbours that are exact become one."""

    def __init__(self):
        self.text: list[str] = []
        self.out: list[Stretch] = []
        self.raw_at = self.text_at = 0

    def same(self, piece: str) -> None:
        n = len(piece)
        if not n:
            return
        if self.out and self.out[-1][4]:
            raw, text, m, _, _ = self.out.pop()
            self.out.append((raw, text, m + n, m + n, True))
        else:
            self.out.append((self.raw_at, self.text_at, n, n, True))
        self._on(n, piece)

    def changed(self, raw_len: int, piece: str) -> None:
        self.out.append((self.raw_at, self.text_at, raw_len, len(piece), False))
        self._on(raw_len, piece)

    def _on(self, raw_len: int, piece: str) -> None:
        self.text.append(piece)
        self.raw_at += raw_len
        self.text_at += len(piece)

    def done(self) -> tuple[str, list[Stretch]]:
        return "".join(self.text), self.out


def line_ends(raw: str) -> tuple[str, list[Stretch]]:
    """Each CR LF is one LF; nothing else changes."""
    m = _Map()
    for k, line in enumerate(raw.split("\r\n")):
        if k:
            m.changed(2, "\n")
        m.same(line)
    return m.done()


@lru_cache(1)
def _joining() -> np.ndarray:
    """For each code point whether it can change together with what stands before it."""
    found = set()
    for c in map(chr, range(0x110000)):
        if unicodedata.combining(c):
            found.add(c)
        parts = unicodedata.decomposition(c)
        if parts and not parts.startswith("<") and len(parts.split()) == 2:
            found.add(chr(int(parts.split()[1], 16)))
    found |= {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of a Hangul syllable
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in found]] = True
    return out


def _clusters(raw: str) -> list[tuple[int, int]]:
    """(start, end) of each run of joining characters with the one character before it."""
    joins = _joining()[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edges = np.flatnonzero(np.diff(joins, prepend=False, append=False))
    return list(zip(np.maximum(edges[::2] - 1, 0).tolist(), edges[1::2].tolist(), strict=True))


def composed(raw: str) -> tuple[str, list[Stretch]]:
    """Canonical composition. A border inside a cluster counts only if both sides, composed alone, give the whole."""
    m = _Map()
    if unicodedata.is_normalized("NFC", raw):
        m.same(raw)
        return m.done()
    at = 0
    for start, end in _clusters(raw):
        _singles(m, raw[at:start])
        for n, own in _cluster(raw[start:end]):
            m.same(own) if n == 1 == len(own) else m.changed(n, own)
        at = end
    _singles(m, raw[at:])
    return m.done()


def _singles(m: _Map, piece: str) -> None:
    """Characters that stand alone; a few of them are written otherwise when composed."""
    if unicodedata.is_normalized("NFC", piece):
        m.same(piece)
        return
    for c in piece:
        whole = unicodedata.normalize("NFC", c)
        m.same(whole) if len(whole) == 1 else m.changed(1, whole)


@lru_cache(1 << 12)
def _cluster(piece: str) -> list[tuple[int, str]]:
    """How many characters of the piece each part takes, and what it becomes."""
    whole, out = unicodedata.normalize("NFC", piece), []
    begin = done = 0
    for k in range(1, len(piece) + 1):
        left = unicodedata.normalize("NFC", piece[:k])
        if k == len(piece) or (left == whole[: len(left)] and unicodedata.normalize("NFC", piece[k:]) == whole[len(left) :]):
            own = whole[done:] if k == len(piece) else left[done:]
            out.append((k - begin, own))
            begin, done = k, done + len(own)
    return out


def joinable(raw: str) -> list[int]:
    """Offsets of single spaces that may be deleted: between two words of Hangul only, neither of them nor both together
    a unit, and not inside a unit that stands in pieces."""
    return _joinable(raw, _points(raw)).tolist()


def _points(raw: str) -> np.ndarray:
    return np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)


_HANGUL, _SPACE, _AROUND, _FIRST, _LAST, _PROTECTED = 1, 2, 4, 8, 16, frozenset(PROTECTED)
_LONGEST = max(map(len, PROTECTED))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """For each code point whether it is Hangul, white space, may stand around a word, and begins or ends a unit."""
    out = np.zeros(0x110000, np.uint8)
    out[ord("가") : ord("힣") + 1] = _HANGUL
    out[[c for c in range(0x110000) if chr(c).isspace()]] = _SPACE
    out[[ord(c) for c in AROUND]] = _AROUND
    out[[ord(u[0]) for u in PROTECTED]] |= _FIRST
    out[[ord(u[-1]) for u in PROTECTED]] |= _LAST
    return out


def _joinable(raw: str, points: np.ndarray) -> np.ndarray:
    """The words beside all spaces at once: a word is of Hangul only if nothing but what may stand around it lies between
    its Hangul and the white space before and after."""
    n, kind = len(points), _kinds()[points]
    hangul = (kind & _HANGUL) > 0
    k = np.flatnonzero(points[1:-1] == 32) + 1
    k = k[hangul[k - 1] & hangul[k + 1]]
    if not len(k):
        return k
    no_hangul, no_around = np.concatenate(([-1], np.flatnonzero(~hangul), [n])), np.concatenate(([-1], np.flatnonzero((kind & _AROUND) == 0), [n]))
    own = np.searchsorted(no_hangul, k)  # the space itself
    before, after = no_hangul[own - 1], no_hangul[own + 1]
    left, right = no_around[np.searchsorted(no_around, before, "right") - 1], no_around[np.searchsorted(no_around, after)]
    space = np.append((kind & _SPACE) > 0, True)  # both ends of the text, -1 and n, count as white space
    fine = space[left] & space[right]
    # few words begin and end as units do, and are as short
    begins, ends = (kind & _FIRST) > 0, (kind & _LAST) > 0
    first = begins[before + 1]
    unit = first & ends[k - 1] & (k - before - 1 <= _LONGEST)
    unit |= begins[k + 1] & ends[after - 1] & (after - k - 1 <= _LONGEST)
    unit |= first & ends[after - 1] & (after - before - 2 <= _LONGEST)
    for x in np.flatnonzero(unit & fine).tolist():
        one, two = raw[before[x] + 1 : k[x]], raw[k[x] + 1 : after[x]]
        fine[x] = one not in _PROTECTED and two not in _PROTECTED and one + two not in _PROTECTED
    spans = [found.span(1) for found in _units().finditer(raw)]
    spans = [x for x in spans if " " in raw[x[0] : x[1]]]
    if spans:
        inside = np.zeros(n, bool)
        for start, end in spans:
            inside[start + 1 : end] = True
        fine &= ~inside[k]
    return k[fine]


@lru_cache(1)
def _units() -> re.Pattern:
    """Where a unit of several letters begins; group 1 is the longest one there. Units can begin inside another."""
    longest_first = sorted((u for u in PROTECTED if len(u) > 1), key=len, reverse=True)
    first = "".join(sorted({u[0] for u in longest_first}))  # most words begin with none of these
    return re.compile(f"(?<![가-힣])(?=[{first}])(?=((?:" + "|".join(" *".join(u) for u in longest_first) + ")(?![가-힣])))")


def joined(raw: str, deleted: Sequence[int]) -> tuple[str, list[Stretch]] | None:
    """The text without the deleted spaces; None if one of them may not go, or they are not ascending."""
    if not set(deleted) <= set(joinable(raw)) or any(a >= b for a, b in zip(deleted, deleted[1:], strict=False)):
        return None
    m, at = _Map(), 0
    for k in deleted:
        m.same(raw[at:k])
        m.changed(1, "")
        at = k + 1
    m.same(raw[at:])
    return m.done()


def borders(stretches: Sequence[Stretch]) -> tuple[np.ndarray, np.ndarray]:
    """(raw, text) offsets of all places where the texts of a map correspond, ascending."""
    r, t, m, n, exact = np.array(stretches, np.int64).reshape(-1, 5).T
    steps = np.where(exact, m, 1)
    nth = np.arange(1, steps.sum() + 1) - np.repeat(np.cumsum(steps) - steps, steps)
    inner = np.repeat(exact, steps) > 0
    raw = np.repeat(r, steps) + np.where(inner, nth, np.repeat(m, steps))
    text = np.repeat(t, steps) + np.where(inner, nth, np.repeat(n, steps))
    return np.append(0, raw), np.append(0, text)


def compose(first: Sequence[Stretch], second: Sequence[Stretch]) -> list[Stretch]:
    """raw -> middle and middle -> text as raw -> text: the borders that both maps have."""
    if len(first) == 1 and first[0][4]:  # nothing has changed before
        return list(second)
    (raw, mid), (mid2, text) = borders(first), borders(second)
    place = np.full(max(mid[-1], mid2[-1]) + 1, -1)
    place[mid2[::-1]] = np.arange(len(mid2))[::-1]
    at = place[mid]
    raw, text = raw[at >= 0], text[at[at >= 0]]
    dr, dt = np.diff(raw), np.diff(text)
    one = (dr == 1) & (dt == 1)
    head = np.flatnonzero(~one | ~np.concatenate([[False], one[:-1]])) if len(one) else np.zeros(0, np.int64)
    end = np.append(head[1:], len(one))
    columns = (raw[head], text[head], raw[end] - raw[head], text[end] - text[head], one[head])
    return list(zip(*(c.tolist() for c in columns), strict=True))


_STEPS = {"line_ends": line_ends, "composed": composed}


def _through(raw: str, steps: Sequence[str]) -> tuple[str, list[Stretch]]:
    now, found = raw, [(0, 0, len(raw), len(raw), True)] if raw else []
    for x in steps:
        now, own = _STEPS[x](now)
        found = compose(found, own)
    return now, found


def _checked(steps: Sequence[str]) -> None:
    unknown = [x for x in steps if x not in _STEPS]
    if unknown:
        raise ValueError(f"unknown steps: {unknown}")


def aligned(text: Column, *steps: str, deleted: Column | None = None) -> Column:
    """struct(text, map) of a text after the steps in turn (`line_ends`, `composed`) and, if `deleted` is given, without
    the spaces at these offsets of what the steps give. Null for a null text, and where a space may not be deleted."""
    _checked(steps)

    def one(raw: str | None, gone: Sequence[int] | None) -> tuple[str, list[Stretch]] | None:
        if raw is None:
            return None
        now, found = _through(raw, steps)
        if gone is not None and len(gone):
            last = joined(now, [int(k) for k in gone])
            if last is None:
                return None
            now, found = last[0], compose(found, last[1])
        return now, found

    if deleted is None:

        @F.arrow_udf(ALIGNED)
        def run(texts: pa.Array) -> pa.Array:
            return _rows(one(x.as_py(), None) for x in texts)

        return _known(run(text))

    @F.arrow_udf(ALIGNED)
    def run_deleting(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return _rows(one(x.as_py(), y.as_py()) for x, y in zip(texts, gone, strict=True))

    return _known(run_deleting(text, deleted))


def _rows(found: Iterator[tuple[str, list[Stretch]] | None]) -> pa.Array:
    """Maps go to Arrow column by column, not as an object for each stretch."""
    texts, maps, ends = [], [np.zeros((0, 5), np.int32)], [0]
    for x in found:
        texts.append(None if x is None else x[0])
        if x is not None and x[1]:
            maps.append(np.array(x[1], np.int32))
        ends.append(ends[-1] + (len(x[1]) if x is not None else 0))
    every = np.concatenate(maps)
    parts = [pa.array(np.ascontiguousarray(every[:, k]) if k < 4 else every[:, 4] > 0) for k in range(5)]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["raw", "text", "raw_len", "text_len", "exact"]))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists], ["text", "map"])


def round_trip(text: Column, *steps: str) -> Column:
    """struct(text, refused, kept) of a text after the steps: how many raw offsets have no border in what the steps give,
    and how many come back to themselves from there. An offset has a few bytes while its text is looked at and none after."""
    _checked(steps)

    @F.arrow_udf("text string, refused int, kept int")
    def run(texts: pa.Array) -> pa.Array:
        now, refused, kept = [], [], []
        for x in texts:
            raw = x.as_py()
            if raw is None:
                out = (None, None, None)
            else:
                done, found = _through(raw, steps)
                at, to = borders(found)
                there, back = np.full(at[-1] + 1, -1), np.full(to[-1] + 1, -1)
                there[at], back[to] = to, at
                met = np.flatnonzero(there >= 0)
                out = (done, len(there) - len(met), int((back[there[met]] == met).sum()))
            for column, value in zip((now, refused, kept), out, strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(now, pa.string()), pa.array(refused, pa.int32()), pa.array(kept, pa.int32())], ["text", "refused", "kept"])

    return run(text)


def shown_trip(text: Column, every: int = 2) -> Column:
    """struct(may, gone, text, start, end) of a text without every so manyth of the spaces that may be deleted: how many
    may, how many are, what is shown, and the raw span that all of it comes from (null for an empty text). The map is an
    array of numbers while its text is looked at, and no stretch of it leaves the task."""

    @F.arrow_udf("may int, gone int, text string, start int, end int")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for x in texts:
            raw = x.as_py()
            if raw is None:
                rows.append((None,) * 5)
                continue
            points = _points(raw)
            may = _joinable(raw, points)
            gone = may[::every]
            keep = np.ones(len(points), bool)
            keep[gone] = False
            shown = points[keep].tobytes().decode("utf-32-le", "surrogatepass")
            start, end = _raw_span(_without(len(points), gone), 0, len(shown)) or (None, None)
            rows.append((len(may), len(gone), shown, start, end))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        columns = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["may", "gone", "text", "start", "end"])

    return run(text)


def _without(n: int, gone: np.ndarray) -> tuple[np.ndarray, ...]:
    """The columns of the map of n characters without those at these ascending offsets."""
    exact = np.ones(2 * len(gone) + 1, bool)
    exact[1::2] = False
    raw = np.zeros(len(exact), np.int64)
    raw[1::2], raw[2::2] = gone, gone + 1
    raw_len = np.diff(raw, append=n)
    text_len = np.where(exact, raw_len, 0)
    some = raw_len > 0
    return tuple(c[some] for c in (raw, np.cumsum(text_len) - text_len, raw_len, text_len, exact))


def _raw_span(columns: Sequence[np.ndarray], start: int, end: int) -> tuple[int, int] | None:
    """raw_span of a map's columns."""
    raw, text, raw_len, text_len, exact = columns
    inner = lambda at: (text < at) & (at < text + text_len) & exact
    both = (raw_len > 0) & (text_len > 0)
    first = np.flatnonzero(both & ((text == start) | inner(start)))[:1]
    last = np.flatnonzero(both & ((text + text_len == end) | inner(end)))[:1]
    if start >= end or not len(first) or not len(last):
        return None
    a, b = raw[first[0]] + start - text[first[0]], raw[last[0]] + (end - text[last[0]] if exact[last[0]] else raw_len[last[0]])
    return (int(a), int(b)) if a < b else None


def _known(made: Column) -> Column:
    return F.when(made["text"].isNotNull(), made)


@F.pandas_udf(ArrayType(IntegerType()))
def joinable_spaces(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else joinable(x))


def _find(of: Column, offset: Column, side: str, edge: str) -> Column:
    """The offset on the other side; null where there is no border. edge: an offset with two counterparts (next to what is
    deleted) takes the one after it as a start, the one before it as an end."""
    other = "text" if side == "raw" else "raw"
    own, far = f"{side}_len", f"{other}_len"
    inner = lambda x: (x[side] < offset) & (offset < x[side] + x[own]) & x["exact"]
    if edge == "start":  # a span starts with a character, so its stretch is the one that it opens
        hit = F.filter(of, lambda x: (x[far] > 0) & (x[own] > 0) & ((x[side] == offset) | inner(x)))
        return F.get(F.transform(hit, lambda x: x[other] + (offset - x[side])), F.lit(0))
    hit = F.filter(of, lambda x: (x[far] > 0) & (x[own] > 0) & ((x[side] + x[own] == offset) | inner(x)))
    return F.get(F.transform(hit, lambda x: F.when(x["exact"], x[other] + (offset - x[side])).otherwise(x[other] + x[far])), F.lit(0))


def raw_span(of: Column, start: Column, end: Column) -> Column:
    """struct(start, end) in the raw text of a span of the other; null if it is empty, out of bounds or splits a change."""
    return _span(_find(of, start, "text", "start"), _find(of, end, "text", "end"), start, end)


def text_span(of: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of a span of the raw text; null likewise, and where it starts or ends with what was deleted."""
    return _span(_find(of, start, "raw", "start"), _find(of, end, "raw", "end"), start, end)


def _span(a: Column, b: Column, start: Column, end: Column) -> Column:
    fine = (start < end) & a.isNotNull() & b.isNotNull() & (a < b)
    return F.when(fine, F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))


def literal_span(text: Column, of: Column, start: Column, end: Column, quote: Column) -> Column:
    """raw_span of a span whose text is literally the quote; null otherwise: nothing is searched for or repaired."""
    return F.when(F.substring(text, start + 1, end - start) == quote, raw_span(of, start, end))


def quoted_span(text: Column, of: Column, quote: Column) -> Column:
    """raw_span of the one place where the quote stands; null if it is blank, absent, or stands there twice."""
    first = F.instr(text, quote) - 1
    again = F.instr(F.substring(text, first + 2, F.char_length(text)), quote)
    once = quote.rlike(r"(?U)\S") & (first >= 0) & (again == 0)
    return F.when(once, raw_span(of, first, first + F.char_length(quote)))


@F.pandas_udf(ArrayType(IntegerType()))
def text_offsets(maps: pd.Series) -> pd.Series:
    """For each raw offset from 0 its offset in the text, -1 where the raw text has no border. A deleted space belongs to
    neither side, so both of its edges have the same."""

    def of(stretches):
        raw, text = borders([(x["raw"], x["text"], x["raw_len"], x["text_len"], x["exact"]) for x in stretches])
        out = np.full(int(raw[-1]) + 1, -1, np.int32)
        out[raw] = text
        return out

    return maps.map(lambda x: None if x is None else of(x))
