"""Searching for evidence that is missing: every literal place of a term, and windows around these that speak of a claim."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import sizing

#: Characters of a window, metric anchors that must be met at most, and the length from which a Hangul word is
#: distinctive; words that are no anchor; units; endings and particles of a word.
PREVIEW, MOST_METRICS, DISTINCTIVE = 200, 2, 4
STOP_WORDS = (
    "당사 회사 당사는 회사는 있으며 있습니다 합니다 하였습니다 하고 위한 통해 대한 위해 따라 "
    "위하여 대상으로 목표 달성 감축 절감 운영 관리 추진 개발 적용 구축 이행 검토 계획 대비 "
    "전환 진행 예정 지속 명시 구체 보고 기준 정량 단위 중장기 전략 확보 수행 도입 분석 "
    "수립 지원 포함 활동 노력 실적 성과 공급 확대 세계 국내 해외 전사 사업장 본사 공장 "
    "년까지 년에는 년부터 년대비"
).split()
PERIOD = r"(?<!\d)(?:19|20)\d{2}(?!\d)"
BOUNDARY = r"(?i)Scope\s*[123](?:\s*[·/&]\s*[123])*|국내|해외|전사|연결|별도|[가-힣A-Za-z0-9-]+(?:사업장|공장|법인|센터)"
WORD = r"[A-Za-z][A-Za-z0-9-]*|[가-힣]{2,}"
PARTICLE = r"(?:에서는|으로|에서|까지|부터|에게|에는|은|는|을|를|의|에|와|과)$"
NO_METRIC = r"(?i)^(?:scope|tCO2(?:eq|e)?|MWh|GWh|MW|kWh|kg|tons|tonnes)$"
VERB_END = ("합니다", "있습니다", "했습니다", "하고", "하여", "하며")
UNIT = r"(?i)\b(?:tCO2(?:eq|e)?|MWh|GWh|MW|kWh|kg|tonnes|tons)\b|%"
REASONS = ("지표·활동 앵커 불일치", "기간 앵커 누락 또는 불일치", "조직·사업장 범위 앵커 누락 또는 불일치")
AXES = ("metric", "metric_distinctive", "period", "boundary")


def literal_hits(pages: DataFrame, terms: Sequence[str], *, text: str = "text") -> DataFrame:
    """The rows of `pages` with term, start, end and quote for every place where a term stands, white space ignored in both
    and case ignored. Places of one term do not overlap. The terms are a list of the caller's; they are looked for in one
    pass over each text where it lies, so nothing is shuffled."""
    patterns = [(t, re.compile(r"\s*".join(re.escape(c) for c in t if not c.isspace()), re.I)) for t in dict.fromkeys(terms) if t.strip()]

    @F.pandas_udf("array<struct<term:string,start:int,end:int,quote:string>>")
    def places(texts: pd.Series) -> pd.Series:
        def of(x: str | None) -> list[dict]:
            return [] if x is None else sorted(({"term": t, "start": m.start(), "end": m.end(), "quote": m.group()} for t, p in patterns for m in p.finditer(x)), key=lambda h: (h["start"], h["term"]))

        return pd.Series([of(x) for x in texts], dtype=object)

    return pages.select("*", F.inline(places(F.col(text))))


def compact(text: Column, fold: Callable[[Column], Column] = T.folded) -> Column:
    """Case-folded, without any white space: what anchors are compared in. fold: another way to level case, such as
    F.lower, which leaves a sharp s as it is."""
    return F.regexp_replace(fold(text), r"(?U)\s+", "")


def anchors(quote: Column, *, period: str = PERIOD, boundary: str = BOUNDARY) -> Column:
    """struct of metric, metric_distinctive, period and boundary (sorted arrays): the words of a claim that its evidence
    should share. An absent axis is empty and never invented. period, boundary: other patterns of what these are."""
    found = lambda q, p: F.array_sort(F.array_distinct(F.regexp_extract_all(q, F.lit(f"({p})"), F.lit(0))))
    verb = lambda w: _any([w.endswith(e) for e in VERB_END])
    fine = lambda w, boundary: (F.char_length(w) >= 2) & ~w.isin(*STOP_WORDS) & ~w.rlike(NO_METRIC) & ~verb(w) & ~F.array_contains(boundary, w) & ~w.rlike(r"^\d+$")
    # each step is bound once to a row's value: what a lambda reads would else be worked out again for every word
    one = F.array(F.struct(quote.alias("q"), found(quote, period).alias("period"), found(quote, boundary).alias("boundary"), F.array_distinct(F.regexp_extract_all(quote, F.lit(f"({WORD})"), F.lit(0))).alias("words")))
    one = F.transform(one, lambda x: F.struct(x["period"].alias("period"), x["boundary"].alias("boundary"), F.array_distinct(F.transform(x["words"], lambda w: F.regexp_replace(w, PARTICLE, ""))).alias("words")))
    one = F.transform(one, lambda x: F.struct(F.array_sort(F.filter(x["words"], lambda w: fine(w, x["boundary"]))).alias("metric"), x["period"].alias("period"), x["boundary"].alias("boundary")))
    one = F.transform(one, lambda x: F.struct(x["metric"].alias("metric"), F.filter(x["metric"], lambda w: w.rlike("[A-Za-z]") | (F.char_length(w) >= DISTINCTIVE)).alias("metric_distinctive"), x["period"].alias("period"), x["boundary"].alias("boundary")))
    return F.get(one, F.lit(0))


def _any(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for x in parts[1:]:
        out = out | x
    return out


def windows(hits: DataFrame, pages: DataFrame, keys: Sequence[str], *, text: str = "text", size: int = PREVIEW, fold: Callable[[Column], Column] = T.folded) -> DataFrame:
    """keys, w_start, w_end, preview, compact of the distinct windows of `size` characters around hits (keys, start)."""
    near = hits.select(*keys, F.greatest(F.col("start") - size // 2, F.lit(0)).alias("_a")).distinct()
    at = near.join(pages.select(*keys, F.col(text).alias("_text")), list(keys))
    end = F.least(F.char_length("_text"), F.col("_a") + size)
    at = at.select(*keys, "_text", F.greatest(end - size, F.lit(0)).alias("w_start"), end.alias("w_end"))
    shown = F.substring("_text", F.col("w_start") + 1, F.col("w_end") - F.col("w_start"))
    return at.select(*keys, "w_start", "w_end", shown.alias("preview")).distinct().withColumn("compact", compact(F.col("preview"), fold))


def candidates(claims: DataFrame, shown: DataFrame, on: Sequence[str], *, fold: Callable[[Column], Column] = T.folded, period: str = PERIOD, boundary: str = BOUNDARY, unit: str = UNIT) -> DataFrame:
    """Windows that may speak of a claim: claims: claim, on..., quote; shown: windows(). A window is a candidate if it has
    one of the claim's metrics (a distinctive one where the claim has any) or one of its units. It is matched if it has
    enough metrics, all periods and all boundaries; else rejected, with each reason. fold is that of windows(); period, boundary and unit are other patterns of what these are.

    Claims meet the windows of the same `on` (a document, say) through one anchor they share: claims are posted by their
    metrics and units, and a window by those words of the same document's claims that it holds."""
    c = claims.withColumn("_anchors", anchors(F.col("quote"), period=period, boundary=boundary)).withColumn("_units", F.array_distinct(F.transform(F.regexp_extract_all("quote", F.lit(f"({unit})"), F.lit(0)), lambda u: compact(u, fold))))
    words = F.array_union(F.transform(F.col("_anchors.metric"), lambda m: compact(m, fold)), F.col("_units"))
    posted = c.select("claim", *on, F.explode(words).alias("_word"))
    asked = posted.groupBy(*on).agg(F.collect_set("_word").alias("_asked"))
    held = shown.join(asked, list(on)).withColumn("_word", F.explode(F.filter("_asked", lambda w: F.contains(F.col("compact"), w)))).drop("_asked")
    met = held.join(posted, [*on, "_word"]).select("claim", *[x for x in shown.columns]).distinct()
    rows = met.join(c.select("claim", "_anchors", "_units"), "claim")
    matched = {axis: F.filter(F.col(f"_anchors.{axis}"), lambda t: F.contains(F.col("compact"), compact(t, fold))) for axis in AXES}
    rows = rows.select("*", *[m.alias(axis) for axis, m in matched.items()])
    required = F.least(F.lit(MOST_METRICS), F.size("_anchors.metric"))
    distinct_ok = (F.size("_anchors.metric_distinctive") == 0) | (F.size("metric_distinctive") > 0)
    metric_ok = (required > 0) & (F.size("metric") >= required) & distinct_ok
    same_unit = F.exists("_units", lambda u: F.contains(F.col("compact"), u))
    failures = F.array_compact(F.array(F.when(~metric_ok, REASONS[0]), F.when(F.size("period") != F.size("_anchors.period"), REASONS[1]), F.when(F.size("boundary") != F.size("_anchors.boundary"), REASONS[2])))
    rows = rows.filter(((F.size("metric") > 0) & distinct_ok) | same_unit).withColumn("_failures", failures)
    reason = F.when(F.size("_failures") > 0, F.array_join("_failures", "; "))
    return rows.withColumn("linkage", F.when(F.size("_failures") == 0, "matched").otherwise("rejected")).withColumn("rejection_reason", reason).drop("_anchors", "_units", "_failures", "compact")


def folded(text: str) -> str:
    """T.folded of one text."""
    return text.lower() if text.isascii() else "".join(T.FOLDED.get(c, c) for c in text).lower()


@dataclass(frozen=True)
class Reading:
    """How own_candidates reads texts and quotes; as it stands, like literal_hits, anchors and candidates. bounded: a word
    that is a boundary is no metric."""

    period: str = PERIOD
    boundary: str = BOUNDARY
    unit: str = UNIT
    word: str = WORD
    space: str = r"\s"
    fold: Callable[[str], str] = folded
    bounded: bool = True


def own_candidates(texts: DataFrame, key: str, terms: Sequence[str], reading: Reading | None = None, *, size: int = PREVIEW) -> DataFrame:
    """claim, w_start, w_end, metric, period, boundary, linkage and rejection_reason of candidates() where each text
    (key, text, quote) has its own claim: its quote, against the windows around the literal places of the terms in all texts
    of the key. The texts are shuffled once by their key; windows and their words never leave the task."""
    own = reading or Reading()
    known = sizing.dealt(texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("claim"), "text", "quote"), "claim", each=4 << 20)
    grouped = known.groupBy("claim").agg(F.collect_list(F.struct("text", "quote")).alias("rows"))
    kinds = [pa.int32(), pa.int32(), *[pa.list_(pa.string())] * 3, pa.string(), pa.string()]
    names = ["claim", "w_start", "w_end", "metric", "period", "boundary", "linkage", "rejection_reason"]
    schema = f"claim {grouped.schema['claim'].dataType.simpleString()}, w_start int, w_end int, metric array<string>, period array<string>, boundary array<string>, linkage string, rejection_reason string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(terms, own, size)
        for batch in batches:
            claims, every = batch.column("claim"), batch.column("rows")
            for begin in range(0, batch.num_rows, 64):  # few texts have many windows
                at, found = [], []
                for k in range(begin, min(begin + 64, batch.num_rows)):
                    more = list(judge([(x["text"], x["quote"]) for x in every[k].as_py()]))
                    at += [k] * len(more)
                    found += more
                if found:
                    columns = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([claims.take(pa.array(at)), *columns], names)

    return grouped.mapInArrow(run, schema)


@lru_cache(1 << 10)
def _place(term: str, space: str) -> re.Pattern:
    """Where a term stands, case and white space ignored. Its first character is spelt in each of its cases: a search for
    one of a few characters runs over a text much faster than one that levels the case of all."""
    first, *rest = [re.escape(c) for c in term if not c.isspace()]
    cases = re.findall(first, "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))), re.I)
    return re.compile("".join(["[", *map(re.escape, cases), "]", *(f"{space}*(?i:{c})" for c in rest)]))


def _judge(terms: Sequence[str], own: Reading, size: int) -> Callable[[list[tuple[str | None, str | None]]], Iterator[tuple]]:
    """The rows of own_candidates, without their claim, for the texts and quotes of one key."""
    places = [_place(t, own.space) for t in dict.fromkeys(terms) if t.strip()]
    period, boundary, unit, word, space = (re.compile(x) for x in (own.period, own.boundary, own.unit, own.word, f"{own.space}+"))
    particle, no_metric, stop = re.compile(PARTICLE), re.compile(NO_METRIC), frozenset(STOP_WORDS)
    compacted = lambda x: own.fold(space.sub("", x))
    every = lambda p, x: sorted({m[0] for m in p.finditer(x)})

    def read(quote: str) -> tuple:
        bounds = every(boundary, quote)
        words = {particle.sub("", w) for w in every(word, quote)}
        metric = sorted(w for w in words if len(w) >= 2 and w not in stop and not no_metric.search(w) and not w.endswith(VERB_END) and not (own.bounded and w in bounds))
        distinctive = frozenset(w for w in metric if re.search("[A-Za-z]", w) or len(w) >= DISTINCTIVE)
        pairs = [[(x, compacted(x)) for x in axis] for axis in (metric, every(period, quote), bounds)]
        return *pairs, distinctive, {compacted(u) for u in every(unit, quote)}

    def judge(rows: list[tuple[str | None, str | None]]) -> Iterator[tuple]:
        starts = {max(m.start() - size // 2, 0) for text, _ in rows if text is not None for p in places for m in p.finditer(text)}
        spans = set()
        for text, _ in rows if starts else ():
            for a in starts:
                end = a + size if text is None else min(len(text), a + size)
                spans.add((max(end - size, 0), end))
        for text, quote in rows if starts else ():
            if text is None or quote is None:
                continue
            metrics, periods, bounds, distinctive, units = read(quote)
            if not metrics and not units:
                continue
            required = min(MOST_METRICS, len(metrics))
            # windows overlap, so white space is taken out once for all of them
            edges = sorted({x for span in spans for x in span})
            pieces = [space.sub("", text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            whole, at = "".join(pieces), dict(zip(edges, accumulate(map(len, pieces), initial=0), strict=True))
            for a, b in spans:
                shown = own.fold(whole[at[a] : at[b]])
                metric = [w for w, c in metrics if c in shown]
                fine = not distinctive or not distinctive.isdisjoint(metric)
                if not (metric and fine) and not any(u in shown for u in units):
                    continue
                when, where = ([w for w, c in axis if c in shown] for axis in (periods, bounds))
                failed = (not (required and len(metric) >= required and fine), len(when) != len(periods), len(where) != len(bounds))
                reason = "; ".join(r for r, x in zip(REASONS, failed, strict=True) if x)
                yield a, b, metric, when, where, "rejected" if reason else "matched", reason or None

    return judge
