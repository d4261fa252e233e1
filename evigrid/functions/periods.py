"""Column functions over dates, reporting periods and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions.text import stripped

#: Accepted forms of a period: a year, a range of years, a date or a range of dates.
YEAR_FORM = r"^(?i:FY\s*)?([0-9]{4})(?:년)?(?:\s+[Qq][1-4])?$"
YEARS_FORM = r"^([0-9]{4})년?\s*[-–—~]\s*([0-9]{4})년?$"
DATES_FORM = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\s*(?:~|–|—|to| - )\s*([0-9]{4}-[0-9]{2}-[0-9]{2}))?$"


def is_supported_period(text: Column) -> Column:
    """Is the text a period in an accepted form, with real dates and its start not after its end?"""
    t = F.regexp_replace(text, r"^\s+|\s+\z", "")
    part = lambda form, k: F.regexp_extract(t, form, k)
    start = F.try_to_date(part(DATES_FORM, 1), "yyyy-MM-dd")
    end = F.when(part(DATES_FORM, 2) == "", start).otherwise(F.try_to_date(part(DATES_FORM, 2), "yyyy-MM-dd"))
    fine = (
        F.when(t.rlike(YEAR_FORM), part(YEAR_FORM, 1).cast("int") > 0).when(t.rlike(YEARS_FORM), (part(YEARS_FORM, 1).cast("int") > 0) & (part(YEARS_FORM, 1).cast("int") <= part(YEARS_FORM, 2).cast("int")))
        .when(t.rlike(DATES_FORM), start <= end)
    )
    return F.coalesce(fine, F.lit(False))


def parse_period(text: Column) -> Column:
    """struct<start, end> of `start/end`; null where a date is no calendar date or the start lies after the end."""
    start, end = F.try_to_date(F.split_part(text, F.lit("/"), F.lit(1)), "yyyy-MM-dd"), F.try_to_date(F.split_part(text, F.lit("/"), F.lit(2)), "yyyy-MM-dd")
    return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))


def iso_date(text: Column) -> Column:
    """YYYYMMDD or ISO as a date, null if neither."""
    return F.coalesce(F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")), F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd")))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def one_year_apart(earlier: Column, later: Column) -> Column:
    """Same month and day in consecutive years."""
    return (F.year(later) == F.year(earlier) + 1) & (F.month(later) == F.month(earlier)) & (F.dayofmonth(later) == F.dayofmonth(earlier))


def valid_at(as_of: Column, starts_on: Column, ends_before: Column) -> Column:
    """Half-open validity; a null end is open."""
    return (starts_on <= as_of) & (ends_before.isNull() | (as_of < ends_before))


#: Multipliers of the Korean currency units.
UNIT_SCALE = {"": 1, "원": 1, "krw": 1, "천원": 1_000, "백만원": 1_000_000, "억원": 100_000_000, "억": 100_000_000, "조원": 1_000_000_000_000, "조": 1_000_000_000_000}


def normalize_amount(raw: Column, unit: Column) -> Column:
    """decimal(38,4) of an amount with thousands commas, (x) for negative, and a unit; null if it is none."""
    t = F.trim(raw)
    negative = t.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(t, r"[(),]", "")
    number = F.when(digits.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), digits.cast("decimal(24,4)"))
    scale = F.create_map([F.lit(x) for k, v in UNIT_SCALE.items() for x in (k, v)])[F.lower(F.trim(F.coalesce(unit, F.lit(""))))].cast("decimal(13,0)")
    return (F.when(negative, -number).otherwise(number) * scale).cast("decimal(38,4)")


def display_interval(raw: Column, scale: Column) -> tuple[Column, Column]:
    """(low, high) in decimal: the value plus or minus half of its last shown digit, times scale."""
    digits = F.char_length(F.regexp_extract(raw, r"\.([0-9]+)$", 1))
    value = raw.cast("decimal(20,6)")
    half = F.element_at(F.array(*[F.lit(f"{5 * 10 ** -(k + 1):.7f}").cast("decimal(20,7)") for k in range(7)]), digits + 1)
    return ((value - half) * scale).cast("decimal(38,7)"), ((value + half) * scale).cast("decimal(38,7)")


#: How prose states a reporting period, explicit dates before months, and these before fiscal years.
_YEAR, _SEP = "((?:19|20)[0-9]{2})", r"\s*(?:년\s*|[./-]\s*)"
DATE_RANGE = rf"(?i){_YEAR}{_SEP}([0-9]{{1,2}})\s*(?:월\s*|[./-]\s*)([0-9]{{1,2}})\s*일?\s*(?:부터|에서|[~∼–—-]|to|through)\s*(?:{_YEAR}{_SEP})?([0-9]{{1,2}})\s*(?:월\s*|[./-]\s*)([0-9]{{1,2}})\s*일?"
MONTH_RANGE = rf"{_YEAR}\s*년\s*([0-9]{{1,2}})\s*월\s*(?:부터|[~∼–-])\s*(?:{_YEAR}\s*년\s*)?([0-9]{{1,2}})\s*월\s*까지"
CALENDAR_RANGE = rf"(?i)January\s+1,?\s+{_YEAR}\s*(?:to|through|[–-])\s*December\s+31,?\s+{_YEAR}"
FISCAL_YEAR = rf"(?i){_YEAR}\s*년?\s*(?:회계\s*연도|회계\s*년도)|(?:fiscal\s+year|FY)\s*{_YEAR}"


def prose_periods(text: Column) -> Column:
    """array<struct<start, end, kind>> of the reporting periods that a text states, with real dates, in order. Of several
    ways to state them, the first that gives a period is taken alone."""

    def groups(pattern: str, n: int) -> Column:
        return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), k).alias(f"g{k}") for k in range(1, n + 1)])

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def told(found: Column, start, end, kind: str) -> Column:
        spans = F.transform(found, lambda g: F.struct(start(g).alias("start"), end(g).alias("end"), F.lit(kind).alias("kind")))
        return F.filter(spans, lambda s: F.coalesce((s["start"] <= s["end"]) & (F.year(s["end"]) <= 2100), F.lit(False)))

    year = lambda g, own, other: F.when(g[own] == "", g[other]).otherwise(g[own])
    one, last = F.lit("1"), lambda y, m: F.last_day(day(y, m, F.lit("1")))
    ways = [
        told(groups(DATE_RANGE, 6), lambda g: day(g["g1"], g["g2"], g["g3"]), lambda g: day(year(g, "g4", "g1"), g["g5"], g["g6"]), "date_range"),
        told(groups(MONTH_RANGE, 4), lambda g: day(g["g1"], g["g2"], one), lambda g: last(year(g, "g3", "g1"), g["g4"]), "month_range"),
        told(groups(CALENDAR_RANGE, 2), lambda g: day(g["g1"], one, one), lambda g: day(g["g2"], F.lit("12"), F.lit("31")), "date_range"),
        told(groups(FISCAL_YEAR, 2), lambda g: day(year(g, "g1", "g2"), one, one), lambda g: day(year(g, "g1", "g2"), F.lit("12"), F.lit("31")), "fiscal_year_calendar"),
    ]
    out = F.when(F.size(ways[0]) > 0, ways[0])
    for way in ways[1:]:
        out = out.when(F.size(way) > 0, way)
    return out.otherwise(ways[0])


def detected_period(candidates: DataFrame, key: str) -> DataFrame:
    """key, status, start, end: candidates are (key, start, end) with null dates where a statement stayed unresolved. One
    distinct period and nothing unresolved is detected; anything else that was found is ambiguous."""
    whole = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.struct("start", "end"))
    found = candidates.groupBy(key).agg(F.count_distinct(whole).alias("n"), F.min(whole).alias("one"), F.count("*").alias("all"), F.count(whole).alias("complete"))
    fine = (F.col("n") == 1) & (F.col("all") == F.col("complete"))
    return found.select(key, F.when(fine, "detected").otherwise("ambiguous").alias("status"), F.when(fine, F.col("one.start")).alias("start"), F.when(fine, F.col("one.end")).alias("end"))


def year_literal(text: Column) -> Column:
    """The one year of a text such as 2024, FY 2024 or 2024년; null for any other text."""
    return F.nullif(F.regexp_extract(stripped(text), r"^(?i:FY\s*)?((?:19|20)[0-9]{2})(?:년|년도)?$", 1), F.lit("")).cast("int")
