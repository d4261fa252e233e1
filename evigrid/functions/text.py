"""Column functions over text. All but the Unicode normal forms are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: a run of Hangul syllables, of Latin letters, or a number with separators.
TERM = r"[가-힣]+|[a-z]+|\p{Nd}+(?:[.,]\p{Nd}+)*"
#: Characters whose case folding has a Latin letter that lower() does not give.
FOLDED = {chr(c): chr(c).casefold() for c in range(0x110000) if re.search("[a-z]", chr(c).casefold()) and chr(c).casefold() != chr(c).lower()}


def folded(text: Column) -> Column:
    """Lower-cased text, case-folded as far as Latin letters are concerned."""
    out = text
    for one, letters in FOLDED.items():
        out = F.replace(out, F.lit(one), F.lit(letters))
    return F.lower(F.when(text.rlike("[" + "".join(FOLDED) + "]"), out).otherwise(text))


def search_terms(text: Column) -> Column:
    """Lexical search terms in order, repeats included: Latin words and numbers whole, Hangul words as pairs of
    syllables (a single syllable gives none)."""
    words = F.regexp_extract_all(folded(text), F.lit(f"({TERM})"), 1)

    def cut(word: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(word) - 1, F.lit(1))), lambda k: F.substring(word, k, F.lit(2)))
        return F.when(~word.rlike("^[가-힣]"), F.array(word)).when(F.char_length(word) > 1, pairs).otherwise(F.array().cast("array<string>"))

    return F.when(text.rlike("[가-힣]"), F.flatten(F.transform(words, cut))).otherwise(words)


def number_literal(text: Column) -> Column:
    """The number of a cell that is nothing but a number (sign, thousands groups, decimals), else null."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    fits = F.trim(text).rlike(r"^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$")
    return F.when(fits, plain)


def value_state(text: Column) -> Column:
    """missing for an empty cell, a dash or n/a (never zero); unreadable for what is no number; else present."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(t).isin("", "-", "n/a"), "missing").when(number_literal(t).isNull(), "unreadable").otherwise("present")


def csv_safe(text: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(text.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_key(text: Column) -> Column:
    """Composed, case-folded text with single spaces, for joining on names."""
    return key_form(text)


def sentences(text: Column) -> Column:
    """Trimmed sentences: up to ., ! or ? before white space or the end, or up to line feeds."""
    found = F.regexp_extract_all(text, F.lit(r"((?s).+?(?:[.!?](?=\s|\z)|\n+|\z))"), 1)
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, r"^\s+|\s+\z", "")), lambda s: s != "")


def page_refs(text: Column) -> Column:
    """The distinct pages of a list such as `p. 3-7, 9`, ascending; descending ranges give nothing. Page numbers have at
    most five digits."""
    parts = F.split(F.regexp_replace(text, r"[^0-9,\-]", ""), ",")

    def span(part: Column) -> Column:
        a, b = F.element_at(F.split(part, "-"), 1).cast("int"), F.element_at(F.split(part, "-"), -1).cast("int")
        return F.when(part.rlike(r"^[0-9]{1,5}(-[0-9]{1,5})?$") & (a <= b), F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def axis_numbers(text: Column, axis: str) -> Column:
    """Numbers that follow an axis word, such as scope 1 and 2."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(axis + r"\s*([0-9]+)"), 1)))


def literal_count(text: Column, literal: str) -> Column:
    """Occurrences of a literal, white space ignored on both sides."""
    bare = "".join(literal.split())
    squeezed = F.regexp_replace(text, r"\s+", "")
    return ((F.char_length(squeezed) - F.char_length(F.replace(squeezed, F.lit(bare), F.lit("")))) / len(bare)).cast("long")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc_fold(text: pd.Series) -> pd.Series:
    """Compatibility composition and case folding."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def key_form(text: pd.Series) -> pd.Series:
    """Canonical composition, case folding and single spaces: the form in which names are equal."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()).split()))


def stripped(text: Column) -> Column:
    """Without any white space at its ends, the ideographic space among it."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


#: Typographic ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st"}


def citation_form(text: Column) -> Column:
    """Ligatures as letters, canonical composition, runs of white space as one space."""
    for one, letters in LIGATURES.items():
        text = F.replace(text, F.lit(one), F.lit(letters))
    return collapse_spaces(nfc(text))


#: What a unit note and a scope note may say.
UNIT_NOTE = r"^(?i:단위|unit)\s*:\s*((?:천 )?(?:tCO2e|tCO₂e|kgCO2e|t|kg|g|GJ|TJ|MJ|kWh|MWh|GWh|m3|m³|㎥|L|%p?|톤|원|백만원|억원|개|명|건|대))$"
SCOPE_NOTE = r"^(?:Scope:\s*)?(Scope [123])$"


def unit_note(text: Column) -> Column:
    """The unit of a note that is nothing but a unit note, else null."""
    return F.nullif(F.regexp_extract(stripped(text), UNIT_NOTE, 1), F.lit(""))


def scope_note(text: Column) -> Column:
    """The scope of a note that is nothing but a scope note, else null."""
    return F.nullif(F.regexp_extract(stripped(text), SCOPE_NOTE, 1), F.lit(""))
