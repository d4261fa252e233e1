"""Claim discovery: every block of a document is visited, and each part of its text ends as a claim or with a reason.

The extractor is a port: its replies and spans come in as tables. What a reply leaves out is no absence but unprocessed
text; a reply with one wrong span is refused whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions import ids

ALNUM = r"^[\p{L}\p{N}]$"
#: A border between the two characters on its left and the two on its right, inside a number.
IN_NUMBER = r"\d\|(?:\d|%|[,.]\d)|\d[,.]\|\d|[+−-]\|\d"


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def cuts_token(text: Column, at: Column) -> Column:
    """Does a border at code point `at` cut a word or a number?"""
    left, right = F.substring(text, at, F.lit(1)), F.substring(text, at + 1, F.lit(1))
    inside = (at > 0) & (at < F.char_length(text))
    around = F.concat(F.substring(text, F.greatest(at - 1, F.lit(1)), F.least(at, F.lit(2))), F.lit("|"), F.substring(text, at + 1, F.lit(2)))
    return inside & ((left.rlike(ALNUM) & right.rlike(ALNUM)) | around.rlike(IN_NUMBER))


def span_fine(text: Column, start: Column, end: Column, quote: Column, kind: Column, reason: Column) -> Column:
    """In bounds, literally quoted, not blank, of a known kind with or without a reason as that asks for, and no claim
    that cuts a token. A null anywhere is not fine."""
    literal = F.substring(text, start + 1, end - start)
    shape = (start >= 0) & (start < end) & (end <= F.char_length(text)) & (literal == quote) & ~blank(literal)
    told = F.when(kind == "claim", reason.isNull() & ~cuts_token(text, start) & ~cuts_token(text, end)).when(kind.isin("excluded", "unknown"), reason.isNotNull() & ~blank(reason))
    return F.coalesce(shape & told, F.lit(False))


def discover(blocks: DataFrame, replies: DataFrame, spans: DataFrame, *, namespace: str, pages: Sequence[int] | None = None) -> DataFrame:
    """source_id, page, start, end, outcome (claim, excluded, unknown, conflict, unreadable), reason, quote, claim_id.

    blocks: source_id, page, quality, fragment, text; replies: source_id, failure (null if there are spans); spans:
    source_id, start, end, quote, kind, reason; pages: the declared subset, all if None. A block gets one row with the
    first reason that keeps it out, or a row for each span and for each stretch that no span covers. Reasons, kinds and
outcomes are fixed values."""
    outside = F.lit(False) if pages is None else ~F.col("page").isin(*pages)
    state = F.when(F.col("quality") == "conflicted", "conflict").when(F.col("quality") == "unreadable", "unreadable").otherwise("unknown")
    answered = replies.select("source_id", "failure", F.lit(True).alias("answered"))
    b = blocks.join(answered, "source_id", "left")
    out = lambda reason, outcome: F.struct(F.lit(reason).alias("reason") if isinstance(reason, str) else reason.alias("reason"), (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"))
    first = (
        F.when(outside, out("outside_declared_subset", "excluded")).when(F.col("fragment"), out("source_continuation_fragment", "excluded"))
        .when(~F.coalesce(F.col("quality").isin("verified", "unverified"), F.lit(False)), out(F.coalesce("quality", F.lit("unknown")), state)).when(F.coalesce(blank(F.col("text")), F.lit(True)), out("empty_source", "unknown"))
        .when(F.col("answered").isNull(), out("extraction_failed", "unknown")).when(F.col("failure").isNotNull(), out(F.coalesce("failure", F.lit("")), "unknown"))
    )
    b = b.withColumn("_first", first).select("source_id", "page", "text", "_first")
    # a block's spans in one sorted array: neighbours in it tell the cursor and the gaps, and nothing is put together
    # again after it was shuffled
    given = spans.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "quote", "kind", "reason"))).alias("spans"))
    b = b.join(given, "source_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(given.schema["spans"].dataType)))
    text, size = F.col("text"), F.char_length("text")
    cursor = lambda i: F.when(i > 0, F.get("spans", i - 1)["end"]).otherwise(0)
    fine = F.forall(F.transform("spans", lambda x, i: span_fine(text, x["start"], x["end"], x["quote"], x["kind"], x["reason"]) & F.coalesce(cursor(i) <= x["start"], F.lit(False))), lambda x: x)

    def row(start: Column, end: Column, outcome: Column, reason: Column, quote: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), outcome.alias("outcome"), reason.alias("reason"), quote.cast("string").alias("quote"))

    none, unknown = F.lit(None), F.lit("unknown")
    borders = F.concat(F.transform("spans", lambda x, i: F.struct(cursor(i).alias("a"), x["start"].alias("b"))), F.array(F.struct(F.coalesce(F.try_element_at("spans", F.lit(-1))["end"], F.lit(0)).alias("a"), size.alias("b"))))
    between = lambda g: F.substring(text, g["a"] + 1, g["b"] - g["a"])
    gaps = F.transform(F.filter(borders, lambda g: (g["a"] < g["b"]) & ~blank(between(g))), lambda g: row(g["a"], g["b"], unknown, F.lit("unprocessed_span"), between(g)))
    told = F.transform("spans", lambda x: row(x["start"], x["end"], x["kind"], x["reason"], x["quote"]))
    rows = (
        F.when(F.col("_first").isNotNull(), F.array(row(none, none, F.col("_first.outcome"), F.col("_first.reason"), none)))
        .when(~fine, F.array(row(none, none, unknown, F.lit("MODEL_SPAN_OR_SCHEMA_INVALID"), none))).otherwise(F.concat(told, gaps))
    )
    found = b.select("source_id", "page", F.explode(rows).alias("r")).select("source_id", "page", "r.*")
    name = F.concat_ws("|", F.col("source_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.sha2(F.col("quote"), 256))
    return found.withColumn("claim_id", F.when(F.col("outcome") == "claim", ids.uuid5(namespace, name)))
