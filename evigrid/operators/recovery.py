"""What a selection left out: coverage of inventory rows by selected spans, and the copies of one source.

Overlap and containment are told by sweeps: spans and places stand in one order, and the furthest end so far says whether
a place is inside a span. So a source with many spans costs its rows, not its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import sizing


def reach(places: DataFrame, spans: DataFrame, key: str, at: str, *, until: bool, name: str) -> DataFrame:
    """places with `name`: the furthest end of a span of the same key that starts at or before the place's `at` (before it,
    if until). places: key, at, ...; spans: key, start, end."""
    marks = spans.select(F.col(key).alias("_k"), F.col("start").alias("_at"), F.col("end").alias("_end"), F.lit(None).cast(places.select(F.struct("*").alias("x")).schema["x"].dataType).alias("_row"))
    own = places.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(None).cast(spans.schema["end"].dataType).alias("_end"), F.struct("*").alias("_row"))
    is_place = F.col("_row").isNotNull()
    order = Window.partitionBy("_k").orderBy("_at", (~is_place if until else is_place).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    swept = sizing.together(marks, own).withColumn(name, F.max("_end").over(order))
    return swept.filter(is_place).select("_row.*", name)


def reconcile(candidates: DataFrame, cells: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coverage, recovered). candidates: source, candidate, start, end, eligible; cells: source, candidate, cell, start, end
    (what a candidate must show); spans: source, start, end, kind (claim or other).

    coverage: source, candidate, status, missing: covered if every cell is inside one claim, else partial if any span
    meets the candidate, else missing; missing lists its cells that are in no claim, by start. recovered: source,
    candidate, start, end: of an eligible candidate that is not covered the whole stretch, or, where a span meets it, its
    missing cells; each only if no span and nothing recovered before it (by start of candidate, then of stretch) meets it."""
    claims = spans.filter("kind = 'claim'")
    shown = reach(cells, claims, "source", "start", until=False, name="_reach")
    told = shown.withColumn("_lost", ~F.coalesce(F.col("_reach") >= F.col("end"), F.lit(False)))
    lost = told.filter("_lost").groupBy("source", "candidate").agg(F.sort_array(F.collect_list(F.struct("start", "end", "cell"))).alias("_cells"))
    met = reach(candidates, spans, "source", "end", until=True, name="_met")
    rows = met.join(lost, ["source", "candidate"], "left")
    touched = F.coalesce(F.col("_met") > F.col("start"), F.lit(False))
    status = F.when(F.col("_cells").isNull(), "covered").when(touched, "partial").otherwise("missing")
    rows = rows.withColumn("status", status)
    names = F.transform("_cells", lambda c: c["cell"])
    coverage = rows.select("source", "candidate", "status", F.coalesce(names, F.array().cast(rows.select(names.alias("x")).schema["x"].dataType)).alias("missing"))
    one = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))
    wanted = F.when(F.col("status") == "missing", one).otherwise(F.transform("_cells", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    parts = rows.filter("eligible and status <> 'covered'").select("source", "candidate", F.col("start").alias("from"), F.explode(wanted).alias("s")).select("source", "candidate", "from", "s.*")
    free = reach(parts, spans, "source", "end", until=True, name="_met").filter(~F.coalesce(F.col("_met") > F.col("start"), F.lit(False)))
    # what was recovered before decides, so a source's free stretches are taken in turn; few are left here
    turn = free.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("from", "candidate", "start", "end"))).alias("all"))
    kind = turn.schema["all"].dataType
    taken = F.aggregate("all", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    recovered = turn.select("source", F.inline(taken)).select("source", "candidate", "start", "end")
    return coverage, recovered


def _priority() -> list[Column]:
    area = F.coalesce((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(0.0))
    return [(~F.coalesce(F.col("state") == "verified", F.lit(False))).alias("p_state"), (-area).alias("p_area"), F.col("source_id").alias("p_source"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("quote").alias("p_quote")]


def distinct_sources(refs: DataFrame, keys: tuple[str, ...] = ("doc", "page")) -> DataFrame:
    """One reference of each group of overlapping parser copies: refs: doc, page, position, source_id, quote, start, end,
    state, x0, y0, x1, y1 -> the kept ones with their first position and the number of copies.

    Copies have the same quote but for white space and composition, and boxes that overlap. In order of priority (verified
    first, then larger, then by source, place and quote) a reference joins the first group whose leader it overlaps, or
    leads a new one; so disjoint boxes are never joined over a third. Equal references are one before they are ordered;
    without a box a reference is alone."""
    box = ("x0", "y0", "x1", "y1")
    named = sizing.dealt(refs.withColumn("_quote", T.collapse_spaces(T.nfc("quote"))), *keys, each=4 << 20)  # after the Python step, which forgets it
    own = [*keys, "_quote", "source_id", "quote", "start", "end", "state", *box]
    boxed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    once = named.withColumn("_alone", F.when(~boxed, F.col("position"))).groupBy(*own, "_alone").agg(F.min("position").alias("position"), F.count("*").alias("copies"))
    item = F.struct(*_priority(), "position", "copies", "state", *box)
    groups = once.groupBy(*keys, "_quote").agg(F.sort_array(F.collect_list(item)).alias("_refs"))
    kind = groups.schema["_refs"].dataType
    meets = lambda a, b: F.coalesce((F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"])) & a["x0"].isNotNull() & b["x0"].isNotNull(), F.lit(False))
    whole = lambda a: a["x0"].isNotNull() & a["y0"].isNotNull() & a["x1"].isNotNull() & a["y1"].isNotNull()

    def step(acc: Column, x: Column) -> Column:
        """x into the first group that it meets, or after all of them."""
        at = F.array_position(F.transform(acc, lambda g: whole(g) & whole(x) & meets(g, x)), True).cast("int")
        joined = F.transform(acc, lambda g, i: F.when(i == at - 1, g.withField("position", F.least(g["position"], x["position"])).withField("copies", g["copies"] + x["copies"])).otherwise(g))
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(x)))

    kept = groups.select(*keys, F.inline(F.aggregate("_refs", F.array().cast(kind), step)))
    return kept.select(*keys, "position", F.col("p_source").alias("source_id"), F.col("p_quote").alias("quote"), F.col("p_start").alias("start"), F.col("p_end").alias("end"), "state", *box, "copies")
