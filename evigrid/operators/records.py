"""Records kept about reports and jobs: checklists, reviews, retention, readiness, deliveries, seals, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.operators import windows as W


def checklist(found: DataFrame, keys: Sequence[str], item: str, required: Sequence[str]) -> DataFrame:
    """keys, missing (required items that were not found, in their order) and complete. Only the required items are
    gathered, so a key's set has a bound."""
    wanted = F.array(*[F.lit(r) for r in required])
    have = found.groupBy(*keys).agg(F.collect_set(F.when(F.col(item).isin(*required), F.col(item))).alias("_have"))
    missing = F.array_except(wanted, F.col("_have"))
    return have.select(*keys, missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def reviewed(reviews: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reviews with the revision that they meet and their verdict. reviews: keys, at, expected, resolution; heads: keys,
    revision. In the order of `at`, a review counts if it expects the revision that is then current, and makes the next
    one; any other is a conflict. A key's reviews are folded in one expression."""
    own = reviews.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "expected", "resolution"))).alias("_r")).join(heads, list(keys))
    start = F.struct(F.col("revision").cast("long").alias("now"), F.array().cast("array<struct<at:bigint,expected:bigint,resolution:string,met:bigint,verdict:string>>").alias("out"))

    def step(state: Column, r: Column) -> Column:
        fits = r["expected"] == state["now"]
        row = F.struct(r["at"].cast("long").alias("at"), r["expected"].cast("long").alias("expected"), r["resolution"].cast("string").alias("resolution"), state["now"].alias("met"), F.when(fits, "accepted").otherwise("revision_conflict").alias("verdict"))
        return F.struct((state["now"] + F.when(fits, 1).otherwise(0)).cast("long").alias("now"), F.concat(state["out"], F.array(row)).alias("out"))

    return own.select(*keys, F.inline(F.aggregate("_r", start, step)["out"]))


def retention(inventory: DataFrame, deletions: DataFrame, locked: DataFrame, document: str, item: str) -> DataFrame:
    """Per deleted document: deleted and left items, and its state: a tombstone needs a second inventory without a rest."""
    asked = inventory.join(deletions, document, "left_semi").join(locked.select(item, F.lit(True).alias("_locked")), item, "left")
    out = deletions.join(asked, document, "left").groupBy(document).agg(F.count_if(F.col(item).isNotNull() & F.col("_locked").isNull()).alias("deleted"), F.count("_locked").alias("left"))
    return out.withColumn("state", F.when(F.col("left") == 0, "tombstone").otherwise("incomplete"))


def section_map(anchors: DataFrame, document: str, page: str, section: str, last: str) -> DataFrame:
    """document, page, section, ends: the section that begins on each anchor page, up to the page before the next anchor.
    A page on which several sections begin is a conflict. last: the document's last page."""
    per = anchors.groupBy(document, page).agg(F.count_distinct(section).alias("_n"), F.min(section).alias("_s"), F.max(last).alias("_last"))
    out = per.withColumn("section", F.when(F.col("_n") > 1, "conflict").otherwise(F.col("_s")))
    return out.withColumn("ends", W.section_ends(out, [document], page, F.col("_last"))).select(document, page, "section", "ends")


def ready(parts: DataFrame, done_before: DataFrame, keys: Sequence[str], finished: str) -> DataFrame:
    """Keys all of whose parts are finished, and that were not handed on before."""
    return parts.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(finished), F.lit(False))).alias("_all")).filter("_all").select(*keys).join(done_before, list(keys), "left_anti")


def deliveries(received: DataFrame, message: str, acknowledged: str, limit: int = 5) -> DataFrame:
    """message, receives, state: handled once acknowledged (later receives change nothing), dead after `limit` receives
    without that, else pending."""
    out = received.groupBy(message).agg(F.count("*").alias("receives"), F.coalesce(F.bool_or(acknowledged), F.lit(False)).alias("_done"))
    return out.select(message, "receives", F.when(F.col("_done"), "handled").when(F.col("receives") >= limit, "dead").otherwise("pending").alias("state"))


def sealed(rows: DataFrame, columns: Sequence[str], name: str = "seal") -> DataFrame:
    """rows with a SHA-256 of their columns as JSON with sorted keys, nulls included."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return rows.withColumn(name, F.sha2(body, 256))


def reusable(new: DataFrame, done: DataFrame, parts: Sequence[str]) -> DataFrame:
    """new with key (a hash of all parts that a result depends on), reused (the result of the latest ready run of that key)
    and state: reused, not_ready where runs of the key have no ready result, missing. done: parts, result, ready, at."""
    keyed = lambda df: sealed(df, parts, "key")
    prior = keyed(done).groupBy("key").agg(F.max(F.when(F.col("ready"), F.struct("at", "result"))).alias("_best"))
    out = keyed(new).join(prior.withColumn("_met", F.lit(True)), "key", "left")
    state = F.when(F.col("_best").isNotNull(), "reused").when(F.col("_met"), "not_ready").otherwise("missing")
    return out.withColumn("reused", F.col("_best.result")).withColumn("state", state).drop("_best", "_met")


def handed_off(results: DataFrame, published: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """results (key, parts) with seal and state: unchanged where what was published under the key has the same seal, replaced
    where it has another, new where nothing was."""
    own = sealed(results, parts)
    before = sealed(published, parts).select(key, F.col("seal").alias("_before"))
    out = own.join(before, key, "left")
    return out.withColumn("state", F.when(F.col("_before").isNull(), "new").when(F.col("_before") == F.col("seal"), "unchanged").otherwise("replaced")).drop("_before")


def bound(facts: DataFrame, bindings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """facts with `bound`: a trusted binding agrees with every key, nulls with nulls."""
    own = bindings.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_found", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return facts.join(own, same, "left").withColumn("bound", F.col("_found").isNotNull()).drop("_found", *[f"_{k}" for k in keys])


def batch(rows: DataFrame, done: DataFrame, key: str, order: Sequence[str], limit: int) -> DataFrame:
    """The next rows of a work list: not done, in order."""
    return rows.join(done, key, "left_anti").orderBy(*order).limit(limit)


def classification_report(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """One row: n, coverage (predictions that were made), accuracy, majority (of the most frequent truth), macro_f1 (no
    prediction is a miss) and selective_f1 (of the predictions made). A label that never occurs has no part in a mean."""
    t, p = F.col(truth), F.col(predicted)
    cells = rows.groupBy(t.alias("_t"), p.alias("_p")).agg(F.count("*").alias("_n"))
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("_n"))), F.lit(0))
    aggs = [F.sum("_n").alias("n"), n(F.col("_p").isNotNull()).alias("made"), n(F.col("_t") == F.col("_p")).alias("right")]
    for k, label in enumerate(labels):
        own, said = F.col("_t") == label, F.col("_p") == label
        aggs += [n(own).alias(f"t{k}"), n(said).alias(f"p{k}"), n(own & said).alias(f"h{k}"), n(own & F.col("_p").isNotNull()).alias(f"s{k}")]
    x = cells.agg(*aggs)

    def mean_f1(of: str) -> Column:
        each = F.array_compact(F.array(*[F.try_divide(2.0 * F.col(f"h{k}"), F.nullif(F.col(f"{of}{k}") + F.col(f"p{k}"), F.lit(0))) for k in range(len(labels))]))
        return F.try_divide(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), F.nullif(F.size(each), F.lit(0)))

    top = F.greatest(*[F.col(f"t{k}") for k in range(len(labels))]) if len(labels) > 1 else F.col("t0")
    share = lambda c: F.try_divide(c.cast("double"), F.nullif(F.col("n"), F.lit(0)))
    return x.select("n", share(F.col("made")).alias("coverage"), share(F.col("right")).alias("accuracy"), share(top).alias("majority"), mean_f1("t").alias("macro_f1"), mean_f1("s").alias("selective_f1"))


def search_complete(searched: Column, readable: Column, unreadable: Column, pages: Column) -> Column:
    """Was every page 1 to `pages` searched and readable, in order, and none unreadable? Only then a miss is an absence."""
    expected = F.when(pages > 0, F.sequence(F.lit(1), pages.cast("int"))).otherwise(F.array().cast("array<int>"))
    plain = lambda c: F.transform(c, lambda x: x.cast("int"))
    return F.coalesce((plain(searched) == expected) & (plain(readable) == expected) & (F.size(unreadable) == 0), F.lit(False))


def ranked_evidence(pages: DataFrame, claims: DataFrame, by: Sequence[str], page: str, priority: str, density: str, cap: int = 30) -> DataFrame:
    """by, page, place: the claims' own pages first, in order, then pages by priority and density, `cap` in all per group.
    The rank limit runs map-side first."""
    own = claims.select(*by, page).distinct().withColumn("_own", F.lit(0))
    every = pages.join(own, [*by, page], "left")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("_own"), F.when(F.col("_own").isNull(), F.col(priority)).asc(), F.when(F.col("_own").isNull(), F.col(density)).desc(), page))
    return every.withColumn("place", rank).filter(F.col("place") <= cap).select(*by, page, "place")
