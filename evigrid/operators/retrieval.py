"""Ranked retrieval: BM25, vector search, rank fusion, routes and their admission.

Lexical indexes stay distributed: postings are (term, id, tf) rows, so a query is a join on its few terms, which are a
bounded side. Corpus statistics (count, total length) are one-row aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import admission, graph, sizing

#: Input bytes of vectors in a block.
BLOCK_BYTES = 1 << 20
#: Bytes of staged lists of terms in a block.
TERM_BYTES = 4 << 20


def term_lists(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, terms, len of every non-blank text, even with no term. Staged, so that texts are cut into terms once."""
    rows = sizing.spread(docs.select(id_col, text_col)).filter(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(F.col(id_col).alias("id"), T.search_terms(F.col(text_col)).alias("terms"))
    return sizing.staged(rows.withColumn("len", F.size("terms")), "terms")


def corpus_of(lists: DataFrame) -> DataFrame:
    """One row: n (texts) and total (their terms)."""
    return lists.agg(F.count("*").alias("n"), F.sum("len").alias("total"))


def frequencies(lists: DataFrame) -> DataFrame:
    """term, df (texts that have it) and cf (its occurrences). A text's terms stand sorted in its own row, so the first of
    each is known there, and both counts are summed by term before anything is shuffled."""
    rows = lists.select(F.array_sort("terms").alias("t"))
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i > 0) & (F.get("t", i - 1) == x), 0).otherwise(1).alias("first")))
    return rows.select(F.inline(marked)).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str, text_col: str, query_id: str, query_col: str) -> DataFrame:
    """query_id, id, score for all matches with a positive score: sum over the query's distinct terms of
    ln(1 + (N - df + .5) / (df + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len / avg)). The lists of terms are dealt out
    by document before they are taken apart, so that what is made of them (occurrences, postings, and a score for each query
    and document) is counted and summed where it is made and never shuffled. They are dealt into blocks of about
    TERM_BYTES, so a task's scores do not grow with the input. The lists are read twice, for df and for the scores: that is
    less than to keep the postings. Spark broadcasts the queries' terms as long as they are few."""
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(T.search_terms(F.col(query_col)))).alias("term"))
    wanted = sizing.staged(wanted, "query-terms")
    lists = term_lists(docs, id_col, text_col)
    by_id = lists.repartition(sizing.blocks(lists, TERM_BYTES), "id")
    terms = by_id.select("id", "len", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    hits = terms.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = sizing.staged(hits.groupBy("term").agg(F.count("*").alias("df")), "term-df")
    known = sizing.staged(wanted.join(df, "term").crossJoin(F.broadcast(corpus_of(lists))), "term-weights")  # one row
    scored = hits.join(known, "term")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") * F.col("n") / F.col("total")))
    return scored.withColumn("w", weight).groupBy("query_id", "id").agg(F.sum("w").alias("score")).filter("score > 0")


def top(ranked: DataFrame, k: int, *, by: Sequence[str] = ("query_id",), score: str = "score", tie: str = "id", digits: int = 6) -> DataFrame:
    """The k best per group with their rank; scores are compared as rounded, ties go to the smaller id. The rank limit
    runs map-side first, so only k rows per group and task are shuffled."""
    rounded = ranked.withColumn(score, F.round(score, digits))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    return rounded.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str, vector_col: str, filters: Sequence[str] = ()) -> DataFrame:
    """The k nearest rows by cosine for each query vector, with equal `filters` columns forced on both sides. Rows are
    dealt into blocks of about BLOCK_BYTES and every block is asked every query, so no side is broadcast."""
    blocks = sizing.blocks(vectors, BLOCK_BYTES)
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("qv"), *[F.col(c).alias(f"q_{c}") for c in filters]).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *filters).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    same = F.col("block") == F.col("q_block")
    for c in filters:
        same = same & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    return top(rows.join(q, same).withColumn("score", cosine(F.col("v"), F.col("qv"))).select("query_id", "id", "score"), k)


def fuse(routes: Sequence[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank): sum of 1 / (constant + rank), best k by (-score, id).
    Repeats within a route count once, at their best rank, and ranks close up."""
    every = None
    for n, route in enumerate(routes):
        own = route.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
        own = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))).withColumn("route", F.lit(n))
        every = own if every is None else sizing.together(every, own)
    return top(every.groupBy("query_id", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"), F.count("*").alias("routes")), k, digits=9)


def admit(hits: DataFrame, blocks: DataFrame, identity: Sequence[str], *, id_col: str, hash_col: str) -> DataFrame:
    """Hits with `admitted`: their block exists under the same identity columns and with the same text hash."""
    own = blocks.select(F.col(id_col), *[F.col(c).alias(f"b_{c}") for c in (*identity, hash_col)], F.lit(True).alias("found"))
    fine = F.col("found").isNotNull()
    for c in (*identity, hash_col):
        fine = fine & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return hits.join(own, id_col, "left").withColumn("admitted", F.coalesce(fine, F.lit(False))).drop("found", *[f"b_{c}" for c in (*identity, hash_col)])


def packed_costs(tokens: Column, most: int, each: int, total: int) -> Column:
    """What each bundle of an ordered list costs under the budget, null for one left out. tokens: array of (whole, part), the
    tokens with and without the context already admitted. The decision depends on all earlier ones, so the list is folded."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("count"), F.array().cast("array<bigint>").alias("costs"))

    def step(acc: Column, x: Column) -> Column:
        fits = lambda c: (acc["count"] < most) & (x[c] <= each) & (acc["used"] + x[c] <= total)
        cost = F.when(fits("whole"), x["whole"]).when(fits("part"), x["part"]).cast("long")
        return F.struct((acc["used"] + F.coalesce(cost, F.lit(0))).cast("long").alias("used"), (acc["count"] + F.when(cost.isNull(), 0).otherwise(1)).alias("count"), F.concat(acc["costs"], F.array(cost)).alias("costs"))

    return F.aggregate(tokens, start, step, lambda acc: acc["costs"])


def packed_state(cost: Column, tokens: Column) -> Column:
    return F.when(cost.isNull(), "omitted").when(cost == tokens, "admitted").otherwise("admitted_without_context")


def pack_evidence(bundles: DataFrame, *, most: int = 12, each: int = 1600, total: int = 12_000) -> DataFrame:
    """Greedy budget packing per claim: claim, rank, bundle, tokens, and shared (tokens of context already admitted).
    A bundle over the budget is retried without its shared context, else left out whole. A claim has at most a few dozen
    bundles, gathered in one row."""
    own = bundles.groupBy("claim").agg(F.sort_array(F.collect_list(F.struct("rank", "bundle", "tokens", "shared"))).alias("_all"))
    costs = packed_costs(F.transform("_all", lambda x: F.struct(x["tokens"].alias("whole"), (x["tokens"] - x["shared"]).alias("part"))), most, each, total)
    rows = F.zip_with("_all", "_costs", lambda x, c: F.struct(x["rank"].alias("rank"), x["bundle"].alias("bundle"), packed_state(c, x["tokens"]).alias("state")))
    return own.withColumn("_costs", costs).select("claim", F.inline(rows))


def density(text: Column, pattern: str, least: int = 200) -> Column:
    """Pattern hits per 1000 characters, of at least `least` characters."""
    return F.regexp_count(text, F.lit(pattern)) * 1000.0 / F.greatest(F.char_length(text), F.lit(least))


def anchors(text: Column) -> Column:
    """Distinct years and scope numbers that anchor a claim, sorted."""
    years = F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2})\b"), 1)
    scopes = F.transform(T.axis_numbers(text, "scope"), lambda s: F.concat(F.lit("scope"), s))
    return F.array_sort(F.array_distinct(F.concat(years, scopes)))


def repeated_lines(pages: DataFrame, group: str, page: str, text: str, *, most_chars: int = 160, least: int = 3, share: float = 0.2) -> DataFrame:
    """Running headers and the like: group, line, pages for trimmed lines of at most most_chars characters that stand on
    at least `least` pages of the group and on `share` of them. Each line counts once a page, in the page's own row."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & (F.char_length(x) <= most_chars)))
    one = pages.groupBy(group, page).agg(F.array_distinct(F.flatten(F.collect_list(lines))).alias("lines"))
    total = one.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    counted = one.select(group, F.explode("lines").alias("line")).groupBy(group, "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    return counted.join(total, F.col(group).eqNullSafe(F.col("_g"))).filter(F.col("pages") >= share * F.col("_n")).select(group, "line", "pages")


def own_first(fused: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the claim's own sources (query_id, id, place) in their order, then the fused hits
    (query_id, id, score) by score and id; each source once, k in all."""
    first = own.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    every = first.join(fused.select("query_id", "id", "score"), ["query_id", "id"], "full_outer")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("place"), F.desc_nulls_last("score"), "id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def listed(routes: DataFrame, order: str = "id") -> DataFrame:
    """(query_id, id) rows of a route without scores, ranked in the order of their ids."""
    return routes.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order)))


def table_context(claims: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """The table around a claim in one of its rows: claim, id, role. claims: claim, table_id, row_no (of one table each);
    members: table_id, id, row_no (null for what is no row or cell), text; edges: child, parent. Rows after the claim's row,
    and all that hangs below them, are later; what only repeats the text of a kept cell above it is repeated; the table
    itself is context; the rest is kept.

    What hangs below the rows is told once for a table, not for each of its claims: of the rows above it the last, and the
    first one with its text, are all that a claim's row is compared with."""
    own = sizing.staged(members.join(sizing.unsent(claims.select("table_id").distinct()), "table_id", "left_semi").select("table_id", "id", "row_no", "text"), "context-members")
    structural = own.filter("row_no is not null")
    loose = own.filter("row_no is null and id <> table_id")
    up = graph.ancestors(edges, loose.select("id"))
    above = up.select("node", "ancestor").join(sizing.unsent(structural.select("table_id", F.col("id").alias("ancestor"), F.col("row_no").alias("_row"), F.col("text").alias("_above"))), "ancestor").select("table_id", F.col("node").alias("id"), "_row", "_above")
    bound = loose.join(sizing.unsent(above), ["table_id", "id"], "left").groupBy("table_id", "id").agg(F.max("_row").alias("_last"), F.min(F.when(F.col("_above") == F.col("text"), F.col("_row"))).alias("_same"))
    ranges = claims.groupBy("claim", "table_id").agg(F.min("row_no").alias("_first"), F.max("row_no").alias("_to"))
    role = F.when(F.col("_last") > F.col("_first"), "later").when(F.col("_same") <= F.col("_to"), "repeated").otherwise("kept")
    out = sizing.unsent(ranges).join(bound, "table_id").select("claim", "id", role.alias("role"))
    rows = sizing.unsent(claims.withColumnRenamed("row_no", "claim_row")).join(structural, "table_id").select("claim", "id", F.when(F.col("row_no") > F.col("claim_row"), "later").otherwise("kept").alias("role"))
    return sizing.together(out, rows, claims.select("claim", F.col("table_id").alias("id"), F.lit("context").alias("role")))


def packets(claims: DataFrame, fused: DataFrame, blocks: DataFrame, tables: DataFrame, elements: DataFrame, identity: Sequence[str], *, k: int = 12, each: int = 1600, total: int = 12_000) -> DataFrame:
    """One evidence packet for each claim: claim, blocked, candidates, rejected and packet_sha256.

    claims: claim, source_id, place, verified, identity... (a row for each of its own sources); fused: query_id, id, score;
    blocks: source_id, identity..., text_hash, tokens, shared; the hash under which the index knew a source is fused.hash;
    tables: source_id, root; elements: element, scopes. The claim's own sources come first, then the fused hits; a hit of
    another identity or text is rejected; what is left is put in scope, gets the elements it may serve, and is packed
    whole under the budget. A claim with an own source that is not verified is blocked, but keeps its packet. Rows are dealt
    by claim, for their rank, by source, for what is known of it, and by claim again; all else is told within a claim's row."""
    own = claims.select("claim", "source_id", "place", F.lit(True).alias("_own"), F.coalesce("verified", F.lit(False)).alias("_verified"), F.struct(*identity).alias("_identity"))
    hits = fused.select(F.col("query_id").alias("claim"), F.col("id").alias("source_id"), "score", F.col("hash").alias("text_hash"))
    every = own.unionByName(hits, allowMissingColumns=True).filter("claim is not null")
    n = sizing.blocks(every, 1 << 20)
    met = sizing.in_parts(every, n, "claim").groupBy("claim", "source_id").agg(F.min("place").alias("place"), F.max("score").alias("score"), F.min("text_hash").alias("text_hash"), F.max("_own").alias("_own"), F.min("_verified").alias("_verified"), F.max("_identity").alias("_identity"))
    claim = Window.partitionBy("claim")
    rank = F.row_number().over(claim.orderBy(F.asc_nulls_last("place"), F.desc_nulls_last("score"), "source_id"))
    ranked = met.withColumn("rank", rank).withColumn("_identity", F.max("_identity").over(claim)).filter(F.col("_identity").isNotNull() & ((F.col("rank") <= k) | F.col("_own")))
    known = blocks.select("source_id", F.col("text_hash").alias("_hash"), "tokens", "shared", F.struct(*identity).alias("_block"))
    roots = tables.filter("root is not null").groupBy("source_id").agg(F.collect_set("root").alias("roots"))
    admitted = F.col("_block").isNotNull() & F.coalesce("text_hash", "_hash").eqNullSafe(F.col("_hash"))
    for c in identity:
        admitted = admitted & F.col("_block")[c].eqNullSafe(F.col("_identity")[c])
    rows = ranked.join(sizing.unsent(known), "source_id", "left").join(sizing.unsent(roots), "source_id", "left").select("claim", "_own", "_verified", "roots", F.when(F.col("rank") <= k, F.struct("rank", F.col("source_id").alias("id"), F.coalesce("_own", F.lit(False)).alias("own"), admitted.alias("admitted"), "roots", F.col("tokens").alias("whole"), (F.col("tokens") - F.col("shared")).alias("part"))).alias("_item"))
    told = sizing.in_parts(rows, n, "claim").groupBy("claim").agg((~F.min("_verified")).alias("blocked"), F.flatten(F.collect_list(F.when(F.col("_own"), F.col("roots")))).alias("_held"), F.array_sort(F.collect_list("_item")).alias("_items"))
    told = admission.with_elements(told, elements).withColumn("_admitted", F.filter("_items", lambda x: x["admitted"]))
    told = told.withColumn("_costs", packed_costs(F.col("_admitted"), k, each, total))

    def candidate(x: Column, cost: Column) -> Column:
        scope = admission.scope_of(x["own"], F.arrays_overlap(x["roots"], F.col("_held")))
        return F.struct(x["rank"].alias("rank"), x["id"].alias("id"), scope.alias("scope"), admission.elements_of(scope).alias("elements"), packed_state(cost, x["whole"]).alias("state"))

    rejected = F.array_compact(F.array_sort(F.transform(F.filter("_items", lambda x: ~x["admitted"]), lambda x: x["id"])))
    out = told.select("claim", F.zip_with("_admitted", "_costs", candidate).alias("candidates"), rejected.alias("rejected"), "blocked")
    return out.withColumn("packet_sha256", F.sha2(F.to_json(F.struct("claim", "blocked", "candidates", "rejected")), 256))
