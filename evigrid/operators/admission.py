"""What may be used: documents, candidates, facts and statements against what is known of them, with the first reason why not.

Every check is an expression over one joined row, so the joins are the work and each runs on a key. Reasons, states and
limits are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.functions import text as T
from evigrid.operators import sizing

IDENTITY = ("tenant_id", "company_id", "package_id", "corp_code", "fiscal_year", "consolidation")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that holds; a check that is null does not hold."""
    out = F.when(F.coalesce(checks[0][0], F.lit(False)), checks[0][1])
    for found, reason in checks[1:]:
        out = out.when(F.coalesce(found, F.lit(False)), reason)
    return out


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def document_gate(sources: DataFrame, packets: DataFrame, registry: DataFrame, bindings: DataFrame) -> DataFrame:
    """sources with reason: the first check that a packet's source fails against the registry of documents, null if none.

    sources: packet, source_id, document_id, artifact_sha256, locator, quote. packets: packet, item, synthetic, decision
    (what was decided on, as JSON), the IDENTITY columns, and for both roles (sustainability, financial) <role>_version,
    <role>_published, <role>_start and <role>_end; rcept_no, as_of. registry: document_id, synthetic, IDENTITY, role, version,
    rcept_no, published, as_of, start, end, artifact_sha256, items (array), available (null: published), decision.
    bindings: document_id, source_id, locator, quote."""
    p = packets.select("packet", *[F.col(c).alias(f"p_{c}") for c in packets.columns if c != "packet"])
    r = registry.select("document_id", *[F.col(c).alias(f"r_{c}") for c in registry.columns if c != "document_id"], F.lit(True).alias("r_known"))
    b = bindings.select("document_id", "source_id", F.col("locator").alias("b_locator"), F.col("quote").alias("b_quote"), F.lit(True).alias("b_known"))
    x = sources.join(p, "packet").join(r, "document_id", "left").join(b, ["document_id", "source_id"], "left")
    c = F.col
    by_role = lambda name: F.when(c("r_role") == "sustainability", c(f"p_sustainability_{name}")).when(c("r_role") == "financial", c(f"p_financial_{name}"))
    identity = F.lit(False)
    for name in IDENTITY:
        identity = identity | differs(c(f"r_{name}"), c(f"p_{name}"))
    identity = identity | ~F.coalesce(c("r_role").isin("sustainability", "financial"), F.lit(False)) | by_role("version").isNull() | differs(c("r_version"), by_role("version"))
    identity = identity | ((c("r_role") == "financial") & differs(c("r_rcept_no"), c("p_rcept_no")))
    available = F.coalesce(c("r_available"), c("r_published"))
    reason = first_reason(
        (c("r_known").isNull(), "document_registry_missing"), (c("r_synthetic").isNull() | differs(c("r_synthetic"), c("p_synthetic")), "document_synthetic_mismatch"), (identity, "document_identity_mismatch"),
        (differs(c("r_published"), by_role("published")), "document_publication_mismatch"), (differs(c("r_as_of"), c("p_as_of")), "document_as_of_mismatch"),
        (differs(c("r_start"), by_role("start")) | differs(c("r_end"), by_role("end")), "document_period_mismatch"), (differs(c("r_artifact_sha256"), c("artifact_sha256")), "document_artifact_mismatch"),
        (~F.coalesce(F.array_contains("r_items", c("p_item")), F.lit(False)), "document_not_relevant"), (available.isNull() | c("r_as_of").isNull(), "document_date_invalid"), (available > c("r_as_of"), "document_not_available_as_of"),
        (c("r_decision").isNull(), "decision_binding_missing"), (c("r_decision") != c("p_decision"), "decision_binding_mismatch"), (c("b_known").isNull(), "source_binding_missing"),
        (differs(c("b_locator"), c("locator")) | differs(c("b_quote"), c("quote")), "source_binding_mismatch"),
    )
    return x.select(*sources.columns, reason.alias("reason"))


def raw_candidates(candidates: DataFrame, blocks: DataFrame, *, tolerance: float = 1e-6) -> DataFrame:
    """candidates with reason: why a hit of some index may not be used as it is, null if it may. candidates: doc, manifest,
    source_id, status, page, label, location, state, x0, y0, x1, y1, sha256, start, end, quote; blocks: doc, manifest,
    source_id, page, label, location, state, x0, y0, x1, y1, text (null: no winner). A hit may not claim to be accepted, and
    must be literally where it says."""
    own = blocks.select("doc", "manifest", "source_id", *[F.col(c).alias(f"b_{c}") for c in ("page", "label", "location", "state", "x0", "y0", "x1", "y1", "text")])
    x, c = candidates.join(own, ["doc", "manifest", "source_id"], "left"), F.col
    near = lambda a: ~F.coalesce((F.abs(c(a) - c(f"b_{a}")) <= tolerance) & ~F.isnan(c(a)), F.lit(False))
    fits = (c("start") >= 0) & (c("start") < c("end")) & (c("end") <= F.char_length("b_text"))
    reason = first_reason(
        (~F.coalesce(c("status").isin("candidate", "unverified", "unconfirmed"), F.lit(False)), "status"), (c("b_text").isNull(), "identity"), (~F.coalesce((c("location") == "located") & (c("b_location") == "located"), F.lit(False)), "location"),
        (near("x0") | near("y0") | near("x1") | near("y1"), "bbox"), (differs(c("page"), c("b_page")) | (c("page") < 1), "page"), (differs(c("label"), c("b_label")), "label"), (differs(c("state"), c("b_state")), "verification"),
        (differs(c("sha256"), F.sha2("b_text", 256)), "text_hash"), (~F.coalesce(fits, F.lit(False)), "span"), (c("quote").isNull() | (c("quote") == "") | differs(c("quote"), F.substring("b_text", c("start") + 1, c("end") - c("start"))), "quote"),
    )
    return x.select(*candidates.columns, reason.alias("reason"))


def scope_of(own: Column, same: Column) -> Column:
    """The scope of a hit: is it the claim's own source, is it in a table of one?"""
    return F.when(own, "local_claim").when(same, "same_table").otherwise("global_bound")


def source_scope(hits: DataFrame, claims: DataFrame, tables: DataFrame) -> DataFrame:
    """hits (claim, source_id) with scope: local_claim for a source of the claim itself, same_table for one in a table that
    one of the claim's sources is in, else global_bound. claims: claim, source_id; tables: source_id, root (of its table)."""
    own = claims.select("claim", "source_id").distinct().withColumn("_own", F.lit(True))
    held = claims.join(tables, "source_id").select("claim", "root").distinct()
    same = hits.select("claim", "source_id").distinct().join(tables, "source_id").join(held, ["claim", "root"]).select("claim", "source_id", F.lit(True).alias("_same")).distinct()
    scope = scope_of(F.col("_own"), F.col("_same"))
    return hits.join(own, ["claim", "source_id"], "left").join(same, ["claim", "source_id"], "left").withColumn("scope", scope).drop("_own", "_same")


def with_elements(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """rows beside `_elements`, the sorted elements of each scope, for `elements_of`. elements: element, scopes (array); a list
    of the rule pack, so it has a bound and is one row here. A join by scope would shuffle all rows into three places."""
    one = elements.select("element", F.explode("scopes").alias("scope")).filter("scope is not null").groupBy("scope").agg(F.array_sort(F.collect_set("element")).alias("elements"))
    return rows.crossJoin(F.broadcast(one.agg(F.map_from_entries(F.collect_list(F.struct("scope", "elements"))).alias("_elements"))))  # one row


def elements_of(scope: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("_elements"), scope), F.array().cast("array<string>"))


def allowed_elements(scoped: DataFrame, elements: DataFrame) -> DataFrame:
    """scoped (with scope) with elements: those whose allowed scopes hold it, sorted."""
    return with_elements(scoped, elements).withColumn("elements", elements_of(F.col("scope"))).drop("_elements")


def element_status(tags: DataFrame, refs: DataFrame, hits: DataFrame, coverage: DataFrame) -> DataFrame:
    """claim, element, status, reason, undetermined_reason. tags: claim, doc, element, state; refs: claim, element, kind
    (confirmed, candidate); hits: claim, element, linkage (matched, rejected, or null for a bare hit); coverage: doc, complete.
    Absence is told only where the whole document was searched and nothing was found; it changes no grade."""
    r = refs.groupBy("claim", "element").agg(F.count_if(F.col("kind") == "confirmed").alias("confirmed"), F.count_if(F.col("kind") == "candidate").alias("candidates"))
    h = hits.groupBy("claim", "element").agg(F.count("*").alias("hits"), F.count_if(F.col("linkage") == "matched").alias("matched"), F.count_if(F.col("linkage") == "rejected").alias("rejected"))
    x = tags.join(r, ["claim", "element"], "left").join(h, ["claim", "element"], "left").join(coverage, "doc", "left").fillna(0, ["confirmed", "candidates", "hits", "matched", "rejected"]).withColumn("complete", F.coalesce("complete", F.lit(False)))
    state, told = F.coalesce("state", F.lit("unknown")), F.col("state").isin("conflict", "not_applicable", "present")
    confirmed = (state == "present") & (F.col("confirmed") > 0)
    absent = ~F.coalesce(told, F.lit(False)) & F.col("complete") & (F.col("hits") == 0) & (F.col("candidates") == 0)
    status = F.when(confirmed, "confirmed").when(absent, "not_found_in_report").otherwise("undetermined")
    reason = (
        F.when(confirmed, "CITATION_AND_BINDING_VALIDATED").when(absent, "COMPLETE_SEARCH_NO_MATCH_DISPLAY_ONLY").when(state == "conflict", "ELEMENT_CONFLICT").when(state == "not_applicable", "ELEMENT_NOT_APPLICABLE")
        .when(~F.col("complete"), "COVERAGE_INCOMPLETE").otherwise("CANDIDATE_LINKAGE_UNRESOLVED")
    )
    sub = F.when(F.coalesce(told, F.lit(False)), "linkage_unclear").when(F.col("matched") > 0, "candidate_needs_review").when(F.col("rejected") > 0, "linkage_unclear").otherwise("no_text_candidate")
    return x.select("claim", "element", status.alias("status"), reason.alias("reason"), F.when(status == "undetermined", sub).alias("undetermined_reason"))


def different(value: Column) -> Column:
    """How many values a small group has. Of several distinct counts Spark would shuffle each row once for each of them."""
    return F.size(F.collect_set(value))


def fact_admission(replicas: DataFrame, votes: DataFrame, required: DataFrame, *, least: int = 2) -> DataFrame:
    """claim, satisfied, reasons (sorted): do three fresh replies of one context agree on every required element?
    replicas: claim, replicate, request_id, provider_id, context, fresh, source_verified; votes: claim, replicate, element,
    state, binding, binding_sha256, verified (are all its sources?), value; required: claim, element. An element is admitted
    with `least` present votes of one accepted binding and one value, and no vote but these and unknown."""
    r = replicas.groupBy("claim").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("replicate")).alias("ids"), F.bool_and(F.coalesce("source_verified", F.lit(False))).alias("verified"), F.bool_and(F.coalesce("fresh", F.lit(False))).alias("fresh"),
        *[different(F.when(F.col(c) != "", F.col(c))).alias(f"n_{c}") for c in ("request_id", "provider_id", "context")], F.count_if(F.col("context").rlike("^[0-9a-f]{64}$")).alias("hashed"),
    )
    complete = (F.col("n") == 3) & (F.col("ids") == F.array(F.lit(1), F.lit(2), F.lit(3)))
    r = r.withColumn("complete", complete)
    present = F.col("state") == "present"
    every = required.join(replicas.select("claim", "replicate"), "claim", "left").join(votes, ["claim", "replicate", "element"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    sound = F.coalesce((F.col("binding") == "accepted") & F.col("binding_sha256").rlike("^[0-9a-f]{64}$") & F.col("verified"), F.lit(False))
    e = every.groupBy("claim", "element").agg(
        F.count_if(~F.col("state").isin("present", "unknown")).alias("odd"), F.count_if(present).alias("present"), F.count_if(present & ~sound).alias("unsound"),
        different(F.when(present, F.col("binding_sha256"))).alias("bindings"), different(F.when(present, F.coalesce(F.concat(F.lit("v"), "value"), F.lit("-")))).alias("values"),
    )
    fine = (F.col("odd") == 0) & (F.col("present") >= least) & (F.col("unsound") == 0) & (F.col("bindings") == 1) & (F.col("values") == 1)
    failed = e.join(r.select("claim", "complete"), "claim", "left").withColumn("fine", fine & F.coalesce("complete", F.lit(False))).groupBy("claim").agg(F.array_sort(F.collect_list(F.when(~F.col("fine"), F.concat(F.lit("GRADE_FACT_UNRESOLVED:"), "element")))).alias("failed"))
    why = F.array_compact(F.array(
        F.when(~F.col("verified"), "CLAIM_SOURCE_UNVERIFIED"), F.when(~F.col("complete"), "THREE_REPLICA_RECORDS_REQUIRED"), F.when((F.col("n_request_id") != 3) | (F.col("n") != 3), "INDEPENDENT_REQUEST_ID_REQUIRED"),
        F.when((F.col("n_provider_id") != 3) | (F.col("n") != 3), "INDEPENDENT_PROVIDER_REQUEST_ID_REQUIRED"), F.when((F.col("n_context") != 1) | (F.col("hashed") != F.col("n")), "CURRENT_CONTEXT_MISMATCH"), F.when(~F.col("fresh"), "CURRENT_FRESH_RESPONSES_REQUIRED"),
    ))
    out = r.join(failed, "claim").withColumn("reasons", F.array_sort(F.array_distinct(F.concat(why, F.col("failed")))))
    return out.select("claim", (F.size("reasons") == 0).alias("satisfied"), "reasons")


#: A single year, in the forms that are compared.
YEAR = r"^([0-9]{4})(?:\s*년(?:도)?)?$"


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(text), YEAR, 1), F.lit(""))


#: Pairs of a claim and a statement in a task.
PAIRS = 500_000
#: Verdicts (what claims of a document say, by its statements) that a task works out.
VERDICTS = 50_000


def assurance_match(claims: DataFrame, statements: DataFrame, on: Sequence[str]) -> DataFrame:
    """claim, statement, status, metric, period, boundary, reason: each opinion about each claim of the same document, never
    merged. claims: on..., claim, metric, period, entities, facilities; statements: on..., statement, level, provider,
    standard, period, metrics, entities, facilities, excluded_metrics, excluded_periods, excluded_entities,
    excluded_facilities, unresolved (arrays of texts), unread_exclusions. A claim of a document without a statement is
    undetermined. An exclusion outweighs all; covered needs a yes on each axis and a named, standard, assured opinion.

    A verdict depends on what a claim says and not on its id, so each statement meets the different claims of its document
    once, and the ids are joined to the verdicts: a pair costs a row of the result and no comparison of arrays."""
    says = ["metric", "period", "entities", "facilities"]
    key = F.to_json(F.struct(*on, *says), {"ignoreNullFields": "false"})
    known = claims.select(*on, "claim", *says).withColumn("_says", key)
    different = known.groupBy(*on, "_says").agg(*[F.first(x).alias(x) for x in says])
    counted = known.groupBy(*on).agg(F.count("*").cast("double").alias("_c"), F.count_distinct("_says").cast("double").alias("_d"))
    counted = counted.join(statements.groupBy(*on).agg(F.count("*").cast("double").alias("_s")), list(on))
    pairs, judged, docs = (x or 0 for x in counted.agg(F.sum(F.col("_c") * F.col("_s")), F.sum(F.col("_d") * F.col("_s")), F.count("*")).first())
    parts = int(min(1 << 20, judged // VERDICTS))
    if parts < 2:
        verdicts = _verdicts(different, statements, on)
    else:
        # few documents with many statements each: what their claims say is dealt out, and meets all statements everywhere
        split, keys = -(-parts // docs), [*on, "_part"]
        different = sizing.in_parts(different.withColumn("_part", F.pmod(F.hash("_says"), F.lit(split))), parts, *keys)
        everywhere = sizing.in_parts(statements.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)))), parts, *keys)
        verdicts = _verdicts(different, sizing.unsent(everywhere), keys).drop("_part")
    tasks = int(min(1 << 20, max(claims.sparkSession.sparkContext.defaultParallelism, pairs // PAIRS)))
    # the tables are small and their pairs are not, so the tasks follow the pairs
    dealt = sizing.unsent(known.select("claim", "_says").repartition(tasks, "_says"))
    return dealt.join(verdicts.drop(*on).repartition(tasks, "_says"), "_says").drop("_says")


def _verdicts(claims: DataFrame, statements: DataFrame, on: Sequence[str]) -> DataFrame:
    s = statements.select(*on, *[F.col(c).alias(f"s_{c}") for c in statements.columns if c not in on])
    x, c = claims.join(s, list(on), "left"), F.col
    clean = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda v: F.trim(v))
    one = lambda name: F.when(c(name).isNotNull() & (c(name) != ""), F.array(c(name))).otherwise(F.array().cast("array<string>"))

    def subset(own: Column, covered: Column) -> Column:
        return F.when((F.size(own) == 0) | (F.size(covered) == 0), "unknown").when(F.size(F.array_except(own, covered)) == 0, "yes").otherwise("no")

    metric = subset(clean(one("metric")), clean(c("s_metrics")))
    entity, facility = subset(clean(c("entities")), clean(c("s_entities"))), subset(clean(c("facilities")), clean(c("s_facilities")))
    own_year, year = year_of(c("period")), year_of(c("s_period"))
    period = F.when(own_year.isNull() | year.isNull(), "unknown").when(own_year == year, "yes").otherwise("no")
    boundary = F.when((entity == "no") | (facility == "no"), "no").when((entity == "yes") & (facility == "yes"), "yes").otherwise("unknown")
    x = x.withColumns({"_metric": metric, "_period": period, "_boundary": boundary})
    years = F.transform(clean(c("s_excluded_periods")), year_of)
    meets = lambda own, name: F.arrays_overlap(clean(own), clean(c(f"s_excluded_{name}")))
    excluded = meets(one("metric"), "metrics") | meets(one("period"), "periods") | meets(c("entities"), "entities") | meets(c("facilities"), "facilities") | F.coalesce(F.array_contains(F.array_compact(years), own_year), F.lit(False))
    uncertain = (F.size(clean(c("s_unresolved"))) > 0) | F.exists(years, lambda y: y.isNull()) | F.coalesce(c("s_unread_exclusions"), F.lit(False))
    no = (c("_metric") == "no") | (c("_period") == "no") | (c("_boundary") == "no")
    whole = (c("_metric") == "yes") & (c("_period") == "yes") & (c("_boundary") == "yes") & (F.coalesce(c("s_provider"), F.lit("")) != "") & (F.coalesce(c("s_standard"), F.lit("")) != "") & c("s_level").isin("limited", "reasonable")
    told = (
        F.when(c("s_statement").isNull(), "undetermined:statement_unavailable").when(F.array_contains(clean(c("s_unresolved")), "scope_group"), "undetermined:ambiguous_scope_group").when(F.coalesce(excluded, F.lit(False)), "not_covered:explicit_exclusion")
        .when(uncertain, "undetermined:unresolved_statement").when((c("s_level") == "none") | no, "not_covered:scope_mismatch_or_no_assurance").when(whole, "covered:").otherwise("undetermined:insufficient_scope_information")
    )
    unknown = lambda name: F.when(c("s_statement").isNull(), "unknown").otherwise(c(name))
    return x.select(*on, "_says", c("s_statement").alias("statement"), F.split_part(told, F.lit(":"), F.lit(1)).alias("status"), unknown("_metric").alias("metric"), unknown("_period").alias("period"), unknown("_boundary").alias("boundary"), F.nullif(F.split_part(told, F.lit(":"), F.lit(2)), F.lit("")).alias("reason"))


COUNTERS = ("pages_total", "pages_processed", "pages_unreadable", "pages_unprocessed", "chunks_discovered", "chunks_processed", "claims_discovered", "claims_decided", "claims_needs_review")


def coverage_update(runs: DataFrame) -> DataFrame:
    """runs (run_status, full_scope, stop_reason, COUNTERS) with error, status, complete and may_finish. error: the first
    invariant that the counters break (then the others are null). Unfinished work under full scope, or a spent budget, makes
    a completed run partial."""
    c = F.col
    negative = F.lit(False)
    for name in COUNTERS:
        negative = negative | c(name).isNull() | (c(name) < 0)
    error = first_reason(
        (~F.coalesce(c("run_status").isin("queued", "running", "completed", "partial", "failed", "cancelled"), F.lit(False)) | c("full_scope").isNull(), "invalid run status or scope"), (negative, "coverage counters must be non-negative integers"),
        (c("pages_processed") + c("pages_unreadable") + c("pages_unprocessed") != c("pages_total"), "page counters must partition pages_total"), (c("chunks_processed") > c("chunks_discovered"), "processed chunks exceed discovered chunks"),
        (c("claims_decided") + c("claims_needs_review") > c("claims_discovered"), "handled claims exceed discovered claims"), (F.trim("stop_reason") == "", "stop_reason must be non-empty text or null"),
    )
    done = (c("pages_unreadable") == 0) & (c("pages_unprocessed") == 0) & (c("chunks_processed") == c("chunks_discovered")) & (c("claims_decided") + c("claims_needs_review") == c("claims_discovered"))
    status = F.when(F.coalesce(c("stop_reason") == "BUDGET_EXHAUSTED", F.lit(False)) | ((c("run_status") == "completed") & c("full_scope") & ~done), "partial").otherwise(c("run_status"))
    out = runs.withColumn("error", error).withColumn("status", F.when(c("error").isNull(), status))
    complete = (c("status") == "completed") & c("full_scope") & done
    return out.withColumn("complete", F.when(c("error").isNull(), complete))


def inventory_match(claims: DataFrame, inventory: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """claims (claim, attributes...) with candidates (sorted ids) and match: unique, none, or ambiguous. Keys are the attributes
    in normal form; a claim without one of them has no key, and no candidates. inventory: candidate, attributes..."""
    key = F.array(*[T.key_form(F.col(a)) for a in attributes])
    known = lambda df: df.withColumn("_key", key).filter(~F.exists("_key", lambda x: x.isNull() | (x == "")))
    found = known(inventory).groupBy("_key").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))
    met = known(claims).select("claim", "_key").distinct().join(found, "_key").select("claim", "candidates")
    out = claims.join(met, "claim", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)))
    return out.withColumn("match", F.when(F.size("candidates") == 1, "unique").when(F.size("candidates") == 0, "none").otherwise("ambiguous"))


def prior_runs(versions: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, state and run: found with exactly one run of the version, ambiguous with more, missing with none."""
    per = runs.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("run").alias("_run"))
    out = versions.select(*keys).distinct().join(per, list(keys), "left")
    n = F.coalesce("_n", F.lit(0))
    return out.select(*keys, F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous").alias("state"), F.when(n == 1, F.col("_run")).alias("run"))


def track_packet(packets: DataFrame, elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, track, elements (sorted) and packet_sha256: a packet (keys, track, element, source) cut to its track's elements and
    hashed anew. elements: track, element, of the rule pack; a packet of which nothing is left keeps an empty list."""
    own = packets.join(elements.withColumn("_own", F.lit(True)), ["track", "element"], "left")
    out = own.groupBy(*keys, "track").agg(F.array_sort(F.collect_set(F.when(F.col("_own"), F.struct("element", F.col("source").cast("string").alias("source"))))).alias("elements"))
    return out.withColumn("packet_sha256", F.sha2(F.array_join(F.transform("elements", lambda x: F.concat_ws(":", x["element"], x["source"])), "|"), 256))


#: Fields that what a model says may not carry.
FORBIDDEN = ("evidence_grade", "label", "sublabel", "decision_status")


def carries(json: Column, fields: Sequence[str] = FORBIDDEN) -> Column:
    """Has the JSON text one of the fields as a key, at any depth? Inside a text value, quotation marks are escaped."""
    return F.regexp_replace(json, r"\\\\", "").rlike(r'(?<!\\)"(?:' + "|".join(fields) + r')"\s*:')


#: Errors that pass, attempts, and the longest wait that a provider may ask for.
TRANSIENT, MOST_ATTEMPTS, LONGEST_WAIT = ("MODEL_THROTTLED", "PROVIDER_5XX", "MODEL_TIMEOUT", "NOTE_ACCOUNTING_PENDING"), 3, 60


def failed_jobs(jobs: DataFrame) -> DataFrame:
    """jobs (job, run, error_code, attempt, now, jitter, retry_after, others_succeeded) with status, next_attempt_at and
    run_status. A passing error is tried again after what the provider asks (at most a minute) or after 2^attempt times the
    jitter; the run then goes on, else it is partial if any of its jobs has succeeded."""
    c = F.col
    again = F.coalesce(c("error_code").isin(*TRANSIENT) & (c("attempt") < MOST_ATTEMPTS), F.lit(False))
    delay = F.when(c("retry_after").isNotNull(), F.least(F.lit(LONGEST_WAIT), c("retry_after")).cast("double")).otherwise(F.pow(F.lit(2.0), c("attempt")) * c("jitter"))
    bad = ~F.coalesce(c("jitter").between(0, 1), F.lit(False))
    out = jobs.withColumn("status", F.when(bad, "invalid_jitter").when(again, "pending").otherwise("failed"))
    out = out.withColumn("next_attempt_at", F.when(~bad, c("now") + delay))
    return out.withColumn("run_status", F.when(bad, None).when(again, "running").when(c("others_succeeded"), "partial").otherwise("failed"))


def marked(outbox: DataFrame, reports: DataFrame) -> DataFrame:
    """The outbox (event_id, status, attempts, due) after the relay's reports (event_id, now, sent, expected). A report counts
    if the event is pending and has had the attempts it expects, one report per event (the earliest, then the sent one); the
    event is then sent, or waits 2^attempts seconds, a minute at most. applied tells which events changed."""
    first = reports.groupBy("event_id", "expected").agg(F.min(F.struct("now", (~F.col("sent")).alias("late"))).alias("_r")).select(F.col("event_id").alias("_event"), "expected", F.col("_r.now").alias("now"), (~F.col("_r.late")).alias("sent"))
    x, c = outbox.join(first, (F.col("event_id") == F.col("_event")) & (F.col("attempts") == F.col("expected")) & (F.col("status") == "pending"), "left"), F.col
    met = c("expected").isNotNull()
    n = c("expected") + 1
    wait = F.least(F.lit(60), F.pow(F.lit(2), F.least(n, F.lit(6))).cast("int"))
    return x.select("event_id", F.when(met & c("sent"), "sent").otherwise(c("status")).alias("status"), F.when(met, n).otherwise(c("attempts")).alias("attempts"), F.when(met, c("now") + wait).otherwise(c("due")).alias("due"), met.alias("applied"))


def report_rows(refs: DataFrame, decisions: DataFrame, labels: dict[str, str], packs: DataFrame) -> DataFrame:
    """A report's rows: claim, revision, state, grade, label, error. refs: claim, tag_revision, decision_revision of every
    discovered claim; decisions: claim, tag_revision, decision_revision, status, grade, label, pack; packs: pack (hashes that
    the report pins). Every claim has one row: unfinished where it has no decision yet; a row that is not what the report may
    show has an error and nothing else. labels: the fixed label of each grade."""
    c = F.col
    twice = refs.groupBy("claim").agg(F.count("*").alias("_n"))
    d = decisions.select("claim", F.col("tag_revision").alias("d_tag"), F.col("decision_revision").alias("d_revision"), "status", "grade", "label", "pack").dropDuplicates(["claim", "d_tag", "d_revision"])
    x = refs.join(twice, "claim").join(d, (refs["claim"] == d["claim"]) & (refs["tag_revision"] == d["d_tag"]) & (refs["decision_revision"] == d["d_revision"]), "left").drop(d["claim"])
    x = x.join(packs.withColumn("_pinned", F.lit(True)), "pack", "left")
    known = F.create_map(*[F.lit(v) for k, name in labels.items() for v in (k, name)])
    revisions = (c("tag_revision") < 0) | (c("decision_revision") < 0) | ((c("decision_revision") > 0) & (c("tag_revision") < 1))
    decided = c("status") == "decided"
    error = first_reason(
        (revisions | (c("_n") > 1), "invalid or duplicate claim revision reference"), ((c("decision_revision") > 0) & c("d_revision").isNull(), "decision does not match the pinned revision"), ((c("decision_revision") > 0) & c("_pinned").isNull(), "decision rule pack is not pinned"),
        (decided & ~F.coalesce(c("label") == known[c("grade")], F.lit(False)), "decided claim needs the fixed grade and label"), (~decided & (c("grade").isNotNull() | c("label").isNotNull()), "unfinished decision cannot carry a grade or label"),
    )
    state = F.when(c("decision_revision") == 0, "unfinished").otherwise(c("status"))
    shown = lambda v: F.when(c("error").isNull(), v)
    return x.withColumn("error", error).select(refs["claim"], "decision_revision", shown(state).alias("state"), shown(c("grade")).alias("grade"), shown(c("label")).alias("label"), "error").distinct()


def scoped_decisions(decisions: DataFrame, scopes: DataFrame, facts: DataFrame, policies: Sequence[str]) -> DataFrame:
    """decisions (claim, doc, status, grade) with confirmed, basis and reason: may absence inside a declared scope stand? scopes:
    claim, doc, run, selected (array of pages), inspected, policy, absent (array of fact names), receipt; facts: claim, fact,
    state. A scope counts if it is of the claim's document, its pages were all looked at, it follows a known policy, it names
    just the facts that are absent, and no fact is in conflict; a decision that is not decided stays what it is."""
    f = facts.groupBy("claim").agg(F.array_sort(F.collect_set(F.when(F.col("state") == "absent_in_scope", F.col("fact")))).alias("_absent"), F.bool_or(F.col("state") == "conflict").alias("_conflict"))
    s = scopes.select("claim", F.col("doc").alias("_doc"), "run", "selected", "inspected", "policy", F.array_sort(F.array_distinct("absent")).alias("_named"), "receipt")
    x, c = decisions.join(s, "claim", "left").join(f, "claim", "left"), F.col
    none = F.array().cast("array<string>")
    reason = first_reason(
        (c("_doc").isNull(), "scope_missing"), (c("_doc") != c("doc"), "scope_of_another_document"), (c("run").isNull() | (c("run") == ""), "run_missing"), (F.coalesce(F.size("selected"), F.lit(0)) <= 0, "no_pages_selected"), (differs(c("inspected"), c("selected")), "pages_not_inspected"),
        (~F.coalesce(c("policy").isin(*policies), F.lit(False)), "policy_unknown"), (F.coalesce(c("_conflict"), F.lit(False)), "fact_in_conflict"), (F.size(F.coalesce("_named", none)) == 0, "no_absent_facts"), (differs(F.coalesce("_named", none), F.coalesce("_absent", none)), "absent_facts_differ"),
    )
    fine = reason.isNull() & (c("status") == "decided")
    basis = F.when(fine, F.sha2(F.to_json(F.struct("claim", "doc", "run", "selected", "policy", "_named", "receipt", "status", "grade")), 256))
    return x.select(*decisions.columns, fine.alias("confirmed"), basis.alias("basis"), reason.alias("reason"))
