"""Consensus of three votes per claim and element. Disagreement is kept, never outvoted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(votes: DataFrame, keys: Sequence[str], *, required: int = 2) -> DataFrame:
    """votes: keys, replicate, state, value, verified. Any conflict wins; other than three votes, or an unreadable or
    missing one, is unknown; differing verified answers conflict; `required` equal verified ones stand; else unknown."""
    valid = F.col("state").isin("present", "absent") & F.col("verified")
    answer = F.when(valid, F.struct("state", F.coalesce("value", F.lit("")).alias("value")))
    agg = votes.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_or(F.col("state") == "conflict").alias("any_conflict"), F.bool_or(F.col("state").isin("unreadable", "missing")).alias("lost"),
        F.count_if(valid).alias("valid"), F.min(answer).alias("low"), F.max(answer).alias("high"),
    )
    resolved = (
        F.when(F.col("any_conflict"), "conflict").when((F.col("n") != 3) | F.col("lost"), "unknown").when(F.col("low") != F.col("high"), "conflict")
        .when(F.col("valid") >= required, F.col("low")["state"]).otherwise("unknown")
    )
    return agg.select(*keys, resolved.alias("resolved"), "valid")


def strict_consensus(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Majority as a review candidate, confirmation only if all three replicates agree and none is unknown or in
    conflict. With three votes a majority of two is unique, so no tie can arise."""
    per = votes.groupBy(*keys, "state", F.coalesce("value", F.lit("")).alias("value")).agg(F.count_distinct("replicate").alias("votes"))
    best = per.groupBy(*keys).agg(F.max(F.struct("votes", "state", "value")).alias("best"), F.sum("votes").alias("all"), F.bool_or(F.col("state").isin("unknown", "conflict")).alias("open"))
    majority = F.when(F.col("best")["votes"] >= 2, F.col("best")["state"])
    confirmed = (F.col("best")["votes"] == 3) & (F.col("all") == 3) & ~F.col("open")
    return best.select(*keys, majority.alias("candidate"), F.col("best")["votes"].alias("agreement"), confirmed.alias("confirmed"))


def inventory_state(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Conflict before all; unanimous positives are present; an uncovered source is unknown; else absent in the scope."""
    agg = votes.groupBy(*keys).agg(F.bool_or(F.col("state") == "conflict").alias("c"), F.bool_and(F.col("state") == "present").alias("p"), F.bool_or(F.col("state").isin("unknown", "missing")).alias("u"), F.bool_or(F.col("state") == "present").alias("some"))
    return agg.select(*keys, F.when(F.col("c") | (F.col("some") & ~F.col("p") & ~F.col("u")), "conflict").when(F.col("p"), "present").when(F.col("u"), "unknown").otherwise("absent_in_scope").alias("inventory"))


#: Profiles of partial_facts: is a unanimous conflict kept, and one that only some replicas could report?
PROFILES = {"v1": (False, False), "v2": (True, False), "v3": (True, True)}


def partial_facts(votes: DataFrame, keys: Sequence[str], profile: str = "v3", replicas: int = 3) -> DataFrame:
    """keys, state, agreement of each element that guarded replicas voted on. votes: keys, replicate, state, value,
    binding, scope, verified, a row per replicate that did not fail. Several different votes are a conflict; a failed
    replicate leaves the element unknown; present needs every vote bound and verified; and as no vote has authority over
    what was not found, absence stays unknown."""
    unanimous, surviving = PROFILES[profile]
    ballot = ["state", "value", "binding", "scope"]
    cells = votes.groupBy(*keys, *ballot).agg(F.count("*").alias("n"), F.bool_and(F.coalesce("verified", F.lit(False))).alias("fine"))
    per = cells.groupBy(*keys).agg(
        F.count("*").alias("_kinds"), F.sum("n").alias("_votes"), F.max("n").alias("agreement"), F.bool_or(F.col("state") == "conflict").alias("_conflict"), F.min("state").alias("_state"),
        F.bool_and(F.col("binding").isNotNull()).alias("_bound"), F.bool_and("fine").alias("_fine"),
    )
    state = (
        F.when(F.col("_kinds") > 1, "conflict").when(F.lit(surviving) & F.col("_conflict"), "conflict").when(F.col("_votes") < replicas, "unknown").when((F.col("_state") == "present") & F.col("_bound") & F.col("_fine"), "present")
        .when(F.lit(unanimous) & F.col("_conflict"), "conflict").otherwise("unknown")
    )
    return per.select(*keys, state.alias("state"), "agreement")
