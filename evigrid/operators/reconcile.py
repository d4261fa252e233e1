"""Two-sided reconciliation: ordered gates, where the first failure is the reason.

Each item is one CASE over the packet's columns: state, status, reasons and cited sources come from the same first
matching line. The policy stands before anything the packet says, so no claim can get round it. The reason codes are
fixed values: they are published results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigrid.operators import sets


@dataclass(frozen=True)
class Arm:
    """One line of an item: when it holds, its outcome. reasons and cited are columns (arrays of texts) or a reason."""

    when: Column
    state: str
    status: str | None
    reasons: Column | str
    cited: Column | None = None


def _texts(x: Column | str | None) -> Column:
    x = F.array() if x is None else F.array(F.lit(x)) if isinstance(x, str) else x
    return x.cast("array<string>")


def cascade(df: DataFrame, arms: Sequence[Arm]) -> DataFrame:
    """df with execution_state, status, reason (the first), reasons, cited and review_required of the first arm that holds."""
    out = None
    for arm in arms:
        row = F.struct(F.lit(arm.state).alias("execution_state"), F.lit(arm.status).cast("string").alias("status"), _texts(arm.reasons).alias("reasons"), _texts(arm.cited).alias("cited"))
        when = F.coalesce(arm.when, F.lit(False))
        out = F.when(when, row) if out is None else out.when(when, row)
    done = df.withColumn("_o", out).select(*df.columns, "_o.execution_state", "_o.status", F.element_at("_o.reasons", 1).alias("reason"), "_o.reasons", "_o.cited")
    return done.withColumn("review_required", F.col("execution_state") != "completed")


def source_ids(first: Column, second: Column, cited: Column) -> Column:
    """The sides' sources and then the cited ones, in order, each once."""
    return F.array_distinct(F.array_compact(F.concat(F.array(first, second), cited)))


def blocked(when: Column, reason: Column | str, cited: Column | None = None) -> Arm:
    return Arm(when, "blocked", None, reason, cited)


def completed(when: Column, status: str, reason: Column | str, cited: Column | None = None) -> Arm:
    return Arm(when, "completed", status, reason, cited)


def policy_gate(kinds: Sequence[str]) -> list[Arm]:
    """The policy (approved, stage, synthetic_only, enabled), then the packet (synthetic, comparability, left_kind,
    right_kind, left_value, right_value). kinds: those that the item compares."""
    left, right = F.col("left_kind"), F.col("right_kind")
    return [
        blocked(~F.col("approved"), "policy_unapproved"), blocked(F.col("stage") != 1, "stage_not_supported"), blocked(F.col("synthetic_only") & ~F.col("synthetic"), "synthetic_policy_real_packet"),
        blocked(~F.col("enabled"), "item_not_enabled"), completed(F.col("comparability") == "not_comparable", "not_applicable", "not_comparable"), blocked(F.col("comparability") == "unknown", "comparability_unknown"),
        blocked(~left.eqNullSafe(right), "kind_mismatch"), blocked(left == "unknown", "value_unresolved"),
    ] + _own_kind(kinds)


def _own_kind(kinds: Sequence[str]) -> list[Arm]:
    return [blocked(~F.col("left_kind").isin(*kinds), "kind_mismatch"), blocked(F.col("left_value").isNull() | F.col("right_value").isNull(), "value_unresolved")]


def difference_ladder(explained: str, cited: Column | None = None) -> list[Arm]:
    """explanation: the id of the source that explains the difference, or null."""
    before = _texts(cited)
    return [
        completed(F.col("explanation").isNotNull(), "matched", explained, F.concat(before, F.array(F.col("explanation").cast("string")))),
        completed(F.col("search_complete"), "needs_explanation", "explanation_not_found", cited), blocked(F.lit(True), "search_incomplete", cited),
    ]


def entities_item() -> list[Arm]:
    """C1: two sets of entities (left_value, right_value) over the same period and consolidation."""
    a, b = F.col("left_value"), F.col("right_value")
    period, financial = [F.col("period_start"), F.col("period_end")], [F.col("financial_start"), F.col("financial_end")]
    unknown = period[0].isNull() | period[1].isNull() | financial[0].isNull() | financial[1].isNull()
    return [
        *policy_gate(["entity_set", "facility_set"]), blocked(unknown, "c1_period_unresolved"), blocked((period[0] != financial[0]) | (period[1] != financial[1]), "c1_period_mismatch"),
        blocked(F.col("consolidation") == "unknown", "c1_consolidation_unknown"), blocked((F.size(a) == 0) | (F.size(b) == 0), "entity_set_empty"),
        completed(sets.same_set(a, b), "matched", "same_verified_entity_set"), *difference_ladder("difference_explained"),
    ]


def periods_item() -> list[Arm]:
    """C2: two measured periods, and the reporting period (null if not declared), as structs of start and end."""
    a, b = F.col("left_value"), F.col("right_value")
    outside = (a["end"] < F.col("period_start")) | (a["start"] > F.col("period_end"))
    equal = (a["start"] == b["start"]) & (a["end"] == b["end"])
    return [*policy_gate(["period"]), completed(outside, "not_applicable", "period_out_of_scope"), completed(equal, "matched", "same_period"), *difference_ladder("period_difference_explained")]


def spending_item(within: Column) -> list[Arm]:
    """C3: a commitment (left_value) against capital expenditure (right_value), both decimals. within: whether the
    commitment is within the threshold; the policy's threshold may be null."""
    cited = F.array_compact(F.array(F.col("commitment_source"), F.col("funding_source")))
    gate, own = policy_gate(["currency_amount"]), _own_kind(["currency_amount"])
    accounts = F.col("accounts_approved") & (F.size("allowed_accounts") > 0) & (F.size("accounts") > 0) & (F.size(F.array_except("accounts", "allowed_accounts")) == 0)
    period = [F.col(c).isNull() for c in ("target_start", "target_end", "capex_start", "capex_end", "financial_start", "financial_end")]
    unknown = period[0]
    for p in period[1:]:
        unknown = unknown | p
    return [
        *gate[: -len(own)], completed(~((F.col("track") == "goal") & F.col("triggered")), "not_applicable", "c3_trigger_absent"), *[Arm(x.when, x.state, x.status, x.reasons, cited) for x in own],
        blocked(~(F.col("left_unit").eqNullSafe(F.col("currency")) & F.col("right_unit").eqNullSafe(F.col("currency"))), "c3_currency_mismatch", cited), blocked(~accounts, "c3_policy_unapproved", cited),
        blocked(unknown, "c3_period_unresolved", cited), blocked((F.col("capex_start") != F.col("financial_start")) | (F.col("capex_end") != F.col("financial_end")), "c3_capex_period_mismatch", cited),
        blocked(F.col("left_value") <= 0, "c3_commitment_not_positive", cited), blocked(F.col("right_value") <= 0, "c3_capex_not_positive", cited),
        completed(F.col("commitment_source").isNotNull(), "matched", "commitment_disclosed", cited), blocked(F.col("threshold").isNull(), "c3_policy_unapproved", cited),
        completed(within, "matched", "capex_within_threshold", cited), *difference_ladder("difference_explained", cited),
    ]


def definition_item() -> list[Arm]:
    """C4: definition_sources and calculation_sources are arrays of ids; required names the explanations that the policy
    wants, in order. Every missing one is a reason."""
    found = F.create_map(F.lit("definition"), F.coalesce("definition_sources", F.array().cast("array<string>")), F.lit("calculation_basis"), F.coalesce("calculation_sources", F.array().cast("array<string>")))
    cited = F.array_distinct(F.flatten(F.transform("required", lambda r: found[r])))
    missing = F.transform(F.filter("required", lambda r: F.size(found[r]) == 0), lambda r: F.concat(r, F.lit("_not_found")))
    return [
        *policy_gate(["classification"]), completed(F.size(missing) == 0, "matched", "classification_basis_present", cited), blocked(~F.col("search_complete"), "search_incomplete", cited),
        completed(F.lit(True), "needs_explanation", missing, cited),
    ]
