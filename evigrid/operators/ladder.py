"""Decision ladders over facts whose states are kept apart: present, absent, unknown, conflict.

A ladder is a small table of branches. Facts that are neither present nor absent are open; every reachable grade is
found by letting each open fact be true and false (2^n worlds), which is an explode of a sequence, not a join. A ladder
of more than MOST_FACTS facts is refused. Branch evaluation is one CASE expression per world.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_FACTS = 12


@dataclass(frozen=True)
class Branch:
    name: str
    grade: str
    when: tuple[tuple[str, bool], ...]
    cap: bool = False


def branch(name: str, grade: str, true: Sequence[str] = (), false: Sequence[str] = (), cap: bool = False) -> Branch:
    return Branch(name, grade, tuple((f, True) for f in true) + tuple((f, False) for f in false), cap)


#: The facts of each track in ladder order, and its branches.
GOAL_FACTS = ("target_year", "target_metric", "baseline_year", "baseline_value", "scope", "org_boundary", "current_progress", "transition_plan")
PERFORMANCE_FACTS = ("quantitative_or_qualified_ordinal", "unit_or_qualified_ordinal", "comparison_baseline", "calculation_boundary", "method", "assurance_covered")
MANAGEMENT_FACTS = ("named_means_or_concrete_state", "org_boundary", "external_verification", "willingness_only")
LADDERS: dict[str, tuple[tuple[str, ...], tuple[Branch, ...]]] = {
    "goal": (
        GOAL_FACTS,
        (
            branch("GOAL_NO_YEAR_EXCEPTION", "E1", ["target_metric", "transition_plan"], ["target_year"], cap=True),
            branch("GOAL_NO_YEAR", "E0", [], ["target_year", "exception_applies"]),
            branch("GOAL_E3", "E3", GOAL_FACTS),
            branch("GOAL_E2", "E2", GOAL_FACTS[:6]),
            branch("GOAL_E1", "E1", GOAL_FACTS[:2]),
        ),
    ),
    "performance": (
        PERFORMANCE_FACTS,
        (
            branch("PERF_NO_VALUE", "E0", [], PERFORMANCE_FACTS[:1]),
            branch("PERF_E3", "E3", PERFORMANCE_FACTS),
            branch("PERF_E2", "E2", PERFORMANCE_FACTS[:4]),
            branch("PERF_E1", "E1", PERFORMANCE_FACTS[:2]),
        ),
    ),
    "management": (
        MANAGEMENT_FACTS,
        (
            branch("MGMT_E3", "E3", MANAGEMENT_FACTS[:3]),
            branch("MGMT_E2", "E2", MANAGEMENT_FACTS[:2]),
            branch("MGMT_E1", "E1", MANAGEMENT_FACTS[:1]),
            branch("MGMT_WILLINGNESS", "E0", MANAGEMENT_FACTS[3:]),
        ),
    ),
}
#: Published labels of the grades.
LABELS = {"E0": "UNSUBSTANTIATED", "E1": "INCOMPLETE", "E2": "INCOMPLETE", "E3": "SUBSTANTIATED"}


def grade_of(truth: Mapping[str, Column], branches: Sequence[Branch]) -> Column:
    """The first matching cap branch in order, else the greatest matching grade (then branch name), else null."""
    truth = dict(truth)
    if "target_metric" in truth and "transition_plan" in truth:
        truth["exception_applies"] = truth["target_metric"] & truth["transition_plan"]

    def holds(b: Branch) -> Column:
        out = F.lit(True)
        for fact, value in b.when:
            out = out & (truth[fact] if value else ~truth[fact])
        return out

    caps = None
    before: list[Branch] = []
    for b in branches:
        if b.cap:
            caps = F.when(holds(b), b.grade) if caps is None else caps.when(holds(b), b.grade)
        else:
            before.append(b)
    best = F.lit(None).cast("string")
    for b in sorted(before, key=lambda b: (b.grade, b.name)):
        best = F.when(holds(b), b.grade).otherwise(best)
    return best if caps is None else caps.otherwise(best)


#: The facts behind each element of a track, elements that count only with a trigger, and those beyond the ladder.
ELEMENTS: dict[str, dict[str, tuple[str, ...]]] = {
    "goal": {"G1": ("target_year",), "G2": ("target_metric",), "G3": ("baseline_year", "baseline_value"), "G4": ("scope", "org_boundary"), "G5": ("current_progress",), "G6": ("transition_plan",), "G7": ("offset_plan",), "G8": ("science_based_verification",)},
    "performance": {"P1": ("quantitative_or_qualified_ordinal", "unit_or_qualified_ordinal"), "P2": ("comparison_baseline",), "P3": ("method", "calculation_boundary"), "P4": ("assurance_covered",), "P5": ("absolute_intensity",), "P6": ("numerical_check",)},
    "management": {"M1": ("named_means_or_concrete_state",), "M2": ("org_boundary",), "M3": ("external_verification",), "M4": ("concrete_implementation_detail",), "M5": ("responsible_organization",), "M6": ("compensation_link",)},
}
TRIGGERS = {"G7": "offset_or_carbon_neutral_claim", "G8": "science_based_claim", "P5": "reduction_or_improvement_claim", "M5": "governance_claim", "M6": "compensation_link_claim"}
SUPERLATIVE_OPERANDS = ("comparison_basis", "external_verification")
PRODUCT_CAP, PRODUCT_DIRECT = "E1", "direct_product_material_ratio_or_target"


def state_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("unknown"))


def _names(*pairs: tuple[Column, Column | str]) -> Column:
    """The values whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(when, F.lit(v) if isinstance(v, str) else v) for when, v in pairs])).cast("array<string>")


def elements(track: str) -> tuple[Column, Column, Column]:
    """(missing, unresolved, excluded) element names: an absent trigger excludes an element, an open one leaves it open."""
    missing, unresolved, excluded = [], [], []
    for element, names in ELEMENTS[track].items():
        states = F.array(*[state_of(n) for n in names])
        open_fact = F.exists(states, lambda x: ~x.isin("present", "absent"))
        trigger = state_of(TRIGGERS[element]) if element in TRIGGERS else F.lit("present")
        out = trigger == "absent"
        unsure = ~out & ((trigger != "present") | open_fact)
        excluded.append((out, element))
        unresolved.append((unsure, element))
        missing.append((~out & ~unsure & F.exists(states, lambda x: x == "absent"), element))
    return _names(*missing), _names(*unresolved), _names(*excluded)


def exceptions(track: str) -> Column:
    """struct<override, cap, gaps, unresolved, rules, ordinal> of what stands before the ladder: a safe harbor, then a
    superlative without comparison and verification, then categorical ordinals (performance) and product variants.
    Columns: safe_harbor_category, superlative_quote, superlative_bound (the quote stands in the fact's own sources),
    product_variant, and the states that the rules name."""
    said = F.coalesce(F.trim("superlative_quote") != "", F.lit(False))
    superlative = said | (F.col("has_superlative").isNotNull() & (F.col("has_superlative") != "absent"))
    bound = (state_of("has_superlative") == "present") & said & F.coalesce("superlative_bound", F.lit(False))
    states = [state_of(n) for n in SUPERLATIVE_OPERANDS]
    none, some = (states[0] == "absent") & (states[1] == "absent"), (states[0] == "present") | (states[1] == "present")
    override = superlative & bound & none
    open_superlative = [(superlative & ~bound, "has_superlative"), *[(superlative & bound & ~none & ~some & (x != "absent"), n) for x, n in zip(states, SUPERLATIVE_OPERANDS, strict=True)]]
    product = F.coalesce("product_variant", F.lit(False))
    rules, gaps, unresolved, cap = [], [], list(open_superlative), F.lit(None).cast("string")
    ordinal = F.lit(None).cast("string")
    if track == "performance":
        a, b = state_of("categorical_ordinal"), state_of("certification_provider")
        asked = F.col("categorical_ordinal").isNotNull()
        ordinal = F.when(asked, F.when((a == "present") & (b == "present"), "present").when((a == "absent") | (b == "absent"), "absent").when((a == "conflict") | (b == "conflict"), "conflict").otherwise("unknown"))
        rules.append((asked, "CATEGORICAL_ORDINAL"))
    if track == "management":
        direct = state_of(PRODUCT_DIRECT)
        cap = F.when(product & (direct == "absent"), PRODUCT_CAP)
        rules.append((product & (direct == "absent"), "PRODUCT_NAMES_CAP"))
        gaps.append((product & (direct == "present"), "GAP-007"))
        unresolved.append((product & ~direct.isin("present", "absent"), PRODUCT_DIRECT))
    else:
        gaps.append((product, "GAP-007"))
    nothing, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    effect = lambda override, cap, gaps, unresolved, rules, ordinal: F.struct(override.alias("override"), cap.alias("cap"), gaps.alias("gaps"), unresolved.alias("unresolved"), rules.alias("rules"), ordinal.alias("ordinal"))
    harbor = effect(text, text, _names((F.lit(True), "GAP-001"), (superlative, "GAP-006")), nothing, nothing, text)
    over = effect(F.lit("E0"), text, nothing, nothing, F.array(F.lit("SUPERLATIVE_E0")).cast("array<string>"), text)
    return F.when(F.col("safe_harbor_category").isNotNull(), harbor).when(override, over).otherwise(effect(text, cap, _names(*gaps), _names(*unresolved), _names(*rules), ordinal))


def reachable(facts: DataFrame, key: str, track: str) -> DataFrame:
    """key, grades (all that are reachable, ascending), gap (no branch holds in some world) and worlds."""
    names, branches = LADDERS[track]
    if len(names) > MOST_FACTS:
        raise ValueError("the ladder has too many facts")
    state = {n: state_of(n) for n in names}
    open_facts = F.filter(F.array(*[F.when(~state[n].isin("present", "absent"), n) for n in names]), lambda x: x.isNotNull())
    each = facts.withColumn("_open", open_facts).withColumn("_n", F.size("_open"))
    each = each.withColumn("_world", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("_n")).cast("int") - 1)))
    truth = {n: F.when(state[n] == "present", True).when(state[n] == "absent", False).otherwise(F.expr(f"getbit(_world, array_position(_open, '{n}') - 1) = 1")) for n in names}
    worlds = each.select(F.col(key), F.col("_n"), grade_of(truth, branches).alias("_grade"))
    return worlds.groupBy(key).agg(F.array_sort(F.collect_set("_grade")).alias("grades"), F.bool_or(F.col("_grade").isNull()).alias("gap"), F.count("*").alias("worlds"))


def decide(facts: DataFrame, key: str, track: str) -> DataFrame:
    """facts: key and one state column per fact. Returns key, status, grade, label, floor, ceiling and worlds: decided if
    one grade is reachable, blocked_evidence if several are, blocked_rule_gap if none is."""
    out = reachable(facts, key, track)
    several = (F.size("grades") + F.col("gap").cast("int")) > 1
    out = out.withColumn("status", F.when(several, "blocked_evidence").when(F.size("grades") == 0, "blocked_rule_gap").otherwise("decided"))
    grade = F.when(F.col("status") == "decided", F.element_at("grades", 1))
    ranged = (F.col("status") == "blocked_evidence") & ~F.col("gap") & (F.size("grades") > 1)
    label = F.create_map([F.lit(x) for k, v in LABELS.items() for x in (k, v)])
    return out.select(key, "status", grade.alias("grade"), label[grade].alias("label"), F.when(ranged, F.element_at("grades", 1)).alias("floor"), F.when(ranged, F.element_at("grades", -1)).alias("ceiling"), "worlds")


def decisions(tags: DataFrame, key: str, track: str) -> DataFrame:
    """The whole decision: the ladder under its exceptions. tags: key, one row each; states of the track's facts, elements
    and triggers; the columns of exceptions(). Returns key, status, grade, label, sublabel, floor, ceiling, gaps,
    missing, unresolved, excluded and rules."""
    missing, unresolved, excluded = elements(track)
    x = tags.withColumn("_e", exceptions(track))
    if track == "performance":  # a qualified ordinal stands for the value and its unit
        for name in ELEMENTS[track]["P1"]:
            x = x.withColumn(name, F.coalesce("_e.ordinal", state_of(name)))
    x = x.withColumn("_missing", missing).withColumn("_unresolved", unresolved).withColumn("_excluded", excluded)
    out = x.join(reachable(x, key, track), key)
    capped = F.array_sort(F.array_distinct(F.transform("grades", lambda g: F.least(g, F.coalesce("_e.cap", g)))))
    out = out.withColumn("grades", capped)
    several = (F.size("grades") + F.col("gap").cast("int")) > 1
    open_elsewhere, ruled_out = F.size("_e.unresolved") > 0, F.size("_e.gaps") > 0
    base = F.when(several, "blocked_evidence").when(F.size("grades") == 0, "blocked_rule_gap").otherwise("decided")
    status = F.when(ruled_out, "blocked_rule_gap").when(open_elsewhere, "blocked_evidence").when(F.col("_e.override").isNotNull(), "decided").otherwise(base)
    out = out.withColumn("status", status).withColumn("unresolved", F.concat("_unresolved", "_e.unresolved"))
    grade = F.when(F.col("status") == "decided", F.coalesce("_e.override", F.when(~several, F.element_at("grades", 1))))
    out = out.withColumn("grade", grade)
    ranged = (F.col("status") == "blocked_evidence") & ~F.col("gap") & (F.size("grades") > 1) & ~open_elsewhere & ~ruled_out
    label = F.create_map([F.lit(v) for k, l in LABELS.items() for v in (k, l)])
    sample = F.lit(False)
    if track == "goal":  # the one example that has a label of its own
        names = [n for e in ("G3", "G4", "G5", "G6") for n in ELEMENTS[track][e]]
        all_absent = F.lit(True)
        for n in names:
            all_absent = all_absent & (state_of(n) == "absent")
        sample = (F.col("grade") == "E1") & all_absent & (F.concat_ws(",", "_missing") == "G3,G4,G5,G6") & (F.size("unresolved") == 0) & (F.concat_ws(",", "_excluded") == "G7,G8")
    sample = F.coalesce(sample, F.lit(False))
    no_branch = (base == "blocked_rule_gap") & F.col("_e.override").isNull()
    gaps = F.array_sort(F.array_distinct(F.concat(F.col("_e.gaps"), _names((no_branch, "GAP-007"), (F.col("grade").isin("E1", "E2") & ~sample, "GAP-005")))))
    return out.select(
        key, "status", "grade", label[F.col("grade")].alias("label"), F.when(sample, "IMPL").alias("sublabel"), F.when(ranged, F.element_at("grades", 1)).alias("floor"), F.when(ranged, F.element_at("grades", -1)).alias("ceiling"),
        gaps.alias("gaps"), F.col("_missing").alias("missing"), "unresolved", F.col("_excluded").alias("excluded"), F.col("_e.rules").alias("rules"),
    )
