"""Conflict resolution: many matched obligations to one effective policy per resource.

Resources that fit the same shapes of obligations share one policy, so the folds run once per distinct
rule set and only numbers of shapes travel with the resources.

A fold takes the name of a column that holds the rules of one domain as an array of
struct(ord, id, title, source_id, <rule>) in ``ord`` order, and gives the SQL of the effective rule.
New domains can be added to ``RESOLVERS``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.operators.joins import null_safe_join
from govspark.operators.match import match_shapes
from govspark.session import materialize

_STRINGS = "array<string>"


def _let(name: str, value: str, body: str) -> str:
    """SQL that names a value inside an expression, so that it is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _reason(rule: str, description: str) -> str:
    return (
        f"named_struct('winning_obligation_id', {rule}.id, 'winning_source_id', {rule}.source_id, "
        f"'description', {description})"
    )


def _union_of(rules: str, field: str) -> str:
    return f"array_sort(array_distinct(flatten(transform({rules}, r -> coalesce(r.{field}, array())))))"


def resolve_retention(rules: str) -> str:
    """Shortest duration; the earliest rule wins a tie."""
    ranked = f"transform({rules}, r -> named_struct('d', r.retention.duration_s, 'o', r.ord, 'r', r))"
    text = (
        f"concat('Applied strictest retention limit from ''', w.title, '''. Calculated shortest duration among ', "
        f"size({rules}), ' competing rules.')"
    )
    return _let(
        "w",
        f"array_min({ranked}).r",
        "named_struct('duration_s', w.retention.duration_s, 'is_indefinite', false, 'trigger', w.retention.trigger, "
        f"'reason', {_reason('w', text)})",
    )


def _narrow(rules: str, allowed: str, wins_before: str = "false") -> str:
    """Left-to-right intersection of the non-empty allow lists, with the position that last narrowed it.

    Gives struct(seen, kept, winner, i). ``wins_before`` marks rules that also take the win while nothing
    is allowed yet.
    """
    restricts = f"coalesce(size(r.{allowed}), 0) > 0"
    after = f"CASE WHEN acc.seen THEN array_intersect(acc.kept, r.{allowed}) ELSE array_distinct(r.{allowed}) END"
    wins = (
        f"({restricts} AND (NOT acc.seen OR size(next) < size(acc.kept))) "
        f"OR ({wins_before} AND (NOT acc.seen OR size(acc.kept) = 0))"
    )
    step = (
        f"named_struct('seen', acc.seen OR {restricts}, 'kept', CASE WHEN {restricts} THEN next ELSE acc.kept END, "
        f"'winner', CASE WHEN {wins} THEN acc.i ELSE acc.winner END, 'i', acc.i + 1)"
    )
    start = "named_struct('seen', false, 'kept', cast(array() AS array<string>), 'winner', 0, 'i', 0)"
    return f"aggregate({rules}, {start}, (acc, r) -> {_let('next', after, step)})"


def resolve_geofencing(rules: str) -> str:
    """Intersection of allow lists minus the union of deny lists; nothing left is a global ban."""
    text = (
        f"concat('Calculated intersection of ', size({rules}), ' geofencing rules. ', size(denied), "
        "' regions explicitly denied.', CASE WHEN ban THEN ' RESULT: GLOBAL BAN (Intersection is empty).' ELSE '' END)"
    )
    body = (
        "named_struct('allowed_regions', final, 'blocked_regions', denied, 'is_global_ban', ban, "
        f"'reason', {_reason(f'get({rules}, s.winner)', text)})"
    )
    body = _let("final", "array_sort(array_except(s.kept, denied))", _let("ban", "s.seen AND size(final) = 0", body))
    body = _let("denied", _union_of(rules, "geofencing.denied_regions"), body)
    return _let("s", _narrow(rules, "geofencing.allowed_regions"), body)


def resolve_purpose(rules: str) -> str:
    """Same set algebra without a ban: an empty intersection reads as unrestricted."""
    text = (
        "concat('Applied purpose intersection from ''', w.source_id, '''. Result: ', size(final), ' allowed, ', "
        "size(denied), ' denied.')"
    )
    body = f"named_struct('allowed_purposes', final, 'denied_purposes', denied, 'reason', {_reason('w', text)})"
    body = _let("final", "array_sort(array_except(s.kept, denied))", _let("w", f"get({rules}, s.winner)", body))
    body = _let("denied", _union_of(rules, "purpose.denied_purposes"), body)
    denies = "coalesce(size(r.purpose.denied_purposes), 0) > 0"
    return _let("s", _narrow(rules, "purpose.allowed_purposes", denies), body)


def resolve_ai(rules: str) -> str:
    """Every permission must be granted by all rules; attribution texts add up."""
    permitted = lambda field: f"forall({rules}, r -> coalesce(r.ai_model.{field}, false))"
    credit = "coalesce(r.ai_model.attribution_text_required, '')"
    winner = (
        f"coalesce(get(filter({rules}, r -> NOT coalesce(r.ai_model.training_allowed, false)), 0), "
        f"get(filter({rules}, (r, i) -> i > 0 AND {credit} <> ''), 0), {rules}[0])"
    )
    summary = (
        "concat_ws(', ', CASE WHEN NOT train THEN 'Training Blocked' END, CASE WHEN NOT tune THEN 'Fine-Tuning Blocked' END, "
        "CASE WHEN size(texts) > 0 THEN 'Attribution Required' END)"
    )
    text = (
        f"concat('AI Constraint: ', coalesce(nullif({summary}, ''), 'All AI actions permitted'), "
        "'. Defined by source ''', w.source_id, '''.')"
    )
    body = (
        f"named_struct('training_allowed', train, 'fine_tuning_allowed', tune, 'rag_allowed', {permitted('rag_usage_allowed')}, "
        f"'attribution_required', size(texts) > 0, 'attribution_text', array_join(texts, '; '), 'reason', {_reason('w', text)})"
    )
    body = _let("w", winner, _let("texts", f"filter(transform({rules}, r -> {credit}), t -> t <> '')", body))
    return _let("train", permitted("training_allowed"), _let("tune", permitted("fine_tuning_allowed"), body))


def resolve_privacy(rules: str, on_conflict: str = "flag") -> str:
    """Highest method; equal methods merge their parameters.

    Differential privacy keeps the least epsilon and delta, anonymization the greatest k and l, other
    methods the union of their settings. Two values for one setting are a conflict: with
    ``on_conflict='flag'`` the setting keeps its first value and ``conflict`` is true, with ``'error'``
    the job fails. A conflict counts although a stronger method comes later.
    """
    noise, grouping = fixed.PRIVACY_METHOD["DIFFERENTIAL_PRIVACY"], fixed.PRIVACY_METHOD["ANONYMIZATION"]
    none = "cast(array() AS array<struct<key:string,value:string>>)"
    first = "map_entries(peers[0].privacy.parameters)"

    def numeric(name: str, default: str, kind: str, pick: str, always: bool = False) -> str:
        """One merged number; a peer that does not name it counts with the default."""
        each = f"transform(peers, r -> cast(coalesce(try_element_at(r.privacy.parameters, '{name}'), '{default}') AS {kind}))"
        item = f"array(named_struct('key', '{name}', 'value', cast({pick}({each}) AS string)))"
        return item if always else f"CASE WHEN array_contains(names, '{name}') THEN {item} ELSE {none} END"

    noisy = (
        f"concat(filter({first}, e -> e.key NOT IN ('epsilon', 'delta')), "
        f"{numeric('epsilon', '10.0', 'double', 'array_min', always=True)}, {numeric('delta', '1.0', 'double', 'array_min')})"
    )
    grouped = (
        f"concat(filter({first}, e -> e.key NOT IN ('k', 'l')), "
        f"{numeric('k', '0', 'bigint', 'array_max')}, {numeric('l', '0', 'bigint', 'array_max')})"
    )
    values = "transform(filter(entries, e -> e.key = n), e -> e.value)"
    united = f"transform(names, n -> named_struct('key', n, 'value', {values}[0]))"
    merged = (
        f"array_sort(CASE WHEN size(peers) = 1 THEN {first} WHEN best = {noise} THEN {noisy} "
        f"WHEN best = {grouping} THEN {grouped} ELSE {united} END)"
    )
    # Rules are met in order: one weaker than the strongest so far is ignored, an equal one must agree with its like.
    # So the rules of one method that come before any stronger one must have one value per setting.
    ranked = f"transform({rules}, (r, i) -> named_struct('m', r.privacy.method, 'i', i))"
    cut = f"coalesce(array_min(transform(filter(ranked, x -> x.m > m), x -> x.i)), size({rules}))"
    kept = f"transform(filter({rules}, (r, i) -> r.privacy.method = m AND i < cut), r -> coalesce(map_entries(r.privacy.parameters), {none}))"
    setting = "concat(length(e.key), ':', e.key, coalesce(concat('=', e.value), ''))"
    differ = f"size(array_distinct(transform(said, e -> {setting}))) > size(array_distinct(transform(said, e -> e.key)))"
    differ = _let("cut", cut, _let("said", f"flatten({kept})", differ))
    methods = f"filter(array_distinct(transform({rules}, r -> r.privacy.method)), m -> m NOT IN ({noise}, {grouping}))"
    conflict = _let("ranked", ranked, f"exists({methods}, m -> {differ})")
    parameters = "map_from_entries(merged)"
    if on_conflict == "error":
        failure = "raise_error(concat('conflicting privacy parameters near ', peers[0].id))"
        parameters = f"CASE WHEN conflict THEN cast({failure} AS map<string,string>) ELSE {parameters} END"
    name = "CASE best " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in fixed.PRIVACY_METHOD.items()) + " END"
    shown = "array_join(transform(merged, e -> concat('''', e.key, ''': ''', e.value, '''')), ', ')"
    text = f"concat('Enforced strongest privacy method ''', {name}, ''' with parameters: {{', {shown}, '}}.')"
    body = (
        f"named_struct('method', best, 'parameters', {parameters}, 'conflict', conflict, 'reason', {_reason('peers[0]', text)})"
    )
    body = _let("merged", merged, _let("conflict", conflict, body))
    body = _let("names", "array_distinct(transform(entries, e -> e.key))", body)
    body = _let("entries", "flatten(transform(peers, r -> map_entries(r.privacy.parameters)))", body)
    body = _let("peers", f"filter({rules}, r -> r.privacy.method = best)", body)
    return _let("best", f"array_max(transform({rules}, r -> r.privacy.method))", body)


# domain of the policy -> (rule column of the obligation, fold)
RESOLVERS: dict[str, tuple[str, Callable[[str], str]]] = {
    "retention": ("retention", resolve_retention),
    "geofencing": ("geofencing", resolve_geofencing),
    "ai_rules": ("ai_model", resolve_ai),
    "purpose": ("purpose", resolve_purpose),
    "privacy": ("privacy", resolve_privacy),
}


_BY_ORD = "(a, b) -> CASE WHEN a.ord < b.ord THEN -1 WHEN a.ord > b.ord THEN 1 ELSE 0 END"


def rule_sets(resources: DataFrame, obligations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, urn, rule_set) of each matched resource, and (rule_set, ord) with the obligations of each set.

    A set is told by the shapes that its resources fit, so the obligations are listed once per distinct set. One with
    several include globs is in several shapes and counts once.
    """
    fits, members = match_shapes(resources, obligations)
    # One short row per resource, read twice below: matching must not run twice for that.
    fitted = materialize(fits.groupBy("project_id", "urn").agg(F.array_sort(F.collect_list("shape")).alias("shapes")))
    numbered = materialize(fitted.select("shapes").distinct().withColumn("rule_set", F.monotonically_increasing_id()))
    counted = numbered.select("rule_set", F.explode("shapes").alias("shape")).groupBy("rule_set", "shape").agg(F.count("*").cast("int").alias("n"))
    once = counted.join(members, "shape").groupBy("rule_set", "sel", "ord").agg(F.max("n").alias("n"))
    held = once.select("rule_set", "ord", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_")).drop("_")
    return fitted.join(numbered, "shapes").select("project_id", "urn", "rule_set"), held


def fold_rule_sets(held: DataFrame, obligations: DataFrame, domains: list[str] | None = None, on_conflict: str = "flag") -> DataFrame:
    """One row per ``rule_set`` of (rule_set, ord) with the effective rule of each domain (null when it has none)."""
    chosen = domains or list(RESOLVERS)
    rules = obligations.select(
        "ord", "id", "title", F.col("provenance.source_id").alias("source_id"),
        *[RESOLVERS[d][0] for d in chosen],
    )
    joined = held.join(rules, "ord")
    collected = [
        F.expr(f"array_sort(collect_list(CASE WHEN {rule} IS NOT NULL THEN struct(ord, id, title, source_id, {rule}) END), {_BY_ORD})").alias(
            f"_{domain}"
        )
        for domain, rule in ((d, RESOLVERS[d][0]) for d in chosen)
    ]
    grouped = joined.groupBy("rule_set").agg(
        F.expr("transform(array_sort(collect_list(struct(ord, id))), r -> r.id)").alias("contributing_obligation_ids"), *collected
    )
    folds = []
    for domain in chosen:
        fold = RESOLVERS[domain][1]
        value = fold(f"_{domain}", on_conflict) if domain == "privacy" else fold(f"_{domain}")
        folds.append(F.expr(f"CASE WHEN size(_{domain}) > 0 THEN {value} END").alias(domain))
    return grouped.select("rule_set", *folds, "contributing_obligation_ids")


def resolve_policies(
    resources: DataFrame, obligations: DataFrame, domains: list[str] | None = None, on_conflict: str = "flag"
) -> DataFrame:
    """Effective policy of every resource; one without a match gets an empty policy."""
    sets, held = rule_sets(resources, obligations)
    folded = fold_rule_sets(held, obligations, domains, on_conflict)
    applied = sets.join(folded, "rule_set").drop("rule_set")
    return (
        null_safe_join(resources.select("project_id", F.col("urn")), applied, ["project_id", "urn"], "left")
        .withColumnRenamed("urn", "resource_urn")
        .withColumn("contributing_obligation_ids", F.coalesce("contributing_obligation_ids", F.array().cast(_STRINGS)))
    )


def explain_policies(policies: DataFrame) -> DataFrame:
    """One row per resource and domain with the obligation that decided it."""
    rows = [
        F.struct(
            F.lit(domain).alias("domain"),
            F.col(f"{domain}.reason.winning_obligation_id").alias("winning_obligation_id"),
            F.col(f"{domain}.reason.winning_source_id").alias("winning_source_id"),
            F.col(f"{domain}.reason.description").alias("description"),
        )
        for domain in RESOLVERS
        if domain in policies.columns
    ]
    return policies.select("project_id", "resource_urn", F.inline(F.array(*rows))).filter(
        F.col("winning_obligation_id").isNotNull()
    )
