"""Policy change management: sync plans, drift and semantic diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark import fixed_values as fixed
from govspark.functions import canonical_json_text
from govspark.operators.joins import null_safe_join
from govspark.operators.resolve import fold_rule_sets, rule_sets
from govspark.session import materialize

_STRINGS = "array<string>"


def definition_hash(definition: Column) -> Column:
    """SHA-256 of the canonical JSON of a definition; key order does not matter."""
    return F.sha2(canonical_json_text(definition), 256)


def plan_sync(current: DataFrame, incoming: DataFrame, prune: bool = False, direction: str = "push") -> DataFrame:
    """(project_id, slug, title, status, version) of bringing ``incoming`` into ``current``.

    ``current``: project_id, slug, title, source_hash, version, is_active. ``incoming``: project_id, slug,
    title, definition. Push compares with active rows only, so a re-activated slug reports CREATED v1.
    Pull names the outcomes NEW and DELETED and always lists deletions.
    """
    pull = direction == "pull"
    keys = ["project_id", "slug"]
    have = current.filter("is_active").select(
        *keys, F.col("title").alias("old_title"), F.col("source_hash").alias("old_hash"), F.col("version").alias("old_version")
    )
    want = incoming.select(*keys, "title", definition_hash(F.col("definition")).alias("new_hash"))
    joined = have.join(want, keys, "full_outer")
    created = F.col("old_hash").isNull() & F.col("new_hash").isNotNull()
    removed = F.col("new_hash").isNull()
    changed = F.col("old_hash") != F.col("new_hash")
    status = (
        F.when(created, F.lit("NEW" if pull else "CREATED"))
        .when(removed, F.lit("DELETED" if pull else "PRUNED"))
        .when(changed, F.lit("UPDATED"))
        .otherwise(F.lit("UNCHANGED"))
    )
    version = (
        F.when(created, F.lit(1)).when(removed, F.col("old_version")).when(changed, F.col("old_version") + 1)
        .otherwise(F.col("old_version"))
    )
    plan = joined.select(
        *keys, F.coalesce("title", "old_title").alias("title"), status.alias("status"), version.alias("version"), "new_hash"
    )
    return plan if prune or pull else plan.filter(F.col("status") != "PRUNED")


def apply_sync(current: DataFrame, incoming: DataFrame, as_of: Column, prune: bool = False) -> DataFrame:
    """The obligation table after a push: only changed or re-activated rows are rewritten."""
    keys = ["project_id", "slug"]
    plan = plan_sync(current, incoming, prune).select(*keys, "status", F.col("version").alias("new_version"), "new_hash")
    fresh = incoming.select(*keys, F.col("title").alias("new_title"), F.col("definition").alias("new_definition"))
    joined = current.join(plan, keys, "full_outer").join(fresh, keys, "left")
    arrives = F.col("new_hash").isNotNull()
    writes = arrives & (
        F.col("source_hash").isNull() | (F.col("source_hash") != F.col("new_hash")) | ~F.col("is_active")
    )
    pruned = F.coalesce(F.col("status") == "PRUNED", F.lit(False))
    pick = lambda new, old: F.when(writes, F.col(new)).otherwise(F.col(old))
    return joined.select(
        *keys,
        pick("new_title", "title").alias("title"),
        pick("new_definition", "definition").alias("definition"),
        pick("new_hash", "source_hash").alias("source_hash"),
        pick("new_version", "version").alias("version"),
        F.when(writes, F.lit(True)).when(pruned, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(writes | pruned, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def drift(desired: DataFrame, actual: DataFrame, tag: str = "gov") -> DataFrame:
    """Objects to update and bindings to change.

    ``desired``: object_name, content_hash, binding. ``actual``: object_name, comment, binding.
    """
    known = actual.select(
        "object_name", "comment", F.col("binding").alias("bound"), F.lit(True).alias("exists")
    )
    found = F.regexp_extract(F.coalesce("comment", F.lit("")), rf"^({tag}:v\d+:[a-f0-9]+)", 1)
    cause = (
        F.when(F.col("exists").isNull(), F.lit("missing"))
        .when(found == "", F.lit("no hash"))
        .when(found != F.col("content_hash"), F.lit("changed"))
        .otherwise(F.lit("current"))
    )
    return desired.join(known, "object_name", "left").select(
        "object_name",
        cause.alias("cause"),
        (cause != "current").alias("needs_update"),
        (~F.col("bound").eqNullSafe(F.col("binding"))).alias("needs_binding"),
    )


def changed_only(definitions: DataFrame, seen: DataFrame) -> DataFrame:
    """Definitions (name, definition, …) whose (name, hash) has not been seen."""
    hashed = definitions.withColumn("definition_hash", definition_hash(F.col("definition")))
    return hashed.join(seen.select("name", "definition_hash"), ["name", "definition_hash"], "left_anti")


# --- semantic diff -----------------------------------------------------------


def _impact(restrictive: str) -> str:
    return f"CASE WHEN {restrictive} THEN 'RESTRICTIVE' ELSE 'PERMISSIVE' END"


def _clock(seconds: str) -> str:
    """SQL for seconds in the form '3 days, 2:00:00'."""
    days = f"cast(floor({seconds} / 86400) AS bigint)"
    time = (
        f"format_string('%d:%02d:%02d', cast(floor({seconds} % 86400 / 3600) AS bigint), "
        f"cast(floor({seconds} % 3600 / 60) AS bigint), cast({seconds} % 60 AS bigint))"
    )
    prefix = f"CASE WHEN {days} = 0 THEN '' WHEN abs({days}) = 1 THEN concat({days}, ' day, ') ELSE concat({days}, ' days, ') END"
    return f"concat({prefix}, {time})"


def _flag(value: str) -> str:
    return f"CASE WHEN {value} THEN 'True' ELSE 'False' END"


_TIGHT, _LOOSE, _NEUTRAL, _NONE = "'RESTRICTIVE'", "'PERMISSIVE'", "'NEUTRAL'", "cast(NULL AS string)"
# condition, category, field, old value, new value, change type, impact, description; all but the names in SQL
_Change = tuple[str, str, str, str, str, str, str, str]


def _presence(name: str) -> tuple[str, str, str]:
    old, new = f"o_{name} IS NOT NULL", f"n_{name} IS NOT NULL"
    return f"NOT {old} AND {new}", f"{old} AND NOT {new}", f"{old} AND {new}"


def _flip(condition: str, category: str, path: str, true_is_tight: bool, text: str) -> _Change:
    """A boolean that changed; ``text`` may name the old and new value."""
    old, new = _flag(f"o_{path}"), _flag(f"n_{path}")
    impact = _impact(f"n_{path}" if true_is_tight else f"NOT n_{path}")
    field = path.split(".")[-1]
    return (f"{condition} AND o_{path} <> n_{path}", category, field, old, new, "MODIFIED", impact, text.format(old=old, new=new))


def _set_change(condition: str, category: str, path: str, growth_is_loose: bool, gained: str, lost: str) -> list[_Change]:
    field = path.split(".")[-1]
    names = lambda a, b: f"array_join(array_sort(array_except({a}_{path}, {b}_{path})), ', ')"
    more, less = names("n", "o"), names("o", "n")
    up, down = (_LOOSE, _TIGHT) if growth_is_loose else (_TIGHT, _LOOSE)
    return [
        (f"{condition} AND {more} <> ''", category, field, _NONE, more, "MODIFIED", up, f"concat('{gained}: ', {more})"),
        (f"{condition} AND {less} <> ''", category, field, less, _NONE, "MODIFIED", down, f"concat('{lost}: ', {less})"),
    ]


def _retention_changes() -> list[_Change]:
    added, removed, both = _presence("retention")
    old, new = _clock("o_retention.duration_s"), _clock("n_retention.duration_s")
    hold = "concat('Legal Hold (Indefinite) changed from ', {old}, ' to ', {new}, '.')"
    return [
        (removed, "Retention", "rule", "'Defined'", "'None'", "REMOVED", _LOOSE, "'Retention rule removed. Data may be kept indefinitely.'"),
        (added, "Retention", "rule", "'None'", new, "ADDED", _TIGHT, f"concat('Retention rule added. Max duration: ', {new}, '.')"),
        _flip(both, "Retention", "retention.is_indefinite", False, hold),
        (
            f"{both} AND o_retention.duration_s <> n_retention.duration_s", "Retention", "duration", old, new, "MODIFIED",
            _impact("n_retention.duration_s < o_retention.duration_s"),
            f"concat('Retention duration changed from ', {old}, ' to ', {new}, '.')",
        ),
    ]


def _geofencing_changes(strict: bool) -> list[_Change]:
    added, removed, both = _presence("geofencing")
    gone = (removed, "Geofencing", "rule", "'Defined'", "'None'", "REMOVED", _LOOSE, "'Geofencing rules removed.'")
    return [
        (added, "Geofencing", "rule", "'None'", "'Defined'", "ADDED", _TIGHT, "'Geofencing rules applied.'"),
        *([gone] if strict else []),
        _flip(both, "Geofencing", "geofencing.is_global_ban", True, "concat('Global Data Ban changed to ', {new}, '.')"),
        *_set_change(both, "Geofencing", "geofencing.allowed_regions", True, "Allowed regions added", "Allowed regions removed"),
    ]


def _ai_changes() -> list[_Change]:
    _, _, both = _presence("ai_rules")
    flags = [
        ("training_allowed", "AI Training", False),
        ("fine_tuning_allowed", "AI Fine-Tuning", False),
        ("rag_allowed", "RAG Usage", False),
        ("attribution_required", "Attribution Requirement", True),
    ]
    rows = [
        _flip(both, "AI Rules", f"ai_rules.{field}", tight, f"concat('{label} changed from ', {{old}}, ' to ', {{new}}, '.')")
        for field, label, tight in flags
    ]
    old, new = "o_ai_rules.attribution_text", "n_ai_rules.attribution_text"
    text = "'Attribution text content updated.'"
    return [*rows, (f"{both} AND {old} <> {new}", "AI Rules", "attribution_text", old, new, "MODIFIED", _NEUTRAL, text)]


def _purpose_changes() -> list[_Change]:
    added, removed, both = _presence("purpose")
    lost = "'Purpose limitation removed. Data can be used for any purpose.'"
    return [
        (added, "Purpose", "rule", "'Open'", "'Restricted'", "ADDED", _TIGHT, "'Purpose limitation rules applied.'"),
        (removed, "Purpose", "rule", "'Restricted'", "'Open'", "REMOVED", _LOOSE, lost),
        *_set_change(both, "Purpose", "purpose.allowed_purposes", True, "Allowed purposes expanded", "Allowed purposes reduced"),
        *_set_change(both, "Purpose", "purpose.denied_purposes", False, "Denied purposes added", "Denied purposes removed"),
    ]


def _privacy_changes() -> list[_Change]:
    added, removed, both = _presence("privacy")
    arms = " ".join(f"WHEN {v} THEN '{k}'" for k, v in fixed.PRIVACY_METHOD.items())
    name = lambda side: f"CASE {side}_privacy.method {arms} END"
    stronger = "n_privacy.method > o_privacy.method"
    verdict = (
        f"CASE WHEN {stronger} THEN 'Privacy method upgraded (stronger protection). ' "
        "ELSE 'Privacy method downgraded (weaker protection). ' END"
    )
    rows = [
        (added, "Privacy", "rule", "'None'", name("n"), "ADDED", _TIGHT, f"concat('Privacy method ', {name('n')}, ' applied.')"),
        (
            removed, "Privacy", "rule", name("o"), "'None'", "REMOVED", _LOOSE,
            f"concat('Privacy method ', {name('o')}, ' removed. Data is now raw/unmasked.')",
        ),
        (
            f"{both} AND o_privacy.method <> n_privacy.method", "Privacy", "method", name("o"), name("n"), "MODIFIED",
            _impact(stronger), f"concat({verdict}, {name('o')}, ' -> ', {name('n')}, '.')",
        ),
    ]
    setting = lambda side, key: f"try_element_at({side}_privacy.parameters, '{key}')"
    for key, tighter in (("epsilon", "<"), ("k", ">")):
        old, new = (f"try_cast({setting(side, key)} AS double)" for side in "on")
        text = f"concat('Privacy parameter {key} changed from ', {old}, ' to ', {new}, '.')"
        rows.append(
            (f"{both} AND {old} <> {new}", "Privacy", f"parameters.{key}", old, new, "MODIFIED", _impact(f"{new} {tighter} {old}"), text)
        )
    whole = lambda side: f"to_json(map_from_entries(array_sort(map_entries({side}_privacy.parameters))))"
    plain = f"{setting('o', 'epsilon')} IS NULL AND {setting('o', 'k')} IS NULL"
    other = f"{both} AND {whole('o')} <> {whole('n')} AND {plain}"
    text = "'Privacy configuration parameters updated.'"
    return [*rows, (other, "Privacy", "parameters", whole("o"), whole("n"), "MODIFIED", _NEUTRAL, text)]


_DOMAINS = ["retention", "geofencing", "ai_rules", "purpose", "privacy"]


def _side(df: DataFrame, mark: str, keys: dict[str, str]) -> DataFrame:
    """The columns of one version, marked ``o`` or ``n``; ``keys`` maps columns to their new names."""
    return df.selectExpr(
        *[f"{old} AS {new}" for old, new in keys.items()],
        *[f"{d} AS {mark}_{d}" for d in _DOMAINS], f"size(contributing_obligation_ids) AS {mark}_count",
    )


def _change_rows(joined: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    changes = [
        *_retention_changes(), *_geofencing_changes(strict), *_ai_changes(), *_purpose_changes(), *_privacy_changes(),
    ]
    rows = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('position', {i}, 'category', '{category}', 'field', '{field}', "
        f"'old_value', cast({before} AS string), 'new_value', cast({after} AS string), 'change_type', '{kind}', "
        f"'impact', {impact}, 'description', {text}) END"
        for i, (condition, category, field, before, after, kind, impact, text) in enumerate(changes)
    )
    counts = ["old_obligations", "new_obligations"]
    # A column first: what a generator computes by itself is interpreted, a column is compiled.
    listed = joined.selectExpr(
        *keys, f"coalesce(o_count, 0) AS {counts[0]}", f"coalesce(n_count, 0) AS {counts[1]}", f"array_compact(array({rows})) AS _rows"
    )
    return listed.select(*keys, *counts, F.inline("_rows"))


def diff_policies(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """One row per material change between two policy snapshots.

    A resource that is in one snapshot only has an empty policy in the other. Removing geofencing
    gives a row only with ``strict``.
    """
    keys = ["project_id", "resource_urn"]
    one = _side(old, "o", {k: k for k in keys})
    two = _side(new, "n", {k: f"_{k}" for k in keys})
    met = one.project_id.eqNullSafe(two._project_id) & (one.resource_urn == two._resource_urn)
    joined = one.join(two, met, "full_outer")
    for k in keys:
        joined = joined.withColumn(k, F.coalesce(k, f"_{k}"))
    return _change_rows(joined, keys, strict)


# Ordinals of the rules of two versions side by side: three times the rule's own, plus where it is found.
_BOTH, _OLD, _NEW = 0, 1, 2


def _merged_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules of both versions in one table; one that is the same in both is there once."""
    columns = old.columns
    body = F.to_json(F.struct(*sorted(columns))).alias("_body")
    side = lambda df, place: df.select("ord", body, F.struct(*columns).alias("_rule"), F.lit(place).alias("_place"))
    found = side(old, _OLD).unionByName(side(new, _NEW)).groupBy("ord", "_body").agg(
        F.any_value("_rule").alias("_rule"), F.min("_place").alias("_first"), F.max("_place").alias("_last")
    )
    place = F.when(F.col("_first") != F.col("_last"), F.lit(_BOTH)).otherwise(F.col("_first"))
    return found.select("_rule.*", place.alias("_place")).withColumn("ord", F.col("ord") * 3 + F.col("_place")).drop("_place")


def diff_versions(
    resources: DataFrame, old: DataFrame, new: DataFrame, strict: bool = False, on_conflict: str = "flag"
) -> DataFrame:
    """As ``diff_policies`` of the policies that two versions of the rules give the same resources.

    Both versions are matched in one pass. A resource whose rules are the same in both is left at once; for the others
    each pair of rule sets is folded and compared once, however many resources share it. ``old`` and ``new`` have the
    same columns; ``ord`` is unique in each.
    """
    rules = materialize(_merged_rules(old, new))
    place = F.col("ord") % 3
    listed = lambda other: F.array_sort(F.collect_list(F.when(place != other, F.col("ord"))))
    sets, held = rule_sets(resources, rules)
    held = materialize(held)
    pairs = materialize(
        held.groupBy("rule_set")
        .agg(listed(_NEW).alias("old_set"), listed(_OLD).alias("new_set"))
        .filter(F.col("old_set") != F.col("new_set"))
        .select("rule_set")
    )
    # The two sides of a set are folded as sets of their own. One without any rule has no fold: that side is empty.
    changed = held.join(pairs, "rule_set", "left_semi")
    sides = [changed.filter(place != other).select(F.col("rule_set") * 2 + i, "ord") for i, other in ((0, _NEW), (1, _OLD))]
    folded = materialize(fold_rule_sets(sides[0].union(sides[1]).toDF("rule_set", "ord"), rules, on_conflict=on_conflict))
    joined = pairs
    for i, mark in enumerate("on"):
        side = folded.filter(F.col("rule_set") % 2 == i).withColumn("rule_set", F.expr("rule_set DIV 2"))
        joined = joined.join(_side(side, mark, {"rule_set": "rule_set"}), "rule_set", "left")
    changes = _change_rows(joined, ["rule_set"], strict)
    named = sets.withColumnRenamed("urn", "resource_urn").select("project_id", "resource_urn", "rule_set")
    return named.join(changes, "rule_set").drop("rule_set")


def risk_delta(changes: DataFrame) -> DataFrame:
    """Permissive changes minus restrictive ones, per resource."""
    score = F.when(F.col("impact") == "PERMISSIVE", 1).when(F.col("impact") == "RESTRICTIVE", -1).otherwise(0)
    return changes.groupBy("project_id", "resource_urn").agg(
        F.sum(score).alias("risk_delta"), F.count("*").alias("changes")
    )


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# Report wording.
_REPORT_TITLE = "### 📋 Policy Diff Report for `"
_NO_CHANGE = "✅ **No Material Changes** detected for `"
_RISK_UP = "> ⚠️ **Risk Profile Increased:** Policy has become more permissive (+"
_RISK_DOWN = "> 🛡️ **Risk Profile Decreased:** Policy has become stricter ("
_RISK_LEVEL = "> ℹ️ **Risk Profile Neutral:** Policy structure changed but risk level is balanced."
_TABLE_HEAD = "| Category | Impact | Change | Description |\n| :--- | :--- | :--- | :--- |"
_ICONS = {"PERMISSIVE": "🔓 (Looser)", "RESTRICTIVE": "🔒 (Stricter)", "NEUTRAL": "📝 (Info)"}


def diff_markdown(changes: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(project_id, resource_urn, report). ``resources`` adds a no-change line for urns without changes."""
    keys = ["project_id", "resource_urn"]
    icon = F.lit(None).cast("string")
    for impact, shown in _ICONS.items():
        icon = F.when(F.col("impact") == impact, F.lit(shown)).otherwise(icon)
    line = _say("| **", F.col("category"), "** | ", icon, " | `", F.col("field"), "` | ", F.col("description"), " |")
    score = F.sum(F.when(F.col("impact") == "PERMISSIVE", 1).when(F.col("impact") == "RESTRICTIVE", -1).otherwise(0))
    grouped = changes.groupBy(*keys).agg(
        score.alias("score"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda r: r["line"]), "\n"
        ).alias("lines"),
        F.max("old_obligations").alias("was"),
        F.max("new_obligations").alias("now"),
    )
    header = (
        F.when(F.col("score") > 0, _say(_RISK_UP, F.col("score").cast("string"), ")."))
        .when(F.col("score") < 0, _say(_RISK_DOWN, F.col("score").cast("string"), ")."))
        .otherwise(F.lit(_RISK_LEVEL))
    )
    report = _say(
        _REPORT_TITLE, F.col("resource_urn"), "`\n", header, "\n\n", _TABLE_HEAD, "\n", F.col("lines"),
        "\n\n**Contributing Obligations:** ", F.col("now").cast("string"), " (Was: ", F.col("was").cast("string"), ")",
    )
    out = grouped.select(*keys, report.alias("report"))
    if resources is None:
        return out
    quiet = _say(_NO_CHANGE, F.col("resource_urn"), "`.")
    named = resources.select(*keys).distinct()
    return null_safe_join(named, out, keys, "left").withColumn("report", F.coalesce("report", quiet))
