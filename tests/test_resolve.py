import fnmatch
import itertools
import random

import pytest
from pyspark.sql import functions as F

from govspark.operators.match import _owned, match_obligations, match_shapes
from govspark.operators.resolve import explain_policies, resolve_policies
from rules import ai, geo, obligation, obligations, privacy, purpose, resources, retention

URN = "urn:lake:prod:t1"
ALL = ["urn:*"]


@pytest.fixture(scope="module")
def effective(spark):
    """Policies of many scenarios at once; each scenario is one project."""

    def run(*scenarios):
        rows, assets, ords = [], [], itertools.count()
        for i, rules in enumerate(scenarios):
            assets.append((f"p{i}", URN, "lake", None, {}, 0, 0, True, None))
            for rule in rules:
                n = next(ords)
                rows.append(obligation(n, f"o{n}", ALL, project=f"p{i}", **rule))
        from govspark.schemas import RESOURCES

        random.Random(1).shuffle(rows)
        found = resolve_policies(spark.createDataFrame(assets, RESOURCES), obligations(spark, *rows)).collect()
        return [r.asDict(recursive=True) for r in sorted(found, key=lambda r: int(r.project_id[1:]))]

    return run


def test_reference_scenarios(effective):
    out = effective(
        [{"retention": retention(1825)}, {"retention": retention(730)}],
        [{"retention": retention(30)}, {"retention": retention(30)}],
        [{"geofencing": geo(["US", "DE"])}, {"geofencing": geo(["DE", "FR"])}],
        [{"geofencing": geo(["US", "DE"])}, {"geofencing": geo([], ["US"])}],
        [{"geofencing": geo(["US"])}, {"geofencing": geo(["DE"])}],
        [{"geofencing": geo([], ["CN"])}],
        [{"ai_model": ai()}, {"ai_model": ai(training=False)}],
        [{"ai_model": ai(credit="A")}, {"ai_model": ai(credit="B")}],
        [{"purpose": purpose(["ANALYTICS", "HR"])}, {"purpose": purpose(["ANALYTICS"])}],
        [{"purpose": purpose([], ["SALES"])}, {"purpose": purpose([], ["HR"])}],
        [{"purpose": purpose(["A"])}, {"purpose": purpose(["B"])}, {"purpose": purpose([], ["C"])}],
        [{"privacy": privacy(1)}, {"privacy": privacy(2)}],
        [{"privacy": privacy(3, epsilon="1.0")}, {"privacy": privacy(3, epsilon="0.5", delta="0.1")}],
        [{"privacy": privacy(2, k="5")}, {"privacy": privacy(2, k="11", l="2")}],
        [{"privacy": privacy(1, algorithm="SHA256")}, {"privacy": privacy(1, algorithm="AES256")}],
        [{"privacy": privacy(4)}, {"privacy": privacy(3, epsilon="1.0")}],
    )
    win = lambda i, domain: out[i][domain]["reason"]["winning_obligation_id"]
    ids = lambda i: out[i]["contributing_obligation_ids"]
    assert out[0]["retention"]["duration_s"] == 730 * 86400 and win(0, "retention") == ids(0)[1]
    assert win(1, "retention") == ids(1)[0] and out[1]["geofencing"] is None
    assert out[2]["geofencing"]["allowed_regions"] == ["DE"] and not out[2]["geofencing"]["is_global_ban"]
    assert out[3]["geofencing"]["allowed_regions"] == ["DE"] and out[3]["geofencing"]["blocked_regions"] == ["US"]
    assert out[4]["geofencing"]["is_global_ban"] and out[4]["geofencing"]["allowed_regions"] == []
    assert out[5]["geofencing"]["is_global_ban"] is False
    assert out[6]["ai_rules"]["training_allowed"] is False and win(6, "ai_rules") == ids(6)[1]
    assert out[7]["ai_rules"]["attribution_text"] == "A; B" and win(7, "ai_rules") == ids(7)[1]
    assert out[8]["purpose"]["allowed_purposes"] == ["ANALYTICS"] and win(8, "purpose") == ids(8)[1]
    assert out[9]["purpose"]["denied_purposes"] == ["HR", "SALES"] and win(9, "purpose") == ids(9)[1]
    assert out[10]["purpose"]["allowed_purposes"] == [] and win(10, "purpose") == ids(10)[2]
    assert out[11]["privacy"]["method"] == 2 and win(11, "privacy") == ids(11)[1]
    assert out[12]["privacy"]["parameters"] == {"delta": "0.1", "epsilon": "0.5"}
    assert out[13]["privacy"]["parameters"] == {"k": "11", "l": "2"}
    assert out[14]["privacy"]["conflict"] and out[14]["privacy"]["parameters"] == {"algorithm": "SHA256"}
    assert out[15]["privacy"]["method"] == 4


def test_conflict_error_mode(spark):
    rows = [obligation(i, None, ALL, privacy=privacy(1, algorithm=a)) for i, a in enumerate(["X", "Y"])]
    found = resolve_policies(resources(spark, (URN, {})), obligations(spark, *rows), on_conflict="error")
    with pytest.raises(Exception, match="conflicting privacy parameters"):
        found.collect()


def test_unmatched_resource_keeps_an_empty_policy(spark):
    rows = obligations(spark, obligation(0, None, ["urn:other:*"], retention=retention(1)))
    (row,) = resolve_policies(resources(spark, (URN, {})), rows).collect()
    assert row.retention is None and row.contributing_obligation_ids == []


def test_explain_has_a_row_per_decided_domain(spark):
    rows = obligations(spark, obligation(0, None, ALL, retention=retention(1)), obligation(1, None, ALL, ai_model=ai()))
    found = {(r.domain, r.winning_obligation_id) for r in explain_policies(resolve_policies(resources(spark, (URN, {})), rows)).collect()}
    assert found == {("retention", "o0"), ("ai_rules", "o1")}


def brute(assets, rules):
    """The selector rules, one pair at a time."""
    out = set()
    for urn, tags in assets:
        for ord, include, exclude, wanted in rules:
            if not include and not wanted:
                continue
            if any(fnmatch.fnmatchcase(urn, p) for p in exclude) or any(tags.get(k, "") != v for k, v in wanted.items()):
                continue
            if not include or any(fnmatch.fnmatchcase(urn, p) for p in include):
                out.add((urn, ord))
    return out


@pytest.mark.parametrize("gram", [3, 2])
def test_match_equals_all_pairs(spark, gram):
    rng = random.Random(7)
    urns = [f"urn:{p}:{e}:{t}:{i}" for i, (p, e, t) in enumerate(itertools.product(["lake", "s3"], ["prod", "dev"], ["a", "b[x]", "c.d"]))]
    assets = [(u, {k: rng.choice("xyz") for k in "jkl" if rng.random() < 0.6}) for u in urns for u in (u, u + "7")]
    globs = ["urn:lake:*", "urn:lake:prod:a:*", "urn:*:?[13579]", "*[!0-4]", "*", urns[3], "urn:s3:dev:b[[]x]:*", "urn:lake:prod:c.d*", "[", "urn:???*:dev:*", "", "*v:b*", "*]:*", "?rn*c.d:*", "*a:1", "[]u]*:dev:*", "a[!]b"]
    rules = []
    for ord in range(120):
        include = rng.sample(globs, rng.choice([0, 1, 1, 2, 3]))
        exclude = rng.sample(globs, rng.choice([0, 0, 1]))
        wanted = {k: rng.choice(["x", "y", "z", ""]) for k in rng.sample("jkl", rng.choice([0, 0, 1, 2]))}
        rules.append((ord, include, exclude, wanted))
    rows = obligations(spark, *[obligation(o, None, i, e, w, retention=retention(1)) for o, i, e, w in rules])
    found = match_obligations(resources(spark, *assets), rows, spread=3, gram=gram).collect()
    assert len(found) == len(set(found))
    assert {(r.urn, r.ord) for r in found} == brute(assets, rules)


def test_globs_without_a_prefix_meet_few_resources(spark):
    """Two hundred patterns with text of their own: candidates are those that hold it, not all pairs."""
    assets = [(f"urn:lake:t{i}:name{i}x", {}) for i in range(200)]
    rows = obligations(spark, *[obligation(i, None, [f"*:name{i}?"], retention=retention(1)) for i in range(200)])
    found = match_obligations(resources(spark, *assets), rows)
    assert sorted((r.urn, r.ord) for r in found.collect()) == sorted((u, i) for i, (u, _) in enumerate(assets))


def test_a_resource_without_a_project_has_its_policy(spark):
    """Rules without a project hold for it too; it must not fall back to the empty, open policy."""
    rows = obligations(spark, obligation(0, None, ["urn:*"], retention=retention(30)))
    assets = resources(spark, ("urn:x:a", {}), ("urn:x:b", {})).withColumn("project_id", F.expr("CASE WHEN urn = 'urn:x:b' THEN 'p' END"))
    found = resolve_policies(assets, rows)
    assert {(r.project_id, r.resource_urn, r.retention.duration_s) for r in found.collect()} == {(None, "urn:x:a", 30 * 86400), ("p", "urn:x:b", 30 * 86400)}


def test_equal_targets_are_matched_once(spark):
    """Forty contracts with one and the same glob are one shape: candidates don't grow with resources times contracts."""
    globs = ["urn:lake:prod:a*", "urn:?ake:*7"]
    rules = [obligation(i, None, [*globs, f"urn:lake:prod:x{i}"], retention=retention(i + 1)) for i in range(40)]
    rows = obligations(spark, *rules, obligation(40, "w", ["urn:lake:prod:a*"], retention=retention(99)))
    assets = [("urn:lake:prod:a7", {}), ("urn:lake:prod:a8", {}), ("urn:lake:prod:x3", {}), ("urn:lake:prod:y", {})]
    fits, members = match_shapes(resources(spark, *assets), rows)
    assert fits.count() == 4 and members.count() == 121 and members.select("shape").distinct().count() == 42
    found = {(r.urn, r.ord) for r in match_obligations(resources(spark, *assets), rows).collect()}
    assert found == brute(assets, [(i, [*globs, f"urn:lake:prod:x{i}"], [], {}) for i in range(40)] + [(40, globs[:1], [], {})])


def test_a_rule_of_several_shapes_counts_once_per_row(spark):
    """Two include globs that both hit are one rule; a resource that comes twice still has each of its rules twice."""
    rows = obligations(spark, obligation(0, None, ["urn:x:*", "*:a", "urn:x:a"], retention=retention(5)), obligation(1, None, ["*:a"], retention=retention(9)))
    assets = resources(spark, ("urn:x:a", {}), ("urn:x:b", {}), ("urn:x:b", {}))
    found = sorted((r.resource_urn, r.contributing_obligation_ids) for r in resolve_policies(assets, rows).collect())
    assert found == [("urn:x:a", ["o0", "o1"]), ("urn:x:b", ["o0", "o0"]), ("urn:x:b", ["o0", "o0"])]


def test_conflicts_of_many_settings(spark):
    """The verdict follows the rules in order: weaker ones after a stronger are ignored, parameterless ones agree with all."""
    sets = [
        [(0, {"a": "1"}), (4, {}), (0, {"a": "2"})], [(0, {"a": "1"}), (0, {"b": "2"}), (0, {"a": "2"}), (4, {})],
        [(4, {"a": "1"}), (1, {"a": "1"}), (1, {"a": "2"})], [(1, {"a": "1", "b": "2"}), (1, {"b": "2"}), (1, {"a": "1"})],
        [(2, {"k": "1"}), (2, {"k": "2"})], [(3, {"epsilon": "1"}), (3, {"epsilon": "2"})], [(1, {}), (1, {"a": "1"})],
    ]
    rows = [obligation(i * 10 + j, None, [f"urn:x:{i}"], privacy=privacy(m, **v)) for i, s in enumerate(sets) for j, (m, v) in enumerate(s)]
    found = resolve_policies(resources(spark, *[(f"urn:x:{i}", {}) for i in range(len(sets))]), obligations(spark, *rows))
    assert [r.conflict for r in found.orderBy("resource_urn").select("privacy.conflict").collect()] == [False, True, False, False, False, False, False]


def test_keys_of_a_resource_are_compiled_and_unique(spark):
    """A list of keys that is exploded as it is made is interpreted; grams that repeat in a urn are owned once."""
    lean = spark.createDataFrame(
        [("p", "urn:abab:abab:", {"env": "prod", "none": None}), ("p", None, {}), ("p", "x", {})],
        "project_id string, r_urn string, r_tags map<string,string>",
    )
    kinds = _owned(lean, [3, 12])
    for kind in kinds:
        plan = kind._jdf.queryExecution().executedPlan().toString()
        assert "lambdafunction" not in plan
    keys = [(r.r_urn, r.key) for kind in kinds for r in kind.collect() if r.key is not None]
    assert len(keys) == len(set(keys))
    urn, marked = "urn:abab:abab:", "\u0002urn:abab:abab:\u0003"
    assert {k for u, k in keys if u == urn and k[:2] != "g:"} == {"t:env\u0001prod", "p:urn:", "p:urn:abab:", "p:" + urn, "o:"}
    assert {k for u, k in keys if u == urn and k[:2] == "g:"} == {"g:" + marked[i : i + n] for n in (3, 12) for i in range(17 - n)}
    assert {k for u, k in keys if u is None} == {"o:"} and {k for u, k in keys if u == "x"} == {"p:x", "o:", "g:\u0002x\u0003"}


def test_asked_keys_are_met_by_number_and_told_by_text(spark, monkeypatch):
    from govspark.operators import match

    lean = spark.createDataFrame(
        [("p", "urn:abab:abab:", {"env": "prod"}), ("p", "x", {})], "project_id string, r_urn string, r_tags map<string,string>"
    )
    asked = spark.createDataFrame([(k, k == "o:") for k in ("g:bab", "g:urn", "g:zzz", "t:env\u0001prod", "p:urn:", "o:")], "key string, hot boolean")
    expected = {("urn:abab:abab:", k, False) for k in ("g:bab", "g:urn", "t:env\u0001prod", "p:urn:")} | {(u, "o:", True) for u in ("urn:abab:abab:", "x")}

    def met():
        return [(r.r_urn, r.key, r.hot) for kind in _owned(lean, [3], asked) for r in kind.collect()]

    grams = _owned(lean, [3], asked)[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "_number" in line for line in grams.splitlines())
    assert sorted(met()) == sorted(expected)
    # All grams share one number: the text still tells them apart.
    monkeypatch.setattr(match.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
    assert sorted(met()) == sorted(expected)


def test_many_globs_from_one_file_are_dealt(spark, monkeypatch):
    from govspark.operators import match

    parts = []
    monkeypatch.setattr(match, "_selectors", lambda o, gram, real=match._selectors: parts.append(o.rdd.getNumPartitions()) or real(o, gram))
    rules = obligations(spark, *[obligation(i, include=[f"a:*{i}"], retention=retention(5)) for i in range(40)]).coalesce(1)
    assert match_obligations(resources(spark, ("a:x:1", {})), rules).count() == 1
    assert parts == [spark.sparkContext.defaultParallelism]


def test_tags_of_resources_are_compiled(spark, sf_dir):
    from workload.tables import Tables, present_map

    plan = Tables(spark, sf_dir).resources()._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    rows = spark.createDataFrame([("1", None), (None, None), ("1", "2")], "a string, b string")
    found = [r.m for r in rows.select(present_map({"a": F.col("a"), "b": F.col("b")}).alias("m")).collect()]
    assert found == [{"a": "1"}, {}, {"a": "1", "b": "2"}]


def test_changes_are_compiled(spark):
    from govspark.operators.change import diff_policies

    old = resolve_policies(resources(spark, ("a:x:1", {})), obligations(spark, obligation(1, include=["a:*"], retention=retention(5))))
    new = resolve_policies(resources(spark, ("a:x:1", {})), obligations(spark, obligation(1, include=["a:*"], retention=retention(3))))
    found = diff_policies(old, new)
    lines = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in x]
    assert lines and not any("CASE WHEN" in x for x in lines)
    assert [(r.category, r.impact) for r in found.collect()] == [("Retention", "RESTRICTIVE")]
