"""Obligations matched to resources, and purposes matched to groups.

A selector applies to a resource when no exclude glob hits, every required tag is equal, and some
include glob hits (or none is given but tags are). Many obligations say the same of their target, so each
distinct test, called a shape, is matched once: the project, excludes, tags and one include glob (all of
them, where a required tag finds the resources). Obligations are members of their shapes. Instead of testing
all pairs, every shape gets one equality key that a matching resource must own, and one hash join gives the
candidates to test:

* a tag key   - one required ``key=value`` pair;
* a prefix key - the literal text of an include glob up to its last colon (or all of it, when it
                 has no wildcard), against the prefixes of the urn;
* a gram key  - for a glob without such a prefix: ``GRAM`` characters in a row of its literal text, or two or
                 four times as many where the text is as long, with marks for the urn's start and end, against
                 the grams of the urn. Literal text shorter than ``GRAM`` is a key as a whole;
* the open key - what has no literal text at all meets every resource.

Where a shape can choose (several pairs, several grams of a glob), one count over the resources
names the key that the fewest own. A key that more than one in ``spread`` resources own is split: each
resource belongs to one of ``spread`` parts and the shape is repeated for each part, so no key
gathers all resources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.functions import glob_regex
from govspark.session import materialize

_WILDCARD = r"[*?\[]"
_STRINGS = "array<string>"
_TAG, _PREFIX, _GRAM, _OPEN = "t:", "p:", "g:", "o:"
GRAM = 3
# Stand for the ends of a urn, so that a gram can say "starts with" and "ends with".
_START, _END = "\u0002", "\u0003"


def _pair(tag: Column) -> Column:
    return F.concat(F.lit(_TAG), tag["key"], F.lit("\u0001"), tag["value"])


def _literal_prefix(pattern: Column) -> Column:
    """Text of a glob that every match must start with: all of it, or up to the last colon."""
    literal = F.regexp_extract(pattern, r"^([^*?\[]*)", 1)
    return F.when(pattern.rlike(_WILDCARD), F.regexp_extract(literal, r"^(.*:)", 1)).otherwise(pattern)


def _is_selective(prefix: Column) -> Column:
    """A prefix is worth a key when it names more than the scheme of the urn."""
    return F.length(prefix) - F.length(F.replace(prefix, F.lit(":"), F.lit(""))) >= 2


def _any_of(globs: Column) -> Column:
    """One regex that hits where any of the globs does; without globs it is no test at all."""
    return F.array_join(F.transform(globs, lambda p: F.concat(F.lit("(?:"), glob_regex(p), F.lit(")"))), "|")


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def _marked(text: Column) -> Column:
    return F.concat(F.lit(_START), text, F.lit(_END))


def _glob_keys(pattern: Column, gram: int) -> Column:
    """Keys of which every match of a glob owns all: its prefix alone, if that is selective, or grams of its literal text.

    Text between a bracket and the last closing one is taken for no literal; that only loses keys.
    """
    pieces = F.filter(
        F.split(_marked(pattern), r"(?s)\[.*\]|[*?]+"), lambda t: (t != "") & (t != _START) & (t != _END)
    )
    long = F.filter(pieces, lambda t: F.char_length(t) >= gram)

    def sized(text: Column) -> Column:
        held = F.char_length(text)
        return F.when(held >= 4 * gram, _grams(text, 4 * gram)).when(held >= 2 * gram, _grams(text, 2 * gram)).otherwise(_grams(text, gram))

    chosen = F.when(F.size(long) > 0, F.flatten(F.transform(long, sized))).otherwise(pieces)
    grams = F.transform(F.array_distinct(chosen), lambda g: F.concat(F.lit(_GRAM), g))
    prefix = _literal_prefix(pattern)
    return (
        F.when(_is_selective(prefix), F.array(F.concat(F.lit(_PREFIX), prefix)))
        .when(F.size(grams) > 0, grams)
        .otherwise(F.array(F.lit(_OPEN)))
    )


def _selectors(obligations: DataFrame, gram: int) -> DataFrame:
    """(sel, ord, scope, exclude_any, literal, include_any, tags, choice, earlier): the tests of which a selector needs one to hit.

    ``literal`` is the text that a lone include glob begins with, ``choice`` lists keys of which one is enough, ``earlier`` is the regex of the include globs that come before this
    one. Selectors that can never match are dropped. A tag required to be '' also matches a missing tag, so it is no key.
    """
    target = F.col("target")
    include = F.array_distinct(F.coalesce(target["include_patterns"], F.array().cast(_STRINGS)))
    exclude = F.coalesce(target["exclude_patterns"], F.array().cast(_STRINGS))
    tags = F.coalesce(F.map_entries(target["match_tags"]), F.array().cast("array<struct<key:string,value:string>>"))
    pairs = F.transform(F.filter(tags, lambda t: t["value"] != ""), _pair)

    def test(globs: Column, choice: Column, earlier: Column) -> Column:
        literal = F.when(F.size(globs) == 1, F.regexp_extract(F.get(globs, F.lit(0)), r"^([^*?\[]*)", 1)).otherwise("")
        return F.struct(
            literal.alias("literal"), _any_of(globs).alias("include_any"), choice.alias("choice"), _any_of(earlier).alias("earlier")
        )

    none = F.array().cast(_STRINGS)
    tests = (
        F.when(F.size(pairs) > 0, F.array(test(include, pairs, none)))
        .when(F.size(include) == 0, F.array(test(include, F.array(F.lit(_OPEN)), none)))
        .otherwise(F.transform(include, lambda p, i: test(F.array(p), _glob_keys(p, gram), F.slice(include, F.lit(1), i))))
    )
    # Numbered before a row per test is made of each.
    numbered = obligations.filter((F.size(include) > 0) | (F.size(tags) > 0)).withColumn("sel", F.monotonically_increasing_id())
    made = numbered.select(
        "sel",
        "ord",
        F.col("project_id").alias("scope"),
        _any_of(exclude).alias("exclude_any"),
        F.array_sort(tags).alias("tags"),
        tests.alias("tests"),
    )
    return made.select("sel", "ord", "scope", "exclude_any", "tags", F.inline("tests"))


def _text_keys(lean: DataFrame) -> list[DataFrame]:
    """``lean`` with a row for every tag, for every prefix, and for the whole urn and the open key."""
    columns, urn = lean.columns, F.col("r_urn")
    colons = F.length(urn) - F.length(F.replace(urn, F.lit(":"), F.lit("")))
    tags = lean.select(*columns, F.explode("r_tags").alias("_key", "_value"))
    ended = lean.filter(colons > 0).select(*columns, F.explode(F.sequence(F.lit(1), colons)).alias("_at"))
    prefix = F.concat(F.call_function("substring_index", urn, F.lit(":"), F.col("_at")), F.lit(":"))
    return [
        tags.select(*columns, F.concat(F.lit(_TAG), "_key", F.lit("\u0001"), "_value").alias("key")),
        ended.filter(prefix != urn).select(*columns, F.concat(F.lit(_PREFIX), prefix).alias("key")),
        lean.select(*columns, F.explode(F.array(F.concat(F.lit(_PREFIX), urn), F.lit(_OPEN))).alias("key")),
    ]


def _cut(lean: DataFrame, n: int) -> tuple[DataFrame, Column]:
    """``lean`` with a row for every position ``_at`` of ``n`` characters in the marked urn ``_text``, and the gram there."""
    long = lean.withColumn("_text", _marked(F.col("r_urn"))).filter(F.char_length("_text") >= n)
    at = long.select("*", F.explode(F.sequence(F.lit(1), F.char_length("_text") - (n - 1))).alias("_at"))
    return at, F.substr("_text", F.col("_at"), F.lit(n))


def _owned(lean: DataFrame, lengths: list[int], asked: DataFrame | None = None) -> list[DataFrame]:
    """``lean`` with a row for every key that a resource owns, by kind: tags, prefixes, whole urns, and the grams of each of ``lengths``.

    No key is there twice: a gram counts where it is first in the urn. Keys are cut by position, one in a row. Spark compiles
    that; a list of them made by lambdas and exploded at once is interpreted, at a many times higher price. With ``asked``
    (key, once each, and other columns) only the keys in it are there, with its columns.
    """
    columns = lean.columns
    kinds = _text_keys(lean)
    if asked is not None:
        more = [c for c in asked.columns if c != "key"]
        kinds = [kind.join(asked, "key").select(*columns, "key", *more) for kind in kinds]
    for n in lengths:
        at, gram = _cut(lean, n)
        if asked is None:
            kinds.append(at.filter(F.instr(F.col("_text"), gram) == F.col("_at")).select(*columns, F.concat(F.lit(_GRAM), gram).alias("key")))
            continue
        # Few grams are asked, so each looks itself up by number; where the asked gram is first decides, whatever has its number.
        sized = asked.filter(F.col("key").startswith(_GRAM) & (F.char_length("key") == n + len(_GRAM)))
        wanted = sized.select(_number(F.col("key")).alias("_number"), F.substr("key", F.lit(len(_GRAM) + 1)).alias("_gram"), *more)
        found = at.withColumn("_number", F.xxhash64(F.lit(_GRAM), gram)).join(wanted, "_number")
        first = found.filter(F.instr(F.col("_text"), F.col("_gram")) == F.col("_at"))
        kinds.append(first.select(*columns, F.concat(F.lit(_GRAM), "_gram").alias("key"), *more))
    return kinds


def _number(key: Column) -> Column:
    """A key as 64 bits, the kind apart from the text. They say how common a key is, and which may be equal."""
    return F.xxhash64(F.substring(key, 1, len(_GRAM)), F.substr(key, F.lit(len(_GRAM) + 1)))


def _chosen_keys(shapes: DataFrame, lean: DataFrame, lengths: list[int], spread: int) -> tuple[DataFrame, list[str]]:
    """(shape, key) with the rarest key of each choice, and the keys owned by more than one in ``spread`` resources.

    A resource owns a bounded number of keys, so at most ``spread`` times that many are so common. Counts are by number, and
    a gram counts as often as it comes in a urn: they name the key to search by, never what is found.
    """
    wanted = shapes.select("shape", F.explode("choice").alias("key"))
    asked = materialize(wanted.select("key").distinct().withColumn("_number", _number(F.col("key"))))
    numbers = [kind.select(_number(F.col("key")).alias("_number")) for kind in _text_keys(lean)]
    for n in lengths:
        at, gram = _cut(lean, n)
        numbers.append(at.select(F.xxhash64(F.lit(_GRAM), gram).alias("_number")))
    met = reduce(DataFrame.unionByName, [kind.join(asked.select("_number"), "_number", "left_semi") for kind in numbers])
    counts = materialize(asked.join(met.groupBy("_number").agg(F.count("*").alias("n")), "_number").select("key", "n"))
    # A key that no resource owns gets n = 0: its shape matches nothing and joins with nothing.
    rarest = F.min_by("key", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key").alias("k")))
    keys = wanted.join(counts, "key", "left").groupBy("shape").agg(rarest.alias("key"))
    # The open key is owned by all, so its count is that of the resources; without it the commonest stands in.
    total = counts.agg(F.max("n").alias("n")).first().n or 0
    hot = [row.key for row in counts.filter(F.col("n") * spread > max(total, spread)).collect()]
    return keys, hot


def _tag_ok(resource_tags: Column, required: Column) -> Column:
    """Text equality in which a missing tag counts as the empty string."""
    return F.forall(
        required, lambda t: F.coalesce(F.try_element_at(resource_tags, t["key"]), F.lit("")) == t["value"]
    )


def match_shapes(
    resources: DataFrame, obligations: DataFrame, spread: int = 64, gram: int = GRAM
) -> tuple[DataFrame, DataFrame]:
    """(project_id, urn, shape) of every resource and shape that fits it, and the members (shape, sel, ord, earlier).

    ``sel`` numbers the active obligations. One with several include globs is a member of several shapes.
    """
    if "is_active" in obligations.columns:
        obligations = obligations.filter(F.coalesce("is_active", F.lit(True)))
    # Regexes are built once per obligation and reused by the steps below.
    content = ["scope", "exclude_any", "literal", "include_any", "tags"]
    form = F.sha2(F.to_json(F.struct(*content)), 256).alias("form")
    # Their globs become regexes by lambdas, which takes time: they are dealt to all cores, from however few files they come.
    cores = obligations.sparkSession.sparkContext.defaultParallelism
    dealt = obligations.select("project_id", "ord", "target").repartition(cores, "ord")
    selectors = materialize(_selectors(dealt, gram).select("*", form))
    distinct = selectors.groupBy("form").agg(F.any_value(F.struct(*content, "choice")).alias("s"))
    # Written out with their numbers, so that each step sees the same ones.
    shapes = materialize(distinct.select("form", "s.*", F.monotonically_increasing_id().alias("shape")))
    members = materialize(selectors.join(shapes.select("form", "shape"), "form").select("shape", "sel", "ord", "earlier"))

    no_tags = F.from_json(F.lit("{}"), "map<string,string>")
    # The urn takes a new name on purpose. Catalyst numbers lambda variables from 0 when it compares expressions, and
    # the first columns of a session have these numbers too: a lambda that names such a column loses it from its
    # references, and the test is pushed to the side of the join that lacks the column.
    lean = resources.select("project_id", F.col("urn").alias("r_urn"), F.coalesce("tags", no_tags).alias("r_tags"))
    # A small inventory may come in one file, but each row becomes many keys: all cores take part.
    # Written out, as the inventory is read for the counts and again for the join.
    lean = materialize(lean.repartition("r_urn"))
    urn, key = F.col("r_urn"), F.col("key")
    asked = shapes.select(F.explode("choice").alias("key")).filter(key.startswith(_GRAM))
    lengths = [row.n for row in asked.select((F.char_length("key") - len(_GRAM)).alias("n")).distinct().collect()]
    lengths = sorted(lengths)

    if shapes.filter(F.size("choice") > 1).isEmpty():
        keyed, hot = shapes.withColumn("key", F.get("choice", F.lit(0))), [_OPEN]
    else:
        chosen, hot = _chosen_keys(shapes, lean, lengths, spread)
        keyed = shapes.join(chosen, "shape")
    keyed = keyed.withColumn("hot", key.isin(hot))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    # Written out, so that the joins below know the true sizes: when they are small the resources are streamed past them
    # and not shuffled. Most keys of a resource are nobody's: they leave before anything else is computed for them.
    keyed = materialize(keyed.select("shape", *content, "key", "hot", F.explode(parts).alias("part")))
    used = materialize(keyed.select("key", "hot").distinct())
    keyed = keyed.drop("hot")
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("r_urn"), F.lit(spread)).cast("int")).otherwise(F.lit(0))

    asked_of = [kind.withColumn("part", part) for kind in _owned(lean, lengths, used)]
    met = reduce(DataFrame.unionByName, asked_of).join(keyed, ["key", "part"])
    fits = met.filter(
        (F.col("scope").isNull() | (F.col("scope") == F.col("project_id")))
        # A regex is compiled for each pair, so the plain test of its literal text comes first.
        & ((F.col("literal") == "") | urn.startswith(F.col("literal")))
        & ((F.col("exclude_any") == "") | ~F.rlike(urn, F.col("exclude_any")))
        & _tag_ok(F.col("r_tags"), F.col("tags"))
        & ((F.col("include_any") == "") | F.rlike(urn, F.col("include_any")))
    )
    return fits.select("project_id", F.col("r_urn").alias("urn"), "shape"), members


def match_obligations(
    resources: DataFrame, obligations: DataFrame, spread: int = 64, gram: int = GRAM
) -> DataFrame:
    """(project_id, urn, ord) of every resource and active obligation that applies to it.

    An obligation without a project applies to all projects. ``ord`` must be unique.
    """
    fits, members = match_shapes(resources, obligations, spread, gram)
    # A resource may fit several shapes of one obligation; the first of its include globs counts.
    first = (F.col("earlier") == "") | ~F.rlike("urn", F.col("earlier"))
    return fits.join(members, "shape").filter(first).select("project_id", "urn", "ord")


def resolve_groups(policies: DataFrame, mapping: DataFrame, defaults: list[str]) -> DataFrame:
    """Groups allowed per resource: the defaults plus the groups of each allowed purpose.

    ``mapping`` holds (purpose, group). Unknown purposes add nothing.
    """
    keys = [c for c in ("project_id", "resource_urn") if c in policies.columns]
    purposes = policies.select(*keys, F.explode(F.array_distinct("purpose.allowed_purposes")).alias("purpose"))
    wanted = purposes.select(*keys, F.upper(F.trim("purpose")).alias("purpose"))
    known = mapping.select(F.upper(F.trim("purpose")).alias("purpose"), "group").distinct()
    found = wanted.join(known, "purpose").groupBy(*keys).agg(F.collect_set("group").alias("found"))
    always = F.array(*[F.lit(g) for g in defaults]).cast(_STRINGS)
    return policies.select(*keys).join(found, keys, "left").select(
        *keys,
        F.array_sort(F.array_union(always, F.coalesce("found", F.array().cast(_STRINGS)))).alias("groups"),
    )
