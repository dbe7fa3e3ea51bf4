"""URL filter: a blocked Bloom filter passes possible hits on to an exact hash join.

The filter has 256-bit blocks of eight 32-bit words. An address picks one block and sets one bit in each of its
words. The blocks are made by one aggregation (bitwise or, combined before the shuffle), so that nothing but finished
blocks moves. Their number grows with the list up to ``MAX_BLOCKS`` (2 MB), a proven bound, which is why the filter may be
broadcast; beyond about half a million addresses more pages pass it falsely, and the join that follows removes those all
the same. Pages that the filter rules out are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, collision_free, lower_ascii, table
from govspark.llm.registry import query

MAX_BLOCKS = 1 << 16
KEYS_PER_BLOCK = 16
#: (host, path, verdict); a rule holds for its host and all hosts below it.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without ``.html`` and last slash, query without ``utm_`` parts; null if the host is empty."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html)?/?$", "")
    asked = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(asked, "&"), lambda p: ~p.startswith("utm_") & (p != "")), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null. ``rules`` is a short list of settings, not a table."""
    chosen = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r_host, r_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        chosen = F.when(fits, F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _bits(key: Column) -> list[Column]:
    """One bit for each of the eight words: five bits of a second hash choose it."""
    hashed = F.xxhash64(key, F.lit("bits"))
    place = lambda w: F.shiftright(hashed, 5 * w).bitwiseAND(F.lit(31)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), place(w)) for w in range(8)]


def build_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (block, w0 ... w7), at most ``blocks`` of them."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = listed.select(block.alias("block"), *[b.alias(f"w{w}") for w, b in enumerate(_bits(F.col(key)))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(8)])


def flag_listed(pages: DataFrame, url: str, listed: DataFrame) -> DataFrame:
    """All rows of ``pages`` with a column ``listed``: is the canonical form of ``url`` one of ``listed.url``'s?

    Addresses without a host are never listed. Repeated rows stay, each with its verdict; repeated, null or host-less
    entries of the list don't matter; an empty list flags nothing. A column ``listed`` of ``pages`` is replaced.
    """
    spark = pages.sparkSession
    pages = pages.drop("listed")
    key, block, maybe = collision_free(pages.columns, "canonical_url", "bloom_block", "maybe_listed")
    work = Scratch(spark, "url-filter")
    names = work.write(listed.select(canonical(F.col("url")).alias(key)).where(F.col(key).isNotNull()).distinct(), "listed")
    blocks = min(MAX_BLOCKS, 1 << (max(1, names.count() // KEYS_PER_BLOCK) - 1).bit_length())
    bloom = work.write(build_filter(names, key, blocks), "filter").withColumnRenamed("block", block)
    words = collision_free(pages.columns, *[f"bloom_w{w}" for w in range(8)])
    bloom = bloom.withColumnsRenamed({f"w{w}": n for w, n in enumerate(words)})
    keyed = pages.withColumn(key, canonical(F.col(url))).withColumn(block, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    tested = keyed.join(F.broadcast(bloom), block, "left")  # at most MAX_BLOCKS rows of 72 bytes
    passes = F.lit(True)
    for n, b in zip(words, _bits(F.col(key)), strict=True):
        passes &= F.col(n).bitwiseAND(b) != 0
    tested = tested.withColumn(maybe, F.coalesce(passes & F.col(key).isNotNull(), F.lit(False))).drop(block, *words)
    # Hits alone carry a key into the join; all else has a null there, and the outer join keeps such rows where they are.
    sure = tested.where(~F.col(maybe)).drop(key, maybe).withColumn("listed", F.lit(False))
    found = names.withColumn("listed", F.lit(True))
    hits = tested.where(maybe).join(found, key, "left").drop(key, maybe)
    return sure.unionByName(hits.withColumn("listed", F.coalesce("listed", F.lit(False))))


def filter_urls(pages: DataFrame, url: str, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with host, path, rule, verdict: the longest rule decides, else the list (block) or allow.

    Columns of those names are replaced; a null address has empty host and path and is allowed.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    (chosen,) = collision_free(pages.columns, "chosen_rule")
    flagged = flag_listed(pages, url, listed)
    flagged = flagged.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    flagged = flagged.withColumn(chosen, rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return flagged.withColumns({"rule": F.col(chosen)["rule"], "verdict": F.coalesce(F.col(chosen)["verdict"], own)}).drop(chosen, "listed")


def _sql_rule() -> tuple[str, str]:
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')" for h, p, _ in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True))
    return rule, verdict


_RULE, _VERDICT = _sql_rule()
_SQL = rf"""
WITH a AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS asked FROM a),
c AS (
  SELECT *, array_to_string(list_filter(string_split(asked, '&'), lambda p: NOT starts_with(p, 'utm_') AND p <> ''), '&') AS kept FROM b),
d AS (
  SELECT *, CASE WHEN regexp_replace(host, '^www\.', '') <> '' THEN regexp_replace(host, '^www\.', '')
    || regexp_replace(path, '(\.html)?/?$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon FROM c),
listed AS (SELECT DISTINCT canon FROM d JOIN labels l ON l.doc_id = d.page_id WHERE (l.quality = 0 OR l.toxic = 1) AND canon IS NOT NULL)
SELECT page_id, host, path, {_RULE} AS rule,
  {_VERDICT} WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM d
"""


@query("op8_url_filter", _SQL)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page; listed are the addresses of pages whose id is labelled toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = table(spark, sf_dir, "labels").where("quality = 0 OR toxic = 1").select(F.col("doc_id").alias("page_id")).distinct()
    listed = pages.join(bad, "page_id", "left_semi").select("url")
    return filter_urls(pages, "url", listed, RULES).select("page_id", "host", "path", "rule", "verdict")
