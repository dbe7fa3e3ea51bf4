"""Mix sources to target weights by Pareto order sampling.

Sources get a share of ``budget`` times all words by weight, at most ``max_repeat`` times their own words; what is over
is shared again by weight. A document of a source that is to be read r times gets floor(r) certain copies; the rest is
a sample without replacement with inclusion probability p (the fraction left): documents are ranked by the odds of a
random number divided by the odds of p, and taken in that order until the source's words are as near its target as
whole documents allow. The error is at most half of the one document at the cut.

Random numbers come from a hash of seed and doc_id, so reruns agree. The cut is found without sorting a source: word
sums by rank bucket (combined before the shuffle), then only the documents of the bucket that holds the cut are
ordered. What documents are judged by is one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.llm.common import WORD, Scratch, collision_free, table
from govspark.llm.registry import query

WEIGHTS = (3, 1, 2)
BUDGET, MAX_REPEAT = 1.5, 2.0
SEED = "mix-1"
BUCKETS = 65_536


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_repeat: float) -> DataFrame:
    """One row per source (source, source_size, target). Weights go to sources by code point, null last, and repeat."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), "source")  # one row per source
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    everything = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "all_words": F.sum("source_size").over(everything) * F.lit(budget),
            "all_weight": F.sum("weight").over(everything),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("all_words") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    # Sources in order of cap per weight: the first that stays below its cap sets the level for all after it.
    ranked = ranked.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    ranked = ranked.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap"))
    return ranked.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 from the hash of seed and id (null: empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def _odds(p: Column) -> Column:
    return p / (F.lit(1.0) - p)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_repeat: float = MAX_REPEAT,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (size times copies); columns of those names are replaced.

    A null text has no words. Null sources form the last source. Rows with the same doc_id share their random number and
    are ranked by text hash; of rows equal in both at the cut, as many are taken as the target needs. Documents without words never matter for a
    target; they get the copies of their rank. Empty input gives no rows.
    """
    spark, work = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    rank, place, mark, whole, p, first_place, last, tied = collision_free(
        docs.columns, "mix_rank", "mix_place", "mix_text_hash", "mix_whole", "mix_p", "mix_first", "mix_last", "mix_tied"
    )
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own = F.coalesce(F.xxhash64("text"), F.lit(0))
    narrow = work.write(docs.select("doc_id", "source", size.alias("size"), own.alias(mark)), "sizes")
    targets = work.write(source_targets(narrow, weights, budget, max_repeat), "targets")
    plan = targets.withColumn("times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn(whole, F.floor("times").cast("long")).withColumn(p, F.col("times") - F.col(whole))
    plan = plan.withColumn("open", F.col("target") - F.col(whole) * F.col("source_size"))

    def ranked(rows: DataFrame, by: DataFrame, *columns: str) -> DataFrame:
        by = by.select(F.col("source").alias(f"{rank}_source"), *columns)
        rows = rows.join(by, rows["source"].eqNullSafe(by[f"{rank}_source"])).drop(f"{rank}_source")
        value = F.when(F.col(p) > 0, _odds(uniform(F.col("doc_id"), seed)) / _odds(F.col(p)))
        rows = rows.withColumn(rank, value)
        return rows.withColumn(place, F.floor(F.col(rank) / (F.lit(1.0) + F.col(rank)) * BUCKETS).cast("int"))

    candidates = ranked(narrow, plan, p, "open").where(F.col(rank).isNotNull())
    sums = candidates.groupBy("source", place, "open").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy(place)
    sums = sums.withColumn("after", F.sum("words").over(upto)).withColumn("before", F.col("after") - F.col("words"))
    cut = work.write(sums.where("before < open AND open <= after").select("source", place, "before"), "buckets")
    cut = cut.select(F.col("source").alias("cut_source"), F.col(place).alias("cut_place"), "before")
    near = candidates.join(cut, candidates["source"].eqNullSafe(cut["cut_source"]) & (candidates[place] == cut["cut_place"]))
    # Equal rows are one entry, so a bucket has as many as it has different documents.
    key = F.struct(F.col(rank), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col(mark))
    near = near.groupBy("source", "before", "open", "size", key.alias("key")).agg(F.count("*").alias("n"))
    order = W.partitionBy("source").orderBy("key")
    upto = F.col("before") + F.sum(F.col("n") * F.col("size")).over(order.rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumns({"after": upto, "prior": F.lag(F.struct("key", F.col("n").alias("n_taken"), "n")).over(order)})
    near = near.withColumn("under", F.col("after") - F.col("n") * F.col("size")).where("under < open AND open <= after")
    # The document across the cut is in if that is at least as near the target.
    row = F.ceil((F.col("open") - F.col("under")) / F.col("size"))
    reached = F.col("under") + row * F.col("size")
    near = near.withColumn("n_taken", row - (reached - F.col("open") > F.col("open") - (reached - F.col("size"))).cast("long"))
    # The last document taken, and how many of the rows equal to it; where none of the bucket is, all of the buckets before it are.
    taken_last = F.when(F.col("n_taken") > 0, F.struct("key", "n_taken", "n")).otherwise(F.col("prior"))
    taken_last = near.select("source", taken_last.alias(last))
    first = cut.select(F.col("cut_source").alias("source"), F.col("cut_place").alias(first_place))
    edge = plan.join(first, plan["source"].eqNullSafe(first["source"]), "left").drop(first["source"])
    edge = edge.join(taken_last, edge["source"].eqNullSafe(taken_last["source"]), "left").drop(taken_last["source"])
    edge = work.write(edge, "edges")

    rows = docs.withColumns({"size": size, mark: own})
    rows = ranked(rows, edge, "source_size", "target", whole, p, first_place, last)
    here = F.col(place) == F.col(first_place)
    rows = rows.withColumn(tied, here & (key == F.col(last)["key"]) & (F.col(last)["n_taken"] < F.col(last)["n"]))
    in_ = (F.col(place) < F.col(first_place)) | (here & (key <= F.col(last)["key"]))
    if edge.where(F.col(last)["n_taken"] < F.col(last)["n"]).isEmpty():
        chosen = rows.withColumn("copies", F.col(whole) + F.coalesce(in_, F.lit(False)).cast("long"))
    else:
        plain = rows.where(~F.coalesce(tied, F.lit(False)))
        plain = plain.withColumn("copies", F.col(whole) + F.coalesce(in_, F.lit(False)).cast("long"))
        ties = _numbered(rows.where(tied), work, place, rank)
        ties = ties.withColumn("copies", F.col(whole) + (F.col(place) <= F.col(last)["n_taken"]).cast("long"))
        chosen = plain.unionByName(ties)
    chosen = chosen.withColumn("taken", F.col("size") * F.col("copies"))
    return chosen.drop(rank, place, mark, whole, p, first_place, last, tied)


def _numbered(rows: DataFrame, work: Scratch, number: str, part: str) -> DataFrame:
    """Rows numbered from 1 in ``number`` inside their source, however many; ``part`` is a column that may be overwritten.

    Each task numbers its own rows, and a table of tasks and sources says where each starts.
    """
    rows = work.write(rows.withColumns({part: F.spark_partition_id().cast("double"), number: F.monotonically_increasing_id()}), "ties")
    counts = rows.groupBy("source", F.col(part).alias("mix_task")).agg(F.count("*").alias("mix_n"))
    before = F.coalesce(F.sum("mix_n").over(W.partitionBy("source").orderBy("mix_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("source").alias("mix_source"), "mix_task", before.alias("mix_before"))
    rows = rows.withColumn(number, F.row_number().over(W.partitionBy("source", part).orderBy(number)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["mix_source"]) & (rows[part] == starts["mix_task"]))
    return rows.withColumn(number, F.col(number) + F.col("mix_before")).drop("mix_source", "mix_task", "mix_before")


_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    (('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, WEIGHTS))}][turn % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, source_size * {MAX_REPEAT}::DOUBLE AS cap FROM s),
v AS (
  SELECT *, sum(source_size) OVER () * {BUDGET}::DOUBLE AS all_words, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before
  FROM w),
l AS (SELECT *, (all_words - cap_before) / (all_weight - weight_before) AS level FROM v),
t AS (
  SELECT source, source_size, least(coalesce((SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap), cap) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times FROM t),
q AS (SELECT *, floor(times) AS whole, times - floor(times) AS p, target - floor(times) * source_size AS open FROM p),
r AS (
  SELECT d.doc_id, d.size, q.*, CASE WHEN q.p > 0 THEN (u / (1.0 - u)) / (q.p / (1.0 - q.p)) END AS rank
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS after FROM r),
e AS (SELECT *, p > 0 AND after - open <= open - (after - size) AS extra FROM c)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM e
"""


@query("op4_mix_sources", _SQL)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents to 150 % of their words under weights 3, 1, 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
