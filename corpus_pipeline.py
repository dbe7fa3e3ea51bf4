"""Corpus pipeline: quality classifier, near duplicates, repeated passages, source mix, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.additive import THRESHOLD, score, train, with_features
from govspark.llm.common import Scratch, collision_free, table
from govspark.llm.mixing import mix_sources
from govspark.llm.pieces import encode_pieces
from govspark.llm.simhash import keep_first
from govspark.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the table of labels, doesn't reject. Equal ids share the better verdict."""
    work = Scratch(spark, "stage-quality")
    features = work.write(with_features(docs), "features")
    scored = score(features, train(features, table(spark, sf_dir, "labels")))
    (good,) = collision_free(docs.columns, "good_id")
    kept = scored.where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias(good)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[good]), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints (3-word shingles, at most 2 bits): the one with the smallest id."""
    return keep_first(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has; n_chars follows the text."""
    cut = remove_repeats(docs)
    size = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cut.withColumns(size).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies are rows that repeat."""
    times, turn = collision_free(docs.columns, "mix_times", "mix_turn")
    counted = mix_sources(docs).withColumn(times, F.col("copies")).select(*docs.columns, times)
    return counted.where(F.col(times) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of every row of the mix."""
    return encode_pieces(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mix", mix), ("piece_ids", piece_ids)]

#: Boosted tables, fingerprints and piece scores have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder that the next one reads."""
    work, docs = Scratch(spark, "corpus"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.write(docs, name)
    return docs
