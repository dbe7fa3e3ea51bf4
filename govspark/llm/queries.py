"""Imports every module with queries, so that the registry is complete."""

from govspark.llm import additive, chat, line_labels, mixing, packing, pieces, prefix_trie, sharding, simhash, substrings, topk, urls, variants  # noqa: F401
from govspark.llm.registry import ORACLES, QUERIES  # noqa: F401


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
