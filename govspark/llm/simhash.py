"""SimHash near-duplicates: pigeonhole blocks find close pairs, Hamming distance verifies them.

A fingerprint of 64 bits is cut into four blocks. Two fingerprints that differ in at most two bits agree in two blocks
at least, so each fingerprint is filed under its six pairs of blocks (32 bits and the pair's number). Within a file:

* up to ``JOIN_LIMIT`` fingerprints are joined with each other and verified;
* larger files are not: there every member is also filed under its 33 variants within one changed bit of the other two
  blocks. Two members within two bits share a variant, and all members of a variant are within two bits of each other,
  so a link from each to the least of them loses no connection and makes no pairs. These links are verified as well.

Copies count once: all work is on distinct fingerprints. Components come from alternating large-star and small-star
steps, whose number grows with the logarithm of the longest chain; every step is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, collision_free, table
from govspark.llm.registry import query

WIDTH, SEED, MAX_BITS = 3, 42, 2
JOIN_LIMIT = 64


def fingerprint(text: str, width: int = WIDTH) -> int:
    """Majority of the bits of the hashes of all shingles, as a signed 64-bit number; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and the six ASCII spaces
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), SEED) for s in shingles], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _text_mark(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark (a hash of the text) and fingerprint (long) of every whole text; a null text is an empty one."""

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [fingerprint(t or "", width) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["mark"], pa.array(values, pa.int64())], ["doc_id", "mark", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", _text_mark(F.col("text")).alias("mark"))
    return rows.mapInArrow(measure, "doc_id long, mark long, fingerprint long")


def _masked(value: Column, blocks: tuple[int, ...]) -> Column:
    mask = sum(0xFFFF << (16 * b) for b in blocks)
    return value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def close_links(distinct: DataFrame, work: Scratch) -> DataFrame:
    """Rows (a, b), a < b: enough verified links between the distinct values of ``fp`` to connect all within MAX_BITS."""
    pairs = list(combinations(range(4), 2))
    filed = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), _masked(F.col("fp"), p).alias("key")) for i, p in enumerate(pairs)])).alias("f")
    ).select("fp", "f.pair", "f.key")
    sizes = filed.groupBy("pair", "key").agg(F.count("*").alias("members")).where("members > 1")
    files = work.write(filed.join(sizes, ["pair", "key"]), "files")
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))

    small = files.where(F.col("members") <= JOIN_LIMIT)
    left, right = small.select("pair", "key", F.col("fp").alias("a")), small.select("pair", "key", F.col("fp").alias("b"))
    joined = left.join(right, ["pair", "key"]).where((F.col("a") < F.col("b")) & (bits <= MAX_BITS)).select("a", "b")

    # The other two blocks of each pair, unchanged or with one bit changed.
    changes = F.array(
        *[F.array(F.lit(0).cast("long"), *[F.lit(_signed(16 * b + i)) for b in range(4) if b not in p for i in range(16)]) for p in pairs]
    )
    large = files.where(F.col("members") > JOIN_LIMIT)
    variants = large.select("pair", "fp", F.explode(F.element_at(changes, F.col("pair") + 1)).alias("change"))
    variants = variants.select("pair", "fp", F.col("fp").bitwiseXOR(F.col("change")).alias("variant"))
    hubs = variants.groupBy("pair", "variant").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    starred = variants.join(hubs, ["pair", "variant"]).select("a", F.col("fp").alias("b"))
    starred = starred.where((F.col("a") < F.col("b")) & (bits <= MAX_BITS))
    return work.write(joined.unionByName(starred).distinct(), "links")


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """node, root for every node of ``links`` (a, b): the root is the least node of its component."""
    # Both stars only ever lower edges, so a whole pass that changes none has met stars around their least nodes. That
    # small-star alone changes nothing is not enough: 0-3, 0-15, 3-63 passes it as it is.
    sign = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    edges, step, before = links, 0, sign(links)
    while True:
        # Large star: neighbours above a node go to the least of the node and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        large = work.write(large, f"large{step}")
        # Small star: a node and its neighbours below it go to the least of them.
        low = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        small = small.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()
        small = work.write(small, f"small{step}")
        after = sign(small)
        if step:
            work.drop(f"small{step - 1}")
        work.drop(f"large{step}")
        done = after == before
        edges, step, before = small, step + 1, after
        if done:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, mark, fingerprint (long), component_id for every row of ``docs`` (doc_id, text; other columns are left alone).

    Equal fingerprints are linked; texts without words have fingerprint 0 and are linked like any other. Null ids take
    part; a component whose ids are all null has a null component_id. Repeated rows stay. An empty table gives no rows.
    """
    work = Scratch(docs.sparkSession, "simhash")
    prints = work.write(fingerprints(docs, width), "prints")
    distinct = work.write(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    links = close_links(distinct, work)
    roots = components(links, work)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = work.write(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, prints["fingerprint"] == classes["fp"]).select(*prints.columns, "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the one with the smallest id. All columns as they were.

    Rows with a null id stay only where no row of their component has one, and then all of them. Equal rows of a kept id
    stay with it; a row of the same id with another text is judged by its own component.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    keep, mark = collision_free(docs.columns, "kept_id", "kept_mark")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(keep), F.col("mark").alias(mark)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[keep]) & (_text_mark(docs["text"]) == kept[mark]), "left_semi")


@query("op9_simhash_components")
def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
