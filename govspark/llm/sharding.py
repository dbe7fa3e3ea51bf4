"""K-d tree shards: split at weighted medians along the widest metadata dimension until leaves reach the target bytes.

Only ids, sizes, checksums and coordinates move; texts are read once for their size and checksum. A cut is found by
radix descent: word sums for 65,536 buckets of a node's key (combined before the shuffle), then the same inside the
bucket that holds the median. A key is the coordinate, then the text's checksum, then a hash of the id, so equal texts
under equal metadata stay side by side. Its last part is a number drawn for each row and written with it, so that rows
equal in everything, however many, are cut like others. What rows are judged by is one row per node, which is broadcast:
there are at most as many as shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, table
from govspark.llm.registry import query

BITS, PASSES = 16, 8  # eight digits of 16 bits: 16 of the coordinate, 32 of the checksum, 48 of the id's hash, 32 drawn


def _coordinate(value: Column, numeric: bool) -> Column:
    """A number that keeps the order of the values; null is lowest."""
    if numeric:
        return F.coalesce(F.log2(F.greatest(value.cast("double"), F.lit(0.0)) + 1.0), F.lit(0.0))
    head = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(0.0))


def kd_shards(docs: DataFrame, dimensions: tuple[str, ...], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text, and the columns of ``dimensions``).

    The number of leaves is ``shards``, or all bytes divided by ``target_bytes``, rounded up. A node with n leaves is cut
    where its bytes come nearest to floor(n/2) : ceil(n/2). Size is the text's UTF-8 bytes plus 1 (null: 0 plus 1), so
    empty texts spread too. Null metadata is lowest. Repeated rows are rows like others. An empty table gives no rows.
    """
    spark, work = docs.sparkSession, Scratch(docs.sparkSession, "kd-tree")
    numeric = {c: t != "string" for c, t in docs.dtypes}
    text = F.coalesce("text", F.lit(""))
    names = [f"at{i}" for i in range(len(dimensions))]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 48) - 1)).alias("id_hash"),
        F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 32) - 1)).alias("drawn"),
        *[_coordinate(F.col(c), numeric[c]).alias(n) for c, n in zip(dimensions, names, strict=True)],
        F.lit(0).cast("long").alias("node"),
    )
    rows = work.write(rows, "rows")
    span = rows.agg(F.sum("size").alias("bytes"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    if span["bytes"] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaves = shards or max(1, math.ceil(span["bytes"] / target_bytes))
    scaled = [
        (F.lit(0) if span[f"max_{n}"] == span[f"min_{n}"] else F.floor((F.col(n) - span[f"min_{n}"]) / (span[f"max_{n}"] - span[f"min_{n}"]) * 65535)).cast("long")
        for n in names
    ]
    rows = rows.withColumns(dict(zip(names, scaled, strict=True)))
    # A node is open while it has more than one leaf: (number, first leaf, leaves). There are as many as shards at most.
    nodes, level = [(0, 0, leaves)], 0
    while any(n > 1 for _, _, n in nodes):
        cuts = _cuts([x for x in nodes if x[2] > 1], rows, names)
        rows, kept = _split(spark, rows, names, cuts), nodes
        nodes = []
        for number, first, n in kept:
            if n > 1:
                nodes += [(2 * number + 1, first, n // 2), (2 * number + 2, first + n // 2, n - n // 2)]
            else:
                nodes.append((number, first, n))
        rows, level = work.write(rows, f"level{level}"), level + 1
        if level > 1:
            work.drop(f"level{level - 2}")
    leaf = spark.createDataFrame([(number, first) for number, first, _ in nodes], "node long, shard int")
    return _numbered(rows.join(F.broadcast(leaf), "node"), work)


def _digits(names: list[str], widest: Column) -> list[Column]:
    """The key's digits, first to last, each below 65,536."""
    along = F.element_at(F.array(*names), widest + 1)
    mask = F.lit((1 << BITS) - 1)
    crc = [F.shiftright("text_crc32", s).bitwiseAND(mask) for s in (16, 0)]
    tie = [F.shiftright("id_hash", s).bitwiseAND(mask) for s in (32, 16, 0)]
    drawn = [F.shiftright("drawn", s).bitwiseAND(mask) for s in (16, 0)]
    return [along, *crc, *tie, *drawn]


def _cuts(nodes: list[tuple[int, int, int]], rows: DataFrame, names: list[str]) -> dict[int, tuple[int, list[int], bool]]:
    """For each node: its widest dimension, the digits of the key at the cut, and whether that key goes left."""
    spark = rows.sparkSession
    asked = spark.createDataFrame([(n, k // 2, k) for n, _, k in nodes], "node long, left_leaves long, leaves long")
    spread = F.array(*[F.max(n) - F.min(n) for n in names])
    found = rows.join(F.broadcast(asked), "node").groupBy("node", "left_leaves", "leaves").agg(F.sum("size").alias("bytes"), spread.alias("spread"))
    state = {}
    for r in found.collect():  # one row per open node
        widest = max(range(len(names)), key=lambda i: (r["spread"][i], -i))
        state[r["node"]] = {"dim": widest, "want": r["bytes"] * r["left_leaves"] / r["leaves"], "digits": [], "before": 0, "last": 0}
    for step in range(PASSES):
        fields = ", ".join(f"d{i} long" for i in range(step))
        at = spark.createDataFrame(
            [(n, s["dim"], float(s["want"] - s["before"]), *s["digits"]) for n, s in state.items()],
            f"node long, dim int, want double{', ' + fields if fields else ''}",
        )
        joined = rows.join(F.broadcast(at), "node")
        digits = _digits(names, F.col("dim"))
        for i in range(step):
            joined = joined.where(digits[i] == F.col(f"d{i}"))
        sums = joined.groupBy("node", "want", digits[step].alias("digit")).agg(F.sum("size").alias("bytes"))
        upto = W.partitionBy("node").orderBy("digit")
        sums = sums.withColumn("after", F.sum("bytes").over(upto))
        # The bucket across the wanted weight; the last one if rounding leaves none.
        hit = sums.groupBy("node").agg(
            F.min(F.when(F.col("after") >= F.col("want"), F.struct("digit", "bytes", "after"))).alias("hit"),
            F.max(F.struct("digit", "bytes", "after")).alias("end"),
        )
        for r in hit.collect():  # one row per open node
            h, s = r["hit"] or r["end"], state[r["node"]]
            s["digits"].append(h["digit"])
            s["before"] += h["after"] - h["bytes"]
            s["last"] = h["bytes"]
    return {n: (s["dim"], s["digits"], s["before"] + s["last"] - s["want"] <= s["want"] - s["before"]) for n, s in state.items()}


def _split(spark: SparkSession, rows: DataFrame, names: list[str], cuts: dict) -> DataFrame:
    """Rows with the number of their node on the next level."""
    at = spark.createDataFrame([(n, d, digits, left) for n, (d, digits, left) in cuts.items()], "node long, dim int, cut array<long>, cut_left boolean")
    joined = rows.join(F.broadcast(at), "node", "left")
    key = F.array(*_digits(names, F.coalesce("dim", F.lit(0))))
    left = (key < F.col("cut")) | ((key == F.col("cut")) & F.col("cut_left"))
    node = F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(left, 1).otherwise(2))
    return joined.select(*[c for c in rows.columns if c != "node"], node.cast("long").alias("node"))


def _numbered(rows: DataFrame, work: Scratch) -> DataFrame:
    """Slots from 0 without gaps: rows of a shard lie in buckets by their drawn number, which start where the ones before end."""
    bucket = F.shiftright("drawn", 20).cast("int")
    rows = rows.select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket"))
    counts = rows.groupBy("shard", "bucket").count()
    before = W.partitionBy("shard").orderBy("bucket")
    starts = counts.select("shard", "bucket", (F.sum("count").over(before) - F.col("count")).alias("start"))
    order = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("start") + F.row_number().over(order) - 1)
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot")


@query("op6_kd_shards")
def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes. The dimensions are those that copies of a text share."""
    docs = table(spark, sf_dir, "documents")
    placed = kd_shards(docs, ("lang", "n_chars"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
