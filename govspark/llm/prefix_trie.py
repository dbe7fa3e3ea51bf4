"""Conversation prefix trie by vertical bitmaps.

Conversations are dealt to shards of about ``SHARD_CONVERSATIONS``. A shard indexes each (position, turn) with the bitset of
its conversations that have that turn there. Depth first, a node's bitset without those that end there is taken apart: the
turn of its first conversation names a posting, and the intersection with that posting is a child. Bit counts are the
members, lowest bits the smallest ids, and the bits that end give the list of ends.

A node of the whole trie is the sum of the nodes with one path in all shards, found by a 128-bit digest of the path, so
a prefix that very many conversations share is one row per shard before anything is shuffled. Sums over subtrees count each
node in one shard only, the one that holds its smallest member; each shard adds up its own tree and the sums of the shards
are added. No step goes level by level, and no group holds more than a shard.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, crc32_sql, table
from govspark.llm.registry import query

SHARD_CONVERSATIONS = 2048
ROOT = bytes(16)

#: The rebuilt conversations of the registered query: families of FAMILY ids share up to PREFIXES - 1 turns of the first.
FAMILY, PREFIXES = 5, 9


def order_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (int, from 0), turn_key, size: turns by turn, role, text, nulls first; equal rows stay.

    Null roles and texts are empty, rows without conv_id take no part. ``turn_key`` is a 128-bit digest of role and text,
    ``size`` the UTF-8 bytes of the text. Texts go no further than this step.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("pos"),
        F.unhex(F.md5(named.cast("binary"))).alias("turn_key"),
        F.octet_length("text").cast("long").alias("size"),
    )


def _groups(data: pa.Table) -> tuple[list, list, list]:
    """Ids in order, and each one's turn keys and sizes by position."""
    ids, keys, sizes = [], [], []
    columns = [data[c].to_pylist() for c in ("conv_id", "pos", "turn_key", "size")]
    for i, _, key, size in sorted(zip(*columns, strict=True), key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        if not ids or ids[-1] != i:
            ids.append(i)
            keys.append([])
            sizes.append([])
        if key is not None:
            keys[-1].append(key)
            sizes[-1].append(size)
    return ids, keys, sizes


def walk(ids: list, keys: list[list], sizes: list[list]) -> Iterator[tuple]:
    """node, parent, path, depth, n_convs, least id, bytes of the last turn, has children, ids that end, for one shard.

    Parents come before children; ``ids`` are ascending, so a lower bit is a smaller id.
    """
    postings: dict = defaultdict(int)
    ends: dict = defaultdict(int)
    for i, turns in enumerate(keys):
        ends[len(turns)] |= 1 << i
        for pos, key in enumerate(turns):
            postings[pos, key] |= 1 << i
    stack, number = [((1 << len(ids)) - 1, -1, ROOT, 0, 0)], 0
    while stack:
        members, parent, path, depth, size = stack.pop()
        ending = members & ends[depth] if depth in ends else 0
        rest = members ^ ending
        least = (members & -members).bit_length() - 1
        yield number, parent, path, depth, members.bit_count(), ids[least], size, bool(rest), [ids[i] for i in _bits(ending)]
        while rest:
            first = (rest & -rest).bit_length() - 1
            key = keys[first][depth]
            child = rest & postings[depth, key]
            rest ^= child
            stack.append((child, number, hashlib.blake2b(path + key, digest_size=16).digest(), depth + 1, sizes[first][depth]))
        number += 1


def _bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


_NODES = "shard long, node int, parent int, path binary, depth int, n long, least long, size long, inner boolean, ends array<long>"
_NODE_TYPES = pa.schema([
    ("shard", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("path", pa.binary()), ("depth", pa.int32()), ("n", pa.int64()),
    ("least", pa.int64()), ("size", pa.int64()), ("inner", pa.bool_()), ("ends", pa.list_(pa.int64())),
])


def _shard_nodes(data: pa.Table) -> pa.Table:
    shard = data["shard"][0].as_py()
    columns = list(zip(*walk(*_groups(data)), strict=True))
    arrays = [pa.array([shard] * len(columns[0]), pa.int64())]
    arrays += [pa.array(c, t) for c, t in zip(columns, _NODE_TYPES.types[1:], strict=True)]
    return pa.Table.from_arrays(arrays, schema=_NODE_TYPES)


_SUMS = "path binary, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def _shard_sums(data: pa.Table) -> pa.Table:
    """Each node's share of its global sums: children, leaves and savings of the nodes whose smallest member is in this shard."""
    names = ("node", "parent", "path", "depth", "size", "owned", "conv_id", "n_convs", "leaf")
    rows = sorted(zip(*[data[c].to_pylist() for c in names], strict=True))
    n = len(rows)
    children, leaves, saved, above = [0] * n, [0] * n, [0] * n, [None] * n
    for node, parent, _, _, size, owned, _, convs, leaf in reversed(rows):
        if owned:
            leaves[node] += leaf
            saved[node] += (convs - 1) * size
        if parent >= 0:
            children[parent] += owned
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
            above[node] = rows[parent][6]
    columns = [
        pa.array([r[2] for r in rows], pa.binary()), pa.array([r[6] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32()),
        *[pa.array(c, pa.int64()) for c in (above, [r[7] for r in rows], children, leaves, saved)],
    ]
    return pa.Table.from_arrays(columns, names=["path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"])


def _hash_ends(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by path and id; a list of any length passes through one digest and is never held."""
    path, digest, out = None, None, []
    for part in parts:
        for key, i in zip(part["path"].to_pylist(), part["end"].to_pylist(), strict=True):
            if key == path:
                digest.update(b",%d" % i)
            else:
                if path is not None:
                    out.append((path, digest.hexdigest()))
                path, digest = key, hashlib.sha256(b"%d" % i)
        if len(out) > 10_000:
            yield _hashed(out)
            out = []
    if path is not None:
        out.append((path, digest.hexdigest()))
    yield _hashed(out)


def _hashed(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["path", "ends_sha256"])


def prefix_trie(conversations: DataFrame, turns: DataFrame, shard_conversations: int = SHARD_CONVERSATIONS) -> DataFrame:
    """One row per node of the trie of all conversations' prefixes.

    ``conversations`` has one row per conversation: conv_id, and family, by which conversations that are likely to share turns
    come to one shard. ``turns`` has conv_id, pos (gapless from 0), turn_key and size of their turns. A conversation
    without turns belongs to the root. Returned: conv_id (smallest member), depth, parent_conv_id (the parent's
    conv_id, null for the root), n_convs, n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, a
    node's n_convs - 1 times its size) and ends_sha256 (of the ids that end at the node, ascending, comma-joined). Without
    conversations there is no node. The turns of one conversation are handled by one task, as digests of 16 bytes.
    """
    work = Scratch(conversations.sparkSession, "prefix-trie")
    conversations = work.write(conversations.select("conv_id", "family"), "conversations")
    shards = -(-conversations.count() // shard_conversations) or 1
    shard = F.pmod(F.xxhash64("family"), F.lit(shards)).alias("shard")
    none = (F.lit(None).cast("int").alias("pos"), F.lit(None).cast("binary").alias("turn_key"), F.lit(None).cast("long").alias("size"))
    placed = turns.join(conversations, "conv_id").select(shard, "conv_id", "pos", "turn_key", "size")
    placed = placed.unionByName(conversations.select(shard, "conv_id", *none))
    nodes = work.write(placed.groupBy("shard").applyInArrow(_shard_nodes, _NODES), "nodes")

    whole = nodes.groupBy("path").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("inner").alias("has_children"))
    shares = nodes.drop("ends").join(whole, "path").select(
        "shard", "node", "parent", "path", "depth", "size", (F.col("least") == F.col("conv_id")).alias("owned"), "conv_id", "n_convs",
        (~F.col("has_children")).alias("leaf"),
    )
    sums = shares.groupBy("shard").applyInArrow(_shard_sums, _SUMS)
    merged = sums.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").cast("long").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"),
        F.min("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = nodes.where(F.size("ends") > 0).select("path", F.explode("ends").alias("end"))
    hashed = ends.repartition("path").sortWithinPartitions("path", "end").mapInArrow(_hash_ends, "path binary, ends_sha256 string")
    empty = F.lit(hashlib.sha256().hexdigest())
    return merged.join(hashed, "path", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def rebuilt(ordered: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, family) and their turns, each with the first turns of its family's first conversation.

    Conversation c takes the first h turns of conversation c - c % FAMILY, with h = crc32 of its decimal id, modulo
    PREFIXES, or all if there are fewer; its own turns from its h-th on follow.
    """
    ordered = work.write(ordered, "ordered")
    own = work.write(ordered.groupBy("conv_id").agg(F.count("*").alias("n")), "own")
    prefix = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIXES).cast("int")
    members = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), prefix.alias("h"))
    first = own.select(F.col("conv_id").alias("family"), "n")
    members = members.join(first, "family", "left").select(
        "conv_id", "family", "h", F.least("h", F.coalesce("n", F.lit(0)).cast("int")).alias("taken")
    )
    members = work.write(members, "members")
    heads = ordered.where(F.col("pos") < PREFIXES - 1).withColumnRenamed("conv_id", "family").join(members, "family").where(F.col("pos") < F.col("h"))
    tails = ordered.join(members.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h"))
    turns = heads.select("conv_id", "pos", "turn_key", "size").unionByName(
        tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "size")
    )
    return members.select("conv_id", "family"), turns


_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS family, count(*) AS n FROM t GROUP BY conv_id),
m AS (
  SELECT i.conv_id, i.family, i.crc % 9 AS h, least(i.crc % 9, coalesce(f.n, 0)) AS taken
  FROM (SELECT *, {crc32_sql("CAST(conv_id AS VARCHAR)")} AS crc FROM ids) i LEFT JOIN ids f ON f.conv_id = i.family),
r AS (
  SELECT m.conv_id, t.pos, role, text FROM t JOIN m ON t.conv_id = m.family AND t.pos < m.h
  UNION ALL SELECT m.conv_id, t.pos - m.h + m.taken, role, text FROM t JOIN m ON t.conv_id = m.conv_id AND t.pos >= m.h),
sized AS (SELECT m.conv_id, count(r.pos) AS n FROM m LEFT JOIN r ON m.conv_id = r.conv_id GROUP BY m.conv_id),
way AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, md5('') AS path, CAST(NULL AS VARCHAR) AS above, 0 AS size FROM m
  UNION ALL
  SELECT r.conv_id, way.depth + 1, md5(way.path || length(r.role) || ':' || r.role || r.text), way.path, strlen(r.text)
  FROM way JOIN r ON r.conv_id = way.conv_id AND r.pos = way.depth),
node AS (
  SELECT way.path, min(way.above) AS above, min(way.conv_id) AS conv_id, min(way.depth) AS depth, count(*) AS n_convs, min(way.size) AS size,
    sha256(coalesce(string_agg(CAST(way.conv_id AS VARCHAR), ',' ORDER BY way.conv_id) FILTER (sized.n = way.depth), '')) AS ends_sha256
  FROM way JOIN sized ON way.conv_id = sized.conv_id GROUP BY way.path),
kids AS (SELECT above AS path, count(*) AS n_children FROM node WHERE above IS NOT NULL GROUP BY above),
known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON node.path = kids.path),
-- A node lies below the nodes that its smallest member passes.
below AS (
  SELECT w.path, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.size) AS saved_tokens
  FROM known k JOIN way w ON w.conv_id = k.conv_id AND w.depth <= k.depth GROUP BY w.path)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN below b ON k.path = b.path LEFT JOIN known p ON p.path = k.above
"""


@query("op13_conversation_trie", _SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that families share prefixes."""
    work = Scratch(spark, "conversation-trie")
    return prefix_trie(*rebuilt(order_turns(table(spark, sf_dir, "conversations")), work))
