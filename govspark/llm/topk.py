"""Exact top-k by inner product: dual cover trees over query blocks and data blocks.

Rows go to the cell of their nearest pivot (pivots: a bounded sample), large cells to blocks of about ``BLOCK`` rows, and
each block becomes a cover tree, once. A query block meets a data block only if the best inner product that their
centres and covering radii allow,

    <cq, cd> + rq |cd| + rd |cq| + rq rd,

reaches the worst kth score that the block's queries have after a first search in the most promising data block. Inside
a pair of blocks the same bound prunes pairs of nodes. What is left costs one product of matrices per pair of nodes.
Scores are integers and compared as such; ties go to the smaller id.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, renewed, table
from govspark.llm.registry import query

#: Pivots are at most so many rows, taken by the hash of their id; they decide speed, never results.
PIVOTS = 256
BLOCK, QUERY_BLOCK, BLOCKS_AT_ONCE = 4096, 1024, 16
LEAF, CHILDREN, BASE = 24, 48, 1.3
_NONE = -(1 << 63)


class CoverTree:
    """Points in tree order. Node i covers points lo[i] .. hi[i] within radius[i] of its centre; own[i] ends its single points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.lo, self.hi, self.own, self.radius, self.kids, centre = [], [], [], [], [], []
        order: list[np.ndarray] = []
        # (members, centre, parent): each node takes its single points first, its children follow.
        x = points.astype(np.float64)
        todo = [(np.arange(len(x)), 0, -1)]
        placed: list[tuple] = []
        while todo:
            members, c, parent = todo.pop()
            away = np.sqrt(((x[members] - x[c]) ** 2).sum(1))
            reach = float(away.max()) if len(away) else 0.0
            groups, single = [], members
            if len(members) > LEAF and reach > 0:
                groups, single = self._cover(x, members, away, reach / BASE)
            me = len(placed)
            placed.append((single, c, reach, parent, groups))
            todo += [(g, centre_of, me) for g, centre_of in reversed(groups)]
        children: list[list[int]] = [[] for _ in placed]
        for i, (*_, parent, _) in enumerate(placed):
            if parent >= 0:
                children[parent].append(i)
        spans: dict[int, tuple[int, int, int]] = {}
        at, stack = 0, [(0, False)] if placed else []
        while stack:
            i, done = stack.pop()
            if done:
                spans[i] = (*spans[i][:2], at)
                continue
            order.append(placed[i][0])
            spans[i] = (at, at + len(placed[i][0]), -1)
            at += len(placed[i][0])
            stack.append((i, True))
            stack += [(k, False) for k in reversed(children[i])]
        turn = np.concatenate(order) if order else np.zeros(0, int)
        self.ids, self.points = ids[turn], x[turn]
        for i, (_, c, reach, _, _) in enumerate(placed):
            self.lo.append(spans[i][0])
            self.own.append(spans[i][1])
            self.hi.append(spans[i][2])
            self.radius.append(reach)
            self.kids.append(children[i])
            centre.append(x[c])
        self.centre = np.array(centre).reshape(len(placed), -1)
        self.length = np.sqrt((self.centre**2).sum(1))
        self.radius = np.array(self.radius)

    @staticmethod
    def _cover(x: np.ndarray, members: np.ndarray, away: np.ndarray, within: float) -> tuple[list, np.ndarray]:
        """Centres more than ``within`` apart, each with the points within that of it; points of small groups stay single."""
        best, owner = np.full(len(members), np.inf), np.full(len(members), -1)
        centres, far = [], int(away.argmin())
        for k in range(CHILDREN):
            d = np.sqrt(((x[members] - x[members[far]]) ** 2).sum(1))
            nearer = d < best
            best[nearer], owner[nearer] = d[nearer], k
            centres.append(members[far])
            far = int(best.argmax())
            if best[far] <= within:
                break
        owner[best > within] = -1
        groups, single = [], [members[owner == -1]]
        for k, c in enumerate(centres):
            group = members[owner == k]
            if LEAF < len(group) < len(members):
                groups.append((group, c))
            else:
                single.append(group)
        return groups, np.concatenate(single)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int, floor: float):
        self.k, self.rows = k, [[] for _ in range(queries)]
        self.worst = np.full(queries, floor)

    def offer(self, lo: int, scores: np.ndarray, ids: np.ndarray) -> None:
        for r, c in self._hits(lo, scores):
            row = [(-s, i) for s, i in zip(scores[r, c].tolist(), ids[c].tolist(), strict=True)]
            kept = sorted(self.rows[lo + r] + row)[: self.k]
            self.rows[lo + r] = kept
            if len(kept) == self.k:
                self.worst[lo + r] = max(self.worst[lo + r], -kept[-1][0])

    def _hits(self, lo: int, scores: np.ndarray):
        for r in range(len(scores)):
            row = scores[r]
            c = np.nonzero(row >= max(self.worst[lo + r], -np.inf))[0]
            c = c[row[c] > -np.inf]
            if len(c) > 8 * self.k:  # no more than the ties at the kth place are needed
                kth = np.partition(row[c], len(c) - self.k)[len(c) - self.k]
                c = c[row[c] >= kth]
            if len(c):
                yield r, c


def search(q: CoverTree, d: CoverTree, best: Best) -> None:
    """Improve ``best`` for the queries of ``q`` by the points of ``d``, leaving out a query's own id."""
    if not len(q.ids) or not len(d.ids):
        return

    def bounds(a: int, b: list[int]) -> np.ndarray:
        return d.centre[b] @ q.centre[a] + q.radius[a] * d.length[b] + d.radius[b] * q.length[a] + q.radius[a] * d.radius[b]

    def compare(q_lo: int, q_hi: int, d_lo: int, d_hi: int) -> None:
        for at in range(q_lo, q_hi, 256):
            to = min(at + 256, q_hi)
            scores = q.points[at:to] @ d.points[d_lo:d_hi].T
            scores[q.ids[at:to, None] == d.ids[None, d_lo:d_hi]] = -np.inf
            best.offer(at, scores, d.ids[d_lo:d_hi])

    todo = [(float(bounds(0, [0])[0]), 0, 0)]
    while todo:
        bound, a, b = todo.pop()
        worst = best.worst[q.lo[a] : q.hi[a]].min()
        if bound + 0.5 + 1e-9 * abs(bound) < worst:
            continue
        if q.kids[a] and (q.radius[a] >= d.radius[b] or not d.kids[b]):
            compare(q.lo[a], q.own[a], d.lo[b], d.hi[b])
            todo += sorted((float(bounds(k, [b])[0]), k, b) for k in q.kids[a])
        else:
            compare(q.lo[a], q.hi[a], d.lo[b], d.own[b])
            kids = d.kids[b]
            if kids:
                todo += sorted(zip(bounds(a, kids).tolist(), [a] * len(kids), kids, strict=True))


def _cells(vectors: DataFrame, pivots: dict[int, np.ndarray], limit: int) -> DataFrame:
    """vectors with block: the nearest pivot, and a number where the pivot's cell is larger than ``limit``."""

    def nearest(parts):
        for part in parts:
            cell = np.zeros(len(part), np.int64)
            for dim, rows in part.groupby("dim").indices.items():
                x = np.array(part["v"].iloc[rows].tolist(), np.float64).reshape(len(rows), dim)
                p = pivots[dim]
                cell[rows] = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
            yield part.assign(cell=cell)

    celled = vectors.mapInPandas(nearest, "vec_id long, dim int, v array<long>, cell long")
    sizes = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    return celled.join(sizes, ["dim", "cell"]).select("vec_id", "dim", "v", (F.col("cell") * (1 << 32) + part).alias("block"))


def _trees(blocks: DataFrame) -> DataFrame:
    """One row per block: dim, block, centre, radius, tree."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        dim = int(part["dim"].iloc[0])
        part = part.sort_values("vec_id")
        tree = CoverTree(part["vec_id"].to_numpy(), np.array(part["v"].tolist(), np.float64).reshape(len(part), dim))
        one = {"dim": dim, "block": part["block"].iloc[0], "centre": tree.centre[0].tolist(), "radius": float(tree.radius[0]), "tree": pickle.dumps(tree)}
        return pd.DataFrame([one])

    return blocks.groupBy("dim", "block").applyInPandas(build, "dim int, block long, centre array<double>, radius double, tree binary")


def usable(embeddings: DataFrame, scale: float) -> DataFrame:
    """vec_id, dim, v (components as whole numbers) of the rows that take part, one for each id."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & (F.size(x) > 0) & fine).select("vec_id", whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v")


def top_k(embeddings: DataFrame, queries, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of every query row with all other rows.

    ``embeddings`` has vec_id and embedding, ``queries`` is a condition on vec_id. Rows without an id or a vector, with an empty vector, or with a null or
    non-finite component take no part. Rows that share an id count as one, with the least of their vectors. Vectors of
    different lengths are never compared. Scores are exact while they stay below 2^53. No queries or no rows: no result.
    """
    spark, work = embeddings.sparkSession, Scratch(embeddings.sparkSession, "topk")
    vectors = work.write(usable(embeddings, scale), "vectors")
    sample = vectors.withColumn("turn", F.row_number().over(W.partitionBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy(F.xxhash64("vec_id", F.lit(1)))))
    counts = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # one row per vector length
    pivots: dict[int, list] = {d: [] for d in counts}
    for r in sample.where(F.col("turn") <= PIVOTS // 64).select("dim", "v").orderBy("dim", "v").collect():
        pivots[r["dim"]].append(r["v"])
    few = lambda d, share, size: np.array(pivots[d][: max(1, min(PIVOTS, math.ceil(counts[d] * share / size)))], np.float64).reshape(-1, d)
    data = work.write(_trees(_cells(vectors, {d: few(d, 1, BLOCK) for d in counts}, BLOCK)), "data")
    asked = _trees(_cells(vectors.where(queries), {d: few(d, 0.02, QUERY_BLOCK) for d in counts}, QUERY_BLOCK))
    asked = work.write(asked.withColumnsRenamed({"block": "q_block", "centre": "q_centre", "radius": "q_radius", "tree": "q_tree"}), "queries")

    # Block summaries only: which data blocks can hold a neighbour for which query block.
    dot = F.aggregate(F.zip_with("centre", "q_centre", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, p: s + p * p))
    met = data.drop("tree").join(asked.drop("q_tree"), "dim").withColumn("dot", dot)
    bound = F.col("dot") + F.col("q_radius") * length("centre") + F.col("radius") * length("q_centre") + F.col("q_radius") * F.col("radius")
    met = work.write(met.select("dim", "block", "q_block", "dot", bound.alias("bound")), "met")
    first = met.groupBy("dim", "q_block").agg(F.max(F.struct("dot", "block"))["block"].alias("block"))
    found = work.write(_searched(first.withColumn("worst", F.lit(None).cast("double")), data, asked, k), "first")
    worst = found.groupBy("dim", "q_block").agg(F.min("worst").alias("worst"))
    rest = met.join(first, ["dim", "q_block", "block"], "left_anti").join(worst, ["dim", "q_block"], "left")
    rest = rest.where(F.col("worst").isNull() | (F.col("bound") + 0.5 + F.abs("bound") * 1e-9 >= F.col("worst"))).select("dim", "q_block", "block", "worst")
    both = found.unionByName(work.write(_searched(rest, data, asked, k), "rest"))
    rows = both.where("vec_id IS NOT NULL")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(pairs: DataFrame, data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of every query within the data blocks of its pairs, BLOCKS_AT_ONCE or so of them in a task.

    ``worst`` of a query block is the worst kth score of its queries, null while one of them has fewer than k.
    """
    strips = pairs.groupBy("dim", "q_block").agg(F.ceil(F.count("*") / BLOCKS_AT_ONCE).cast("int").alias("strips"))
    pairs = pairs.join(strips, ["dim", "q_block"]).withColumn("strip", F.pmod(F.xxhash64("block"), F.col("strips")).cast("int"))
    right = pairs.select("dim", "q_block", "block", "strip", "worst").join(data, ["dim", "block"])
    left = asked.join(pairs.select("dim", "q_block", "strip").distinct(), ["dim", "q_block"])

    def run(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        columns = ["dim", "q_block", "worst", "query_id", "vec_id", "score"]
        if q.empty or d.empty:
            return pd.DataFrame(columns=columns)
        tree, floor = pickle.loads(q["q_tree"].iloc[0]), d["worst"].min()
        best = Best(len(tree.ids), k, -np.inf if pd.isna(floor) else float(floor))
        for raw in d["tree"]:
            search(tree, pickle.loads(raw), best)
        full = all(len(r) == k for r in best.rows)
        worst = float(best.worst.min()) if full else None
        rows = [(q["dim"].iloc[0], q["q_block"].iloc[0], worst, int(i), v, int(-s)) for i, row in zip(tree.ids, best.rows, strict=True) for s, v in row]
        return pd.DataFrame(rows or [(q["dim"].iloc[0], q["q_block"].iloc[0], worst, None, None, None)], columns=columns).astype({"worst": "float64", "query_id": "Int64", "vec_id": "Int64", "score": "Int64"})

    keys = ["dim", "q_block", "strip"]
    return renewed(left).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "dim int, q_block long, worst double, query_id long, vec_id long, score long")


_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_cover_tree_topk", _SQL)
def op1_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
