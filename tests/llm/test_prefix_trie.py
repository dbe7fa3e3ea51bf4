import hashlib
import random
import zlib
from collections import defaultdict

from govspark.llm.common import Scratch
from govspark.llm.prefix_trie import order_turns, prefix_trie, rebuilt, walk

TURNS = "conv_id long, turn long, role string, text string, pos string, path string"


def _brute(conversations):
    """Rows of the trie of {id: [(role, text), ...]}."""
    members = defaultdict(list)
    for i, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(i)
    rows = []
    for path, ids in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(str(i) for i in ids if len(conversations[i]) == len(path))
        parent = members[path[:-1]][0] if path else None
        rows.append((ids[0], len(path), parent, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def _ordered(rows):
    out = defaultdict(list)
    for i, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if i is not None:
            out[i].append((role or "", text or ""))
    return out


def _rebuilt(conversations):
    out = {}
    for i, turns in conversations.items():
        h = zlib.crc32(str(i).encode()) % 9
        out[i] = conversations.get(i - i % 5, [])[:h] + turns[h:]
    return out


def _sorted(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


def _random(seed, size):
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        for turn in range(rng.choice([1, 2, 3, 8, 12])):
            text = rng.choice(["", None, "ja", "né", "long " * 50])
            rows.append((i, rng.choice([turn, turn, None]), rng.choice(["user", "user", "assistant", None]), text))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def test_trie_of_edge_conversations(spark):
    rows = _random(1, 60)
    rows += [(70, 1, "user", "same")] * 3 + [(None, 0, "user", "lost"), (71, None, None, None)]
    rows += [(100 + k, t, "user", f"copy {t}") for k in range(40) for t in range(3)]
    rows += [(200, t, "user", f"turn {t}") for t in range(90)] + [(201, t, "user", f"turn {t}") for t in range(89)]
    ordered = order_turns(_frame(spark, rows))
    plain = _ordered(rows)
    whole = ordered.select("conv_id").distinct().selectExpr("conv_id", "conv_id AS family")
    assert _sorted(prefix_trie(whole, ordered, shard_conversations=7)) == _brute(plain)


def test_rebuilt_conversations(spark):
    rows = _random(2, 47) + [(1001, 0, "user", "no first one"), (1003, 0, "user", "x"), (1004, 3, "user", "y")]
    conversations, turns = rebuilt(order_turns(_frame(spark, rows)), Scratch(spark, "test"))
    want = _rebuilt(_ordered(rows))
    assert any(not t for t in want.values())
    assert _sorted(prefix_trie(conversations, turns)) == _brute(want)


def test_empty_tables(spark):
    empty = order_turns(_frame(spark, []))
    assert prefix_trie(*rebuilt(empty, Scratch(spark, "test"))).collect() == []
    lone = spark.createDataFrame([(5, 5), (9, 5)], "conv_id long, family long")
    assert [tuple(r) for r in prefix_trie(lone, empty).collect()] == [(5, 0, None, 2, 0, 1, 0, hashlib.sha256(b"5,9").hexdigest())]


def test_nodes_of_a_shard_come_parents_first():
    rows = list(walk([3, 5, 9], [[b"a", b"b"], [b"a"], []], [[1, 2], [1], []]))
    assert [(r[0], r[1], r[3], r[4], r[5], r[7], r[8]) for r in rows] == [
        (0, -1, 0, 3, 3, True, [9]), (1, 0, 1, 2, 3, True, [5]), (2, 1, 2, 1, 3, False, [3]),
    ]
