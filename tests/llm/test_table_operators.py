import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from govspark.llm import chat, mixing, sharding, topk, urls

NAMES = ["documents", "embeddings", "pages", "labels", "conversations"]


def _oracle(sf_dir, name):
    con = duckdb.connect()
    for t in NAMES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cursor = con.execute(__spark_entry__.oracle_sql()[name])
    return [c[0] for c in cursor.description], cursor.fetchall()


def _same(frame, sf_dir, name):
    columns, want = _oracle(sf_dir, name)
    assert sorted(frame.columns) == sorted(columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_queries_equal_their_sql(spark, sf_dir, name):
    _same(__spark_entry__.queries()[name](spark, sf_dir), sf_dir, name)


# --- chat ----------------------------------------------------------------------


def _conversations(spark):
    rows = [
        (1, 0, "system", None), (1, 1, "user", "hi <|im_start|>\\"), (1, 2, "assistant", "<|im_end|>\n\\<|"), (1, 3, "user", ""),
        (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (2, None, "user", "first"), (3, 0, "ro\nle", "x"), (None, 0, None, "y"),
        (None, 1, "assistant", "é𝄞"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 1, "assistant", "\n" * 3 + "long " * 50_000),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS example", "1 AS loss_start")


def test_chat_edges(spark, tables):
    sf = tables(conversations=_conversations(spark))
    _same(__spark_entry__.queries()["op10_chat_examples"](spark, sf), sf, "op10_chat_examples")
    assert chat.format_examples(_conversations(spark).where("false")).collect() == []


def test_each_reply_has_its_context(spark):
    rows = chat.format_examples(_conversations(spark)).where("conv_id = 2").orderBy("example").collect()
    assert [r["loss_chars"] for r in rows] == [0, 3]
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[1]["text"][rows[1]["loss_start"] :].startswith("tie<|im_end|>")


# --- URLs ----------------------------------------------------------------------


def test_url_edges(spark, tables):
    rows = [
        (0, None), (1, ""), (2, "no scheme"), (3, "http://A.Example.ORG/es/x"), (4, "http://example.org/en/12"), (5, "http://xexample.org"),
        (6, "ftp://u@com/fr/?a=1#f"), (7, "http://a.com/de/#x"), (8, "http://b.net/p/?utm_a=1&k=v#t"), (9, "https://www.b.net/p.html?k=v"),
        (10, "http://b.net/p?k=v"), (10, "http://b.net/p?k=v"), (None, "http://b.net/q://z"), (11, "http:///x"), (12, "http://c.net/" + "y" * 100_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS block", "'x' AS listed", "'x' AS w0", "'x' AS canonical_url")
    labels = spark.createDataFrame([(9, 0, 0), (11, 0, 0), (0, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    sf = tables(pages=pages, labels=labels)
    _same(__spark_entry__.queries()["op8_url_filter"](spark, sf), sf, "op8_url_filter")
    listed = spark.createDataFrame([("https://b.net/p/?k=v",), (None,), ("nothing",)], "url string")
    got = urls.filter_urls(pages, "url", listed, urls.RULES)
    assert got.count() == len(rows) and {r["page_id"] for r in got.where("verdict = 'block' AND rule IS NULL").collect()} == {8, 9, 10}
    none = urls.filter_urls(pages, "url", listed.where("false"), [])
    assert {r["verdict"] for r in none.collect()} == {"allow"}
    assert urls.filter_urls(pages.where("false"), "url", listed, urls.RULES).collect() == []


def test_filter_passes_all_that_is_listed(spark, monkeypatch):
    """A filter too small for its list passes much; the join still gives exact answers."""
    monkeypatch.setattr(urls, "MAX_BLOCKS", 2)
    pages = spark.range(500).selectExpr("id AS page_id", "concat('http://h.net/', id) AS url")
    got = urls.flag_listed(pages, "url", pages.where("page_id % 3 = 0").select("url"))
    assert all(r["listed"] == (r["page_id"] % 3 == 0) for r in got.collect())


# --- mixing --------------------------------------------------------------------


def test_mix_edges(edge_docs):
    rows = mixing.mix_sources(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix_sources(edge_docs.where("false")).collect() == []
    again = mixing.mix_sources(edge_docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["taken"])
    assert [key(r) for r in sorted(rows, key=key)] == [key(r) for r in sorted(again, key=key)]


def test_mix_meets_its_targets(spark, sf_dir):
    rows = mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2
    assert np.isclose(sum({r["source"]: r["target"] for r in rows}.values()), 1.5 * sum(r["size"] for r in rows))


def test_mix_cuts_through_identical_rows(spark):
    """A hundred equal rows of ten words without an id, beside others: only as many come in as the target needs."""
    rows = [(None, "w " * 10, None)] * 100 + [(i, "x " * 10, "a") for i in range(30)] + [(7, "y " * 10, "b")] * 40 + [(8, "z z", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS p", "2 AS whole", "3 AS open", "4 AS mix_last", "5 AS n_taken", "6 AS `last`")
    for parts in (1, 6):
        got = mixing.mix_sources(docs.repartition(parts))
        assert set(got.columns) == {*docs.columns, "size", "source_size", "target", "copies", "taken"}
        got = got.collect()
        assert len(got) == len(rows)
        for source in (None, "a", "b"):
            own = [r for r in got if r["source"] == source]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5


# --- shards --------------------------------------------------------------------


def test_shards_cut_through_equal_rows(spark):
    """Half of the rows are one document, and some have no id: shards still differ by a row at most, and slots have no gap."""
    rows = [(5, "x" * 19, "en", 19)] * 4000 + [(i if i % 3 else None, f"{i:04d}" * 5, "de", 20) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").selectExpr("*", "1 AS node", "2 AS drawn", "3 AS dim")
    got = sharding.kd_shards(docs, ("lang", "n_chars"), shards=8).collect()
    bytes_, slots = {}, {}
    for r in got:
        bytes_[r["shard"]] = bytes_.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and max(bytes_.values()) - min(bytes_.values()) <= 2 * 21 and len(bytes_) == 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _plain_shards(rows, shards):
    """The k-d split of (coordinates, size) rows: bytes of each leaf, cut after the row nearest to the wanted bytes."""
    if shards == 1:
        return [sum(size for _, size in rows)]
    dims = range(len(rows[0][0]))
    spread = [max(r[0][d] for r in rows) - min(r[0][d] for r in rows) for d in dims]
    widest = max(dims, key=lambda d: (spread[d], -d))
    order = sorted(rows, key=lambda r: r[0][widest])
    want, upto, best = sum(r[1] for r in rows) * (shards // 2) / shards, 0, None
    for i, (_, size) in enumerate(order):
        upto += size
        if best is None or abs(upto - want) < best[0]:
            best = (abs(upto - want), i + 1)
    return _plain_shards(order[: best[1]], shards // 2) + _plain_shards(order[best[1] :], shards - shards // 2)


def test_shards_are_those_of_a_plain_split(spark):
    """Coordinates without ties, so that the tree is fixed: every leaf has the bytes of the brute-force split."""
    rng = np.random.default_rng(8)
    chars = rng.permutation(np.unique((2 ** rng.uniform(1, 14, 400)).astype(int)))
    other = rng.permutation(len(chars)) * 37 + 1
    rows = [(i, "y" * int(rng.integers(0, 90)), int(a), int(b)) for i, (a, b) in enumerate(zip(chars, other, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, age long")
    got = {}
    for r in sharding.kd_shards(docs, ("n_chars", "age"), shards=6).collect():
        got[r["shard"]] = got.get(r["shard"], 0) + r["size"]

    def scaled(values):
        logs = np.log2(np.array(values, float) + 1)
        return np.floor((logs - logs.min()) / (logs.max() - logs.min()) * 65535)

    plain = [((x, y), len(r[1]) + 1) for r, x, y in zip(rows, scaled(chars), scaled(other), strict=True)]
    assert [got[s] for s in range(6)] == _plain_shards(plain, 6)


def test_shards_are_even_and_slots_have_no_gaps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = __spark_entry__.queries()["op6_kd_shards"](spark, sf_dir).collect()
    assert len(rows) == docs.count()
    largest = max(r["size"] for r in rows)
    sizes = {s: sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)}
    mean = sum(sizes.values()) / 8
    assert all(abs(v - mean) <= 2 * largest for v in sizes.values())
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_shard_edges(spark, edge_docs):
    got = sharding.kd_shards(edge_docs, ("lang", "n_chars", "source"), shards=3).collect()
    assert len(got) == edge_docs.count() and {r["shard"] for r in got} <= {0, 1, 2}
    copies = spark.range(4000).selectExpr("id AS doc_id", "'same text' AS text", "'en' AS lang", "9L AS n_chars")
    sizes = [r["count"] for r in sharding.kd_shards(copies, ("lang", "n_chars"), shards=8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2
    assert sharding.kd_shards(edge_docs.where("false"), ("lang",), shards=8).collect() == []
    assert {r["shard"] for r in sharding.kd_shards(copies, ("lang",), target_bytes=10_001).collect()} == {0, 1, 2, 3}


# --- top-k ---------------------------------------------------------------------


def test_topk_edges(spark, tables):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 900)]  # one very common vector
    rows += [(1000, None), (1050, [None] + [0.1] * 7), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, [0.1] * 8), (1200, [1.0, 2.0]), (1201, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS dim", "2 AS block", "3 AS score")
    sf = tables(embeddings=frame)
    _same(__spark_entry__.queries()["op1_cover_tree_topk"](spark, sf), sf, "op1_cover_tree_topk")
    assert topk.top_k(frame.where("false"), "vec_id >= 0").collect() == []


def test_trees_cover_their_points_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 50
    x = np.concatenate([c + rng.normal(size=(80, 6)) for c in centres])
    tree = topk.CoverTree(np.arange(len(x)), x)
    assert sorted(tree.ids.tolist()) == list(range(len(x)))
    for i in range(len(tree.lo)):
        inside = tree.points[tree.lo[i] : tree.hi[i]]
        assert np.sqrt(((inside - tree.centre[i]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
    q = topk.CoverTree(np.arange(10_000, 10_040), x[::24])
    best = topk.Best(len(q.ids), 5, -np.inf)
    topk.search(q, tree, best)
    want = np.sort(q.points @ x.T, 1)[:, ::-1][:, :5]
    assert np.allclose(want, [[-s for s, _ in row] for row in best.rows])


def test_empty_vectors_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(60)] + [(100, []), (61, None), (62, []), (63, [None, 1.0]), (64, [float("nan"), 1.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 50} and {r["vec_id"] for r in found} <= set(range(60)) and len(found) == 10
