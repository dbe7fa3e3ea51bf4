import random

import numpy as np
from pyspark.sql import functions as F

from govspark.operators.contracts import chunk_elements, pack_greedily, vector_blocks, vector_topk, verify_quotes
from govspark.operators.ordered import running


def greedy(sizes, limit):
    out, chunk, opened = [], 0, 0
    for size in sizes:
        if opened and opened + size > limit:
            chunk, opened = chunk + 1, 0
        opened += size
        out.append(chunk)
    return out


def test_packing_equals_a_loop(spark):
    rng = random.Random(3)
    docs = {1: [rng.randint(1, 40) for _ in range(2000)], 2: [5, 200, 1, 1, 99], 3: [7], 4: [50, 50, 50, 1]}
    rows = [(doc, pos, size) for doc, sizes in docs.items() for pos, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc bigint, pos bigint, size bigint").repartition(3)
    got = {(r.doc, r.pos): r.chunk_no for r in pack_greedily(df, ["doc"], "pos", "size", 100).collect()}
    assert got == {(doc, i): c for doc, sizes in docs.items() for i, c in enumerate(greedy(sizes, 100))}


def test_running_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.randint(0, 3), rng.choice([None, None, f"v{i}"])) for k, n in ((1, 700), (2, 3), (3, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k bigint, i bigint, x bigint, v string").repartition(4)
    out = running(df, ["k"], ["i"], {"total": F.col("x")}, {"latest": F.col("v")}, "n")
    got = {(r.k, r.i): (r.total, r.latest, r.n) for r in out.collect()}
    for key in (1, 2, 3):
        total, latest = 0, None
        for n, (k, i, x, v) in enumerate(r for r in rows if r[0] == key):
            total, latest = total + x, v or latest
            assert got[k, i] == (total, latest, n)


def test_chunks_follow_sections(spark):
    rows = [
        (1, 0, "NarrativeText", "before any title", 1), (1, 1, "Title", " Scope ", 1), (1, 2, "NarrativeText", "a b c", 1),
        (1, 3, "NarrativeText", "d e f", 2), (1, 4, "NarrativeText", "g " * 12, 2), (1, 5, "Table", "x | y", 3),
        (1, 6, "NarrativeText", "after", 3), (1, 7, "NarrativeText", "   ", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, pos bigint, kind string, text string, page int")
    got = [(r.start_pos, r.section, r.content, r.token_count, r.element_type, r.page) for r in chunk_elements(df, 8).orderBy("start_pos").collect()]
    assert got == [
        (0, "Preamble", "before any title", 3, "NarrativeText", 1),
        (2, "Scope", "a b c\n\nd e f", 6, "NarrativeText", 1),
        (4, "Scope", ("g " * 12).strip(), 12, "NarrativeText", 2),
        (5, "Scope", "x | y", 3, "Table", 3),
        (6, "Scope", "after", 1, "NarrativeText", 3),
    ]


def test_topk_does_not_depend_on_blocks(spark):
    rng = random.Random(11)
    vector = lambda: [rng.gauss(0, 1) for _ in range(8)]
    queries = spark.createDataFrame([(i, vector()) for i in range(40)], "query_id bigint, vector array<float>")
    corpus = spark.createDataFrame([(i, vector()) for i in range(200)], "corpus_id bigint, vector array<float>")
    rows = lambda n: sorted((r.query_id, r.rank, r.corpus_id) for r in vector_topk(queries, corpus, 4, 0.1, block_rows=n).collect())
    assert rows(4096) == rows(16)


def test_blocks_of_far_clusters_dont_meet(spark):
    """Clusters about distinct axes: most pairs of blocks are excluded, and the answers are those of all pairs."""
    rng = random.Random(5)
    near = lambda i: [rng.gauss(0, 0.05) + (3.0 if j == i % 12 else 0.0) for j in range(12)]
    known, asked = [(i, near(i)) for i in range(600)], [(i, near(i)) for i in range(120)]
    known += [(900, [0.0] * 12), (901, known[0][1]), (902, known[0][1])]
    queries = spark.createDataFrame([*asked, (500, [0.0] * 12)], "query_id bigint, vector array<double>")
    corpus = spark.createDataFrame(known, "corpus_id bigint, vector array<double>")
    q_blocks, c_blocks, pairs, _ = vector_blocks(queries, corpus, 0.5, block_rows=16)
    assert pairs.count() < 0.5 * q_blocks.count() * c_blocks.count()
    unit = lambda rows: np.array([v for _, v in rows]) / np.maximum(np.linalg.norm([v for _, v in rows], axis=1, keepdims=True), 1e-300)
    scores = unit(asked) @ unit(known).T
    for threshold in (0.5, 0.0):
        got = {}
        for r in vector_topk(queries, corpus, 4, threshold, block_rows=16).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.score)
        for i, row in enumerate(scores):
            assert np.allclose(got[i], sorted(row[row >= threshold], reverse=True)[:4], atol=1e-9)
        assert (500 in got) == (threshold <= 0)


def test_vectors_that_are_null_or_of_another_length_take_no_part(spark):
    schema = "vector array<double>"
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, 0.0, 0.0]), (3, [1.0, None]), (4, [])], f"query_id bigint, {schema}")
    corpus = spark.createDataFrame([(10, [1.0, 0.1]), (11, None), (12, [0.0, 1.0, 0.0]), (13, [1.0, 0.0, 0.1]), (14, [])], f"corpus_id bigint, {schema}")
    assert sorted((r.query_id, r.corpus_id) for r in vector_topk(queries, corpus, 4, 0.1).collect()) == [(0, 10), (2, 13)]


def test_every_constraint_gets_a_verdict(spark):
    long_text = "the supplier shall delete all personal data " * 5
    chunks = spark.createDataFrame([(1, long_text, 35), (2, "Delete within thirty days.", 5)], "chunk_id bigint, content string, token_count int")
    rows = [(0, 1, "delete all personal data"), (1, 1, "not in this text"), (2, 2, "within thirty days"), (3, None, "within thirty days"), (4, 9, "within thirty days"), (5, 1, None)]
    got = verify_quotes(spark.createDataFrame(rows, "ord bigint, chunk_id bigint, quote string"), chunks)
    assert {r.ord: r.verified for r in got.collect()} == {0: True, 1: False, 2: True, 3: False, 4: False, 5: False}


def test_tokens_of_a_text_are_counted_once(spark, monkeypatch):
    from govspark.operators import contracts

    calls, real = [], contracts.count_tokens
    monkeypatch.setattr(contracts, "count_tokens", lambda text: calls.append(1) or real(text))
    texts = ["Title one", " a,b  c_d ", "(e)  f", "g—h.", None, "x y z"]
    kinds = ["Title", "NarrativeText", "NarrativeText", "NarrativeText", "Table", "Table"]
    rows = [(1, i, k, x, 1) for i, (k, x) in enumerate(zip(kinds, texts))]
    chunks = chunk_elements(spark.createDataFrame(rows, "doc_id bigint, pos bigint, kind string, text string, page int"), 9)
    again = chunks.select("token_count", real(F.col("content")).alias("again"), "element_type").collect()
    assert len(again) == 4 and all(r.token_count == r.again for r in again) and len(calls) == 1
