import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from govspark.llm import additive, line_labels, simhash, substrings
from govspark.llm.common import Scratch
from govspark.llm.line_labels import viterbi
from govspark.llm.pieces import MODEL, Pieces, decode_pieces, encode_pieces
from llm import brute

DOCS = "doc_id long, text string"


def _key(row):
    return tuple((v is None, str(v)) for v in row)


# --- line labels ---------------------------------------------------------------


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        emit, move = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda y: sum(emit[i, k] for i, k in enumerate(y)) + sum(move[a, b] for a, b in itertools.pairwise(y))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert viterbi(emit, move).tolist() == list(best)
    assert viterbi(np.zeros((3, 2)), np.zeros((2, 2))).tolist() == [1, 1, 1]
    assert len(viterbi(np.zeros((0, 2)), np.zeros((2, 2)))) == 0


def test_base_counts_of_edge_documents(edge_docs):
    got = line_labels.judge_lines(edge_docs, *line_labels.train_field([], [])).collect()
    want = [(r["doc_id"], *brute.base(r["text"])) for r in edge_docs.collect()]
    assert sorted((tuple(r)[:6] for r in got), key=_key) == sorted(want, key=_key)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)


def test_line_labels_follow_the_marks(spark, sf_dir, run):
    rows = {r["doc_id"]: r for r in run("op2_line_labels", sf_dir)}
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    good = [rows[m["doc_id"]] for m in marks if m["quality"] == 1]
    bad = [rows[m["doc_id"]] for m in marks if m["quality"] == 0]
    assert np.mean([r["kept"] for r in good if not r["base_failed"]]) > 0.97
    assert np.mean([not r["kept"] for r in bad]) > 0.9
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert all((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.base(texts[i]) for i, r in rows.items())


# --- substrings ----------------------------------------------------------------


def _stretches(seed):
    rng = random.Random(seed)
    source = [f"v{rng.randrange(400)}" for _ in range(600)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(500)
            parts += source[a : a + rng.randrange(5, 90)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(6))]
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_equals_brute_force(spark, seed):
    rows = _stretches(seed)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    for (doc, _), (w, gone) in zip(rows, brute.removed(rows), strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[doc]["n_words"], got[doc]["n_removed"]) == (len(w), sum(gone))
        assert got[doc]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert " ".join(got[doc]["text"].split()) == kept


def test_removal_of_edge_documents(edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = substrings.remove_repeats(edge_docs)
    assert set(edge_docs.columns) <= set(got.columns)
    want = [(doc, len(w), sum(gone)) for (doc, _), (w, gone) in zip(rows, brute.removed(rows), strict=True)]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed").collect()), key=_key) == sorted(want, key=_key)


def test_removal_of_nothing(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


# --- SimHash -------------------------------------------------------------------


def test_components_of_edge_documents(edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    prints = [(doc, brute.simhash(text)) for doc, text in rows]
    least = brute.components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = [(doc, p, c) for (doc, p), c in zip(prints, least, strict=True)]
    got = [(r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(edge_docs).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    kept = simhash.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    # The one row without an id is alone in its component and stays, as the docstring of keep_first says.
    assert {r["doc_id"] for r in kept.collect()} == set(least)


def test_links_in_crowded_blocks(spark, monkeypatch):
    """Files over the limit take the way by variants, and give the same components."""
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        center = rng.getrandbits(64)
        values |= {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)} | {center}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute.components([(v, v % (1 << 64)) for v in values], lambda a, b: (a ^ b).bit_count() <= 2)
    for limit in (64, 1):
        monkeypatch.setattr(simhash, "JOIN_LIMIT", limit)
        work = Scratch(spark, "test")
        root = {r["node"]: r["root"] for r in simhash.components(simhash.close_links(distinct, work), work).collect()}
        assert [root.get(v, v) for v in values] == want


@pytest.mark.parametrize("values", [[0, 3, 15, 63], *[[7 << i for i in range(n)] for n in (4, 8, 50)]])
def test_rising_chains_are_one_component(spark, monkeypatch, values):
    """Neighbours are two bits apart, all others more."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: docs.select("doc_id", F.col("text").cast("long").alias("fingerprint")))
    docs = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], DOCS)
    assert [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [(i, 0) for i in range(len(values))]


# --- classifier ----------------------------------------------------------------


def test_scores_of_held_out_documents(spark, sf_dir, run):
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = run("op5_quality_scores", sf_dir)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) >= 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_scores_of_edge_documents(spark, edge_docs):
    labels = spark.createDataFrame([(7, 1), (10, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = additive.score_documents(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(r["score"] is not None for r in got)
    assert {r["score"] for r in additive.score_documents(edge_docs, labels.where("false")).collect()} == {0.5}
    assert additive.score_documents(edge_docs.where("false"), labels).collect() == []


def test_vectorised_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(additive.DOC_FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = additive.fit(x, y)
    assert ((m.scores(x) > 0.5) == (y == 1)).mean() > 0.9  # only the pair tables can learn this
    b = m.bins(x[:1])
    total = m.base + sum(t[b[0, i]] for i, t in enumerate(m.tables))
    total += sum(t[m.coarse(b, i)[0], m.coarse(b, j)[0]] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
    assert np.isclose(m.scores(x[:1])[0], 1 / (1 + np.exp(-total)))


# --- pieces --------------------------------------------------------------------


def _best_of_all(p, text):
    scores = {piece: (v[1], v[2]) for piece, v in p.automaton.items()}
    best = [(0.0, 0)] + [None] * len(text)
    for to in range(1, len(text) + 1):
        options = [(best[at][0] + scores[text[at:to]][0], best[at][1] - 1) for at in range(to) if text[at:to] in scores]
        width = len(text[to - 1].encode())
        best[to] = max([*options, (best[to - 1][0] - 1_000_000_000 * width, best[to - 1][1] - width)])
    return best[-1]


def test_encoding_is_the_best_one(tmp_path):
    p = Pieces.load(MODEL)
    scores = {v[2]: v[1] for v in p.automaton.values()}
    for text in ("▁the▁thing", "▁▁▁a", "▁unbelievable,", "▁é𝄞x"):
        ids = p.best(text)
        total = sum(scores.get(i, -1_000_000_000) for i in ids)
        assert (total, -len(ids)) == _best_of_all(p, text)


def test_pieces_round_trip(edge_docs):
    got = encode_pieces(edge_docs)
    rows = got.collect()
    assert len(rows) == edge_docs.count() and all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in rows)
    texts = sorted(r["text"] or "" for r in edge_docs.collect())
    assert sorted(r["text"] for r in decode_pieces(got).collect()) == texts
    assert encode_pieces(edge_docs.where("false")).collect() == []
    p = Pieces.load(MODEL)
    assert p.by_word and p.encode("") == [] and p.decode(p.encode("▁ ▁▁ a  b\n<0x41></s>")) == "▁ ▁▁ a  b\n<0x41></s>"


def test_random_texts_equal_their_whole_encoding():
    p, whole = Pieces.load(MODEL), Pieces.load(MODEL)
    assert p.by_unit
    whole.by_word, rng = False, random.Random(9)
    parts = [*"aBé .,;:!?1²'\n▁𝄞\x01", "the", "ing", " a", "  ", "▁▁", "ß.", "..", "etc.", "3.5", "é, "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        ids = p.encode(text)
        assert ids == whole.encode(text), repr(text)
        assert p.decode(ids) == text and p.gives_back(text, p.packed(text))


def test_whole_text_equals_words():
    p = Pieces.load(MODEL)
    text = "The quick (brown) fox,  and  so on…"
    words = p.encode(text)
    p.by_word = False
    assert p.encode(text) == words


def test_line_labels_without_rows(edge_docs):
    empty = edge_docs.where(F.lit(False))
    assert line_labels.judge_lines(empty, *line_labels.train_field([], [])).collect() == []


def test_long_labelled_documents_train_the_field(spark):
    rows = [(i, "\n".join(f"line {k} of {i}" for k in range(n))) for i, n in enumerate([3, 100, 101, 250])]
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    x, y = line_labels.labelled_lines(spark.createDataFrame(rows, DOCS), labels)
    assert y == [1, 1, 0, 0] and [len(s) for s in x] == [3, 100, 100, 100]


def test_a_repeated_labelled_id_trains_once(spark):
    docs = spark.createDataFrame([(1, "good line\nand more")] * 3000 + [(1, "another text"), (2, "bad | bad")], DOCS)
    x, y = line_labels.labelled_lines(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert y == [1, 0] and len(x) == 2
