import random
import zlib
from collections import Counter

import pytest

from govspark.llm import variants
from govspark.llm.common import Scratch
from govspark.llm.variants import near_in_list, near_words, scan, variant_forms, vocabulary


def _near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def _brute(counts):
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if _near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        rows[w] = (form, n, len(near), counts[form] if form else None)
    out = []
    for w, (form, n, near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, n, near, form_n))
    return sorted(out)


def _words(seed, size, letters, low, high):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(low, high))): rng.choice([1, 2, 5, 26, 130, 700]) for _ in range(size)}


def test_scan_finds_words_one_edit_away():
    for seed in range(30):
        names = sorted(_words(seed, 120, "abé", 0, 7))
        shared = [0] + [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(names, names[1:], strict=False)]
        for word in names:
            assert [names[i] for i in scan(names, shared, word)] == [v for v in names if _near(word, v)]


def test_each_pair_is_in_one_list():
    counts = _words(7, 300, "ab", 6, 9)
    for a in (6, 7):
        pairs = Counter()
        for tail in (0, a - a // 2):
            groups = {}
            for w in counts:
                if len(w) in (a, a + 1):
                    groups.setdefault(w[-tail:] if tail else w[: a // 2], []).append((w, counts[w]))
            for words in groups.values():
                for w, n, _, _ in near_in_list(words, a, tail, backwards=bool(tail)):
                    pairs[w] += n
        want = {w: sum(_near(w, v) and min(len(w), len(v)) == a for v in counts) for w in counts}
        assert pairs == {w: n for w, n in want.items() if n}


@pytest.mark.parametrize("list_words", [3, 2000])
def test_forms_and_roots(spark, list_words, monkeypatch):
    monkeypatch.setattr(variants.near_words, "__defaults__", (list_words,))
    for counts in ({**_words(1, 300, "abc", 1, 8), "chain": 3, "chains": 20, "chaine": 20, "chainst": 150, "chainsty": 800},):
        words = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
        got = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variant_forms(words).collect())
        assert got == _brute(counts)


def test_crowded_lists_are_cut(spark):
    """All words share a first half and a last half with many others."""
    counts = {f"common{x}{y}ending": 5 + ord(x) for x in "abcdefghijklmnopqrst" for y in "abcdefghijklmnopqrst"}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in near_words(words, Scratch(spark, "test"), 30).collect()}
    assert got == {w: (38, *max(((counts[v], v) for v in counts if _near(w, v)), key=lambda t: (t[0], [-ord(c) for c in t[1]]))) for w in counts}


def test_words_of_edge_documents(spark, edge_docs, monkeypatch):
    extra = [(20, "ÀBCdef× Éa9straße_WORD ÿ÷", "x"), (None, "Über über ÜBER", "y"), (21, "word " * 400, "z")]
    docs = edge_docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(i) for i in range(0xC0, 0x100)}
    want = Counter()
    for r in docs.collect():
        text = "".join(c if c in letters else " " for c in r["text"] or "")
        for run in text.split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            crc = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if crc % 199 == 0:
                at = crc % len(run)
                run = run[:at] + run[at + 1 :]
            want[run] += 1
    for held in (300_000, 3):
        monkeypatch.setattr(variants, "HELD_WORDS", held)
        assert {r["word"]: r["n"] for r in vocabulary(docs, 1, 1).collect()} == {w: n for w, n in want.items() if w}
    kept = {r["word"]: r["n"] for r in vocabulary(docs, 4, 5).collect()}
    assert kept == {w: n for w, n in want.items() if n >= 5 and len(w) >= 4}


def test_empty_table(spark):
    assert variant_forms(spark.createDataFrame([], "word string, n long")).collect() == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variant_forms(vocabulary(docs)).collect() == []
    lone = spark.createDataFrame([("", 9), ("a", 2), (None, 7), ("b", None)], "word string, n long")
    assert [tuple(r) for r in variant_forms(lone).collect()] == _brute({"a": 2})
