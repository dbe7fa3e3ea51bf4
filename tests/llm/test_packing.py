import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from govspark.llm.packing import TOKENIZER, Ids, Windows, closest, pack_documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


def test_closest_finds_the_best_sum():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(rng.randrange(5))}
        room = rng.randrange(60)
        taken = closest(sorted(counts), counts, room)
        sums = {sum(k * n for k, n in zip(counts, c, strict=True)) for c in itertools.product(*(range(n + 1) for n in counts.values()))}
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)
        assert all(0 < n <= counts[k] for k, n in taken.items())


def test_windows_hold_every_piece_once():
    rng = random.Random(4)
    for lengths in ([], [5], [64], [1] * 200, [40] * 30, [rng.randrange(1, 64) for _ in range(500)], [63, 1, 33, 33, 33]):
        pool = Windows(64)
        for doc, size in enumerate(lengths):
            pool.add(size, (doc, 0))
        windows = [*pool.fill(last=False), *pool.fill(last=True)]
        parts = defaultdict(list)
        for window in windows:
            size = sum(p[2] for p in window)
            assert size & (size - 1) == 0 and size <= 64
            for doc, start, length in window:
                parts[doc].append((start, length))
        for doc, size in enumerate(lengths):
            ends = [0]
            for start, length in sorted(parts[doc]):
                assert start == ends[-1] and length > 0
                ends.append(start + length)
            assert ends[-1] == size
        assert sum(len(w) for w in windows) <= len(lengths) + len(windows)


def test_units_are_split_where_the_tokenizer_splits(tokenizer):
    with open(TOKENIZER, encoding="utf-8") as file:
        ids = Ids(file.read())
    assert ids.by_unit
    rng = random.Random(5)
    parts = [*"aBé \n\t\x1c\x85    ​᠎1٣'.,?!ÿ×÷ª²…_-()日\U0001d11ë\x0b", "  ", "'s", "'ll", "\r\n", "z9", "<|endoftext|>", "本.", "word", "Wort,"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert np.frombuffer(ids.of(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def _check(rows, texts, tokenizer):
    """Rows against the ids of plain tokenizing: each id in one piece, sequences gapless and without padding."""
    want = sorted(
        (doc is not None, doc or 0, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])) for doc, text in texts
    )
    copies = defaultdict(int)
    for doc, text in texts:
        copies[doc] += 1
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    got = []
    for doc, parts in pieces.items():
        if copies[doc] == 1:  # rows that share an id are only counted below
            parts.sort(key=lambda r: r["start"])
            assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]]
            got.append((doc is not None, doc or 0, tuple(np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist())))
            assert {r["doc_tokens"] for r in parts} == {len(got[-1][2])}
        else:
            whole = [(doc is not None, doc or 0, ids) for d, _, ids in want if (doc is not None, doc or 0) == (d, _)]
            assert sum(r["length"] for r in parts) == sum(len(x[2]) for x in whole)
            got += whole
    assert sorted(got) == want
    sequences = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        size = sum(n for _, n in parts)
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]]
        assert size <= 2048 and size & (size - 1) == 0


def test_edge_documents(edge_docs, tokenizer):
    rows = pack_documents(edge_docs).collect()
    _check(rows, [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()], tokenizer)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_documents(spark, sf_dir, run, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack_documents(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    _check(rows, texts, tokenizer)
    # A document is cut by force only every 2,048 ids; windows cut few pieces beside that.
    forced = sum(-(-r["doc_tokens"] // 2048) for r in rows if r["start"] == 0)
    assert len(rows) <= forced + 16 * docs.rdd.getNumPartitions()
    digest = {(r["doc_id"], r["start"], r["sequence_id"], r["offset"]): (r["length"], r["doc_tokens"], zlib.crc32(r["ids"])) for r in rows}
    query = {(r["doc_id"], r["start"], r["sequence_id"], r["offset"]): (r["length"], r["doc_tokens"], r["ids_crc32"]) for r in run("op11_pack_windows", sf_dir)}
    assert query == digest
