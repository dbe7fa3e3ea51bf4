"""Spelling variants: words of the corpus that lie one edit from a much more frequent word.

Near words are found by sorted-list dynamic programming. A sorted list of words is scanned for each word of it; the rows
of the edit matrix, a band of three cells each, are kept for the prefix that neighbouring words share, and as soon as
every cell of a row exceeds one edit, all words that share that prefix are skipped.

So that no task scans the whole vocabulary, lists are cut by what an edit must leave alone: of two words one edit apart, of
which the shorter has ``a`` letters, either the first half or the last half is the same in both. Each list holds the words
that share such a half; lists of a last half are sorted backwards. A list over ``LIST_WORDS`` is cut again: the part in
which the edit may lie is halved, and its words go to two lists with a longer common part each. This ends when that part is
one letter, where a list can't hold more words than the alphabet allows. Every pair belongs to exactly one list, the one
that its first differing letter names, so counts of near words need no list of pairs: each list gives one row per word.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, crc32_sql, table
from govspark.llm.registry import query

_RUNS = re.compile("[A-Za-z\u00c0-\u00ff]+").findall
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
LIST_WORDS, HELD_WORDS = 2_000, 300_000
#: Of the runs of a document, those whose checksum this number divides lose a letter.
DAMAGE = 199


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def _damage(doc_id: int | None, word: str) -> str:
    crc = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    return word if crc % DAMAGE else word[: crc % len(word)] + word[crc % len(word) + 1 :]


def _count(parts: Iterator[pa.RecordBatch], letters: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words; at most ``HELD_WORDS`` and those of one text are held."""
    counts: Counter = Counter()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for part in parts:
        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
            runs: Counter = Counter()
            for run, n in Counter(_RUNS(text or "")).items():
                if len(run) >= letters:  # a run only gets shorter
                    runs[_lower(run)] += n
            for word, n in runs.items():
                counts[_damage(doc_id, word)] += n
            if len(counts) > HELD_WORDS:
                yield batch()
    yield batch()


def vocabulary(docs: DataFrame, letters: int = MIN_LETTERS, count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words with at least so many letters and occurrences in the whole texts of ``docs`` (doc_id, text).

    Words are runs of letters with A-Z lowered, of which one in ``DAMAGE``, told by the checksum of ``<doc_id>:<word>``,
    lacks a letter. Null texts have none; a null id is empty text. Other columns are left alone. Counts are merged in the
    tasks before they are shuffled.
    """
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda parts: _count(parts, letters), "word string, n long")
    return counted.where(F.char_length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _row(before: tuple, depth: int, letter: str, word: str) -> tuple:
    """The next row of the edit matrix: distances of a prefix with ``depth`` letters to those of ``word`` with one less, as
    many and one more. Distances over one are 2."""
    left, mid, right = before
    n = len(word)
    a = min(left + (letter != word[depth - 2]), mid + 1) if 2 <= depth <= n + 1 else (1 if depth == 1 else 2)
    b = min(mid + (letter != word[depth - 1]), right + 1, a + 1) if depth <= n else 2
    c = min(right + (letter != word[depth]), b + 1) if depth < n else 2
    return min(a, 2), min(b, 2), min(c, 2)


def scan(names: list[str], shared: list[int], word: str) -> Iterator[int]:
    """Places in the sorted ``names`` of those exactly one edit from ``word``; ``shared[i]`` is the prefix shared with i - 1."""
    rows, i = [(2, 0, 1)], 0
    while i < len(names):
        name = names[i]
        # After a skip too: the name before shares with this one what the last scanned one does.
        del rows[shared[i] + 1 :]
        for depth in range(len(rows), len(name) + 1):
            row = _row(rows[-1], depth, name[depth - 1], word)
            if min(row) > 1:
                i = bisect_left(names, name[:depth] + "\U0010ffff", i)
                break
            rows.append(row)
        else:
            gap = len(word) - len(name)
            if -1 <= gap <= 1 and rows[-1][gap + 1] == 1:
                yield i
            i += 1


def near_in_list(words: list[tuple[str, int]], shorter: int, tail: int, backwards: bool) -> Iterator[tuple[str, int, int, str]]:
    """word, number of near words, largest n among them and the word that has it, over the pairs that belong to a list.

    Pairs have a word with ``shorter`` letters. Those that agree up to the last ``tail`` letters belong to another list.
    """
    turned = sorted((w[::-1] if backwards else w, w, n) for w, n in words)
    names = [t[0] for t in turned]
    shared = [0]
    for x, y in zip(names, names[1:], strict=False):
        k = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        shared.append(k)
    count, best = [0] * len(names), [None] * len(names)

    def note(i: int, k: int) -> None:
        count[i] += 1
        found = (-turned[k][2], turned[k][1])
        if best[i] is None or found < best[i]:
            best[i] = found

    for i, (name, word, _) in enumerate(turned):
        if len(word) != shorter:
            continue
        for k in scan(names, shared, name):
            other = turned[k][1]
            if tail and word[: shorter - tail] == other[: shorter - tail]:
                continue
            note(i, k)
            if len(other) > shorter:
                note(k, i)
    for (_, word, _), c, found in zip(turned, count, best, strict=True):
        if c:
            yield word, c, -found[0], found[1]


def _halved(rows: DataFrame) -> DataFrame:
    """Rows in which the edit may lie behind ``head`` and before ``tail`` letters, as two rows with half of that part each."""
    part = F.col("a") - F.col("head") - F.col("tail")
    half = F.floor(part / 2).cast("int")
    sides = F.array(
        F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
        F.struct(F.col("head").alias("head"), (F.col("tail") + part - half).cast("int").alias("tail")),
    )
    return rows.select("word", "n", "a", F.explode(sides).alias("side")).select("word", "n", "a", "side.head", "side.tail")


def _listed(rows: DataFrame) -> DataFrame:
    """With the letters that all words of a list share."""
    return rows.select(
        "word", "n", "a", "head", "tail",
        F.col("word").substr(F.lit(1), F.col("head")).alias("first"),
        F.when(F.col("tail") > 0, F.col("word").substr(F.char_length("word") - F.col("tail") + 1, F.col("tail"))).otherwise("").alias("last"),
    )


_LIST = ["a", "head", "tail", "first", "last"]
_NEAR = "word string, n_near long, best_n long, best string"


def _scan_lists(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by list."""
    out, words, current = [], [], None

    def finish() -> None:
        if len(words) > 1:
            a, head, tail, _, _ = current
            out.extend(near_in_list(words, a, tail, backwards=tail > head))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])

    for part in parts:
        keys = list(zip(*[part[c].to_pylist() for c in _LIST], strict=True))
        for key, word, n in zip(keys, part["word"].to_pylist(), part["n"].to_pylist(), strict=True):
            if key != current:
                finish()
                words, current = [], key
            words.append((word, n))
        if len(out) >= 10_000:
            yield batch()
            out.clear()
    if current is not None:
        finish()
    yield batch()


def near_words(words: DataFrame, work: Scratch, list_words: int = LIST_WORDS) -> DataFrame:
    """word, n_near, best_n, best of every word that has near ones; ``words`` has distinct words and their n."""
    length = F.char_length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("a")).where(F.col("a") >= 1)
    rows, level, lists = whole.select("word", "n", "a", F.lit(0).alias("head"), F.lit(0).alias("tail")), 0, None
    while True:
        rows = work.write(_listed(_halved(rows)), f"lists{level}")
        crowded = rows.groupBy(*_LIST).count().where((F.col("count") > list_words) & (F.col("a") - F.col("head") - F.col("tail") > 1))
        crowded = work.write(crowded.select(*_LIST), f"crowded{level}")
        if crowded.isEmpty():
            ready = rows
        else:
            ready = rows.join(crowded, _LIST, "left_anti")
            again = rows.join(crowded, _LIST, "left_semi")
        lists = ready if lists is None else lists.unionByName(ready)
        if ready is rows:
            break
        rows, level = again, level + 1
    found = lists.repartition(*_LIST).sortWithinPartitions(*_LIST).select(*_LIST, "word", "n").mapInArrow(_scan_lists, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("least")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("least.less")).alias("best_n"), F.col("least.best").alias("best"))


def variant_forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    ``words`` has distinct words (word, n); other columns are left alone, rows with a null or empty word, or without n, don't count. Two
    words are near if one edit of one code point separates them. The form is the near word with the largest n, of equal ones
    the first by code points, if that n is at least ``ratio`` times the word's own; else null. Forms rise in n, so
    following them ends at the root. An empty table gives no rows.
    """
    work = Scratch(words.sparkSession, "variants")
    words = work.write(words.where((F.col("word") != "") & F.col("n").isNotNull()).select("word", F.col("n").cast("long")), "words")
    near = near_words(words, work)
    has_form = F.col("best_n") >= ratio * F.col("n")
    formed = work.write(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "formed",
    )
    # Twice the way in each pass; n grows by the ratio with each step of a way.
    ways, level = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), 0
    while True:
        ways = work.write(ways, f"ways{level}")
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if ways.join(on, "root", "left_semi").isEmpty():
            break
        ways, level = ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), level + 1
    return formed.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
    translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY doc, run),
summed AS (SELECT run, n, {crc32_sql("doc || ':' || run")} AS crc FROM counted),
marked AS (
  SELECT CASE WHEN crc % 199 = 0 THEN left(run, CAST(crc % length(run) AS INT)) || substr(run, CAST(crc % length(run) AS INT) + 2)
    ELSE run END AS word, n
  FROM summed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM marked GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, left(word, CAST(i - 1 AS INT)) || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.best_n >= 5 * w.n THEN b.best END AS form, CASE WHEN b.best_n >= 5 * w.n THEN b.best_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON w.next = f.word)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w ON f.word = w.word AND w.next IS NULL
"""


@query("op12_spelling_variants", _SQL)
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of the words of all whole texts, some of which are damaged on purpose."""
    return variant_forms(vocabulary(table(spark, sf_dir, "documents")))
