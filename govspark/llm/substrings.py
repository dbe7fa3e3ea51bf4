"""Substring dedup: suffix automata of reference shards, streamed over by documents for matching statistics.

A window is 20 consecutive words. A word goes if a window over it has the words of an earlier window (smaller doc_id, or
earlier in the same document); windows are judged on the input.

Which texts can matter to which automaton is found first, by hashes, so that no document meets a shard in vain:

1. Anchors. Of the 15 runs of six words in a window, the one with the least hash is its anchor. Equal windows have equal
   anchors, and neighbouring windows mostly share one, so there is one row for every eight words or so.
2. Regions. Windows whose anchor occurs more than once, merged to stretches; their words are stored.
3. First windows. The hash of each window of a region; the first (doc_id, start) of those that occur more than once. This
   is where each repeated window belongs. Counting and first places are combined before rows move.
4. Automata. Windows that are first make up the reference, cut into shards by the document and the block of 4,096 starts they
   lie in, so that a long document is spread over many. A shard's
   automaton is built over the words themselves, in reading order, so that its states know where their words occur
   first. The stretches that repeat windows of that shard stream through it; wherever at least 20 words match and the
   first place is an earlier one, those words go. Shards asked for by many stretches are sent to as many tasks as those
   need, and each takes its part of the stretches.

Hashes only choose what is compared; words are compared in step 4. (A window is missed only if another one has its
64-bit hash and comes first.)
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import Scratch, collision_free, renewed, table
from govspark.llm.registry import query

WINDOW, GRAM, BLOCK = 20, 6, 4096
SHARD_WINDOWS, TASK_WORDS = 50_000, 400_000
_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 18
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_DRAWN = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, 256, np.uint64)
_LEAST = -(1 << 63)


def _positions(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all rows one after another, where each word begins and ends in them, and the first word of each row.

    The last list has one entry more, the number of words. A null has no words.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    rows, data = texts.buffers()[1:]
    if not len(texts) or data is None:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, np.zeros(len(texts) + 1, np.int64)
    rows = np.frombuffer(rows, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]]
    rows = rows - rows[0]
    inner = rows[(rows > 0) & (rows < len(raw))]
    inside = np.ones(len(raw) + 2, np.bool_)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    begins[inner] = inside[1 + inner]
    ends[inner - 1] = inside[inner]
    begin, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    return raw, begin, end, np.searchsorted(begin, rows)


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the multiplier and of its inverse, modulo 2^64."""
    up, down = np.full(size, _MULTIPLIER), np.full(size, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all rows, and the first word of each row (with the number of words at the end).

    A word's hash is the sum of a drawn number for each byte times a power for its place, so differences of running sums give
    the hashes of all words at once. A piece of a few hundred kilobytes (or one word, if longer) is worked on at a time.
    """
    raw, begin, end, starts = _positions(texts)
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        base = begin[at]
        to = max(at + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        size = int(end[to - 1] - base)
        up, down = _powers(max(_PIECE, 1 << size.bit_length()))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_DRAWN[raw[base : base + size]] * up[:size], out=sums[1:])
        b = begin[at:to] - base
        out[at:to] = (sums[end[at:to] - base] - sums[b]) * down[b]
        at = to
    out ^= out >> np.uint64(32)
    out *= _MIXER
    out ^= out >> np.uint64(29)
    return out, starts


def _slices(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A mixed hash of every ``width`` neighbours."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        out *= _MULTIPLIER
        out += h[i : i + n] if n > 0 else out
    out ^= out >> np.uint64(32)
    out *= _MIXER
    out ^= out >> np.uint64(29)
    return out


def _in_one_row(starts: np.ndarray, windows: int) -> np.ndarray:
    """Row of each window that doesn't reach into the next row, else -1."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:windows]
    return np.where(np.arange(windows) + WINDOW <= starts[row + 1], row, -1)


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first, if equal) among every ``width`` neighbours."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        have += step
    return at


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, doc, span of each run of windows with the same anchor; span is 16 times the first start plus the others' number."""

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            h, starts = _hashed(part["text"])
            if len(h) < WINDOW:
                continue
            g = _rolled(h, GRAM)
            least = _least(g, WINDOW - GRAM + 1)
            row = _in_one_row(starts, len(least))
            new = np.ones(len(least) + 1, np.bool_)
            new[1:-1] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            first = np.nonzero(new)[0]
            size, first = np.diff(first), first[:-1]
            fine = row[first] >= 0
            size, first = size[fine], first[fine]
            doc = np.asarray(part["doc"])[row[first]]
            span = (first - starts[row[first]]) * 16 + size - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[least[first]].view(np.int64)), pa.array(doc), pa.array(span.astype(np.int64))], ["anchor", "doc", "span"]
            )

    return docs.mapInArrow(find, "anchor long, doc long, span long")


def regions(docs: DataFrame) -> DataFrame:
    """doc, text_hash, start, words of the stretches that ``spans`` cover."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            raw, begin, end, starts = _positions(part["text"])
            count = np.maximum(np.diff(starts) - WINDOW + 1, 0)
            spans, ends = _list(part["spans"])
            row = np.repeat(np.arange(part.num_rows), np.diff(ends))
            lo = np.minimum(spans >> 4, count[row])
            hi = np.minimum(lo + (spans & 15) + 1, count[row])
            size = len(begin) + 1
            step = np.bincount(starts[row] + lo, minlength=size) - np.bincount(starts[row] + hi, minlength=size)
            # The windows that reach into the next row are never inside, so no stretch does.
            inside = np.concatenate([[0], np.cumsum(step) > 0, [0]])
            a, b = np.nonzero(np.diff(inside) == 1)[0], np.nonzero(np.diff(inside) == -1)[0]
            row = np.searchsorted(starts, a, side="right") - 1
            data = raw.tobytes()
            words = [data[x:y] for x, y in zip(begin[a].tolist(), end[b + WINDOW - 2].tolist(), strict=True)]
            doc, mark = (pa.array(np.asarray(part[c])[row], pa.int64()) for c in ("doc", "text_hash"))
            arrays = [doc, mark, pa.array(a - starts[row], pa.int64()), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "text_hash", "start", "words"])

    return docs.mapInArrow(cut, "doc long, text_hash long, start long, words binary")


def windows(found: DataFrame) -> DataFrame:
    """hash, doc, start of every window of the regions."""

    def roll(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            h, starts = _hashed(part["words"])
            rolled = _rolled(h, WINDOW)
            row = _in_one_row(starts, len(rolled))
            fine = np.nonzero(row >= 0)[0]
            row = row[fine]
            start = np.asarray(part["start"])[row] + fine - starts[row]
            arrays = [pa.array(rolled[fine].view(np.int64)), pa.array(np.asarray(part["doc"])[row]), pa.array(start)]
            yield pa.RecordBatch.from_arrays(arrays, ["hash", "doc", "start"])

    return found.select("doc", "start", "words").mapInArrow(roll, "hash long, doc long, start long")


_RUN = ["start", "size", "first_doc", "first_start"]


def _list(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of all rows one after another, and where each row's begin."""
    ends = np.asarray(lists.offsets)
    return np.asarray(lists.flatten()), ends - ends[0]


def _flat(lists: pa.ListArray, fields: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of all structs of a list column one after another, and where each row's begin."""
    flat, ends = lists.flatten(), np.asarray(lists.offsets)
    return [np.asarray(flat.field(c)) for c in fields], ends - ends[0]


def runs(grouped: DataFrame) -> DataFrame:
    """doc, runs: neighbouring windows whose first places are neighbours in one block too, as (start, size, first_doc, first_start)."""

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            (start, first_doc, first_start), ends = _flat(part["hits"], ["start", "first_doc", "first_start"])
            row = np.repeat(np.arange(part.num_rows), np.diff(ends))
            order = np.lexsort((first_start, first_doc, start, row))
            r, s, d, f = row[order], start[order], first_doc[order], first_start[order]
            new = np.ones(len(s), np.bool_)
            new[1:] = (np.diff(r) != 0) | (np.diff(s) != 1) | (np.diff(d) != 0) | (np.diff(f) != 1) | (np.diff(f // BLOCK) != 0)
            at = np.nonzero(new)[0]
            size = np.diff(np.append(at, len(s)))
            flat = pa.StructArray.from_arrays([pa.array(x) for x in (s[at], size, d[at], f[at])], _RUN)
            offsets = np.searchsorted(r[at], np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part["doc"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["doc", "runs"])

    return grouped.mapInArrow(merge, f"doc long, runs array<struct<{', '.join(c + ': long' for c in _RUN)}>>")


def _shard(doc: np.ndarray, start: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a document's block of windows, so that neither long documents nor patterns in ids fill one shard."""
    h = doc.astype(np.int64).view(np.uint64) * _MULTIPLIER + (start // BLOCK).astype(np.uint64)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * _MIXER
    return ((h >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def pieces(found: DataFrame, shards: int) -> DataFrame:
    """reference, shard, doc, text_hash, start, words: parts of the regions that make up a shard or have to go through it."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            out: list[tuple] = []
            (start, size, first_doc, first_start), ends = _flat(part["runs"], _RUN)
            raw, begin, end_of, words = _positions(part["words"])
            data = raw.tobytes()
            for k, (doc, mark, at) in enumerate(zip(*(part[c].to_pylist() for c in ("doc", "text_hash", "start")), strict=True)):
                last = at + int(words[k + 1] - words[k]) - WINDOW
                lo, hi = ends[k] + np.searchsorted(start[ends[k] : ends[k + 1]], (at, last + 1))
                if lo == hi:
                    continue
                s, d, f = start[lo:hi], first_doc[lo:hi], first_start[lo:hi]
                end = np.minimum(s + size[lo:hi], last + 1)
                own = (d == doc) & (f == s)
                shard = _shard(d, f, shards)
                new = np.ones(len(s), np.bool_)
                new[1:] = (own[1:] != own[:-1]) | (shard[1:] != shard[:-1]) | (s[1:] > end[:-1])
                b = np.nonzero(new)[0]
                ends_at = np.maximum.reduceat(end, b)
                origin = int(words[k]) - at
                for is_own, to, a, z in zip(own[b].tolist(), shard[b].tolist(), s[b].tolist(), ends_at.tolist(), strict=True):
                    out.append((is_own, to, doc, mark, a, data[begin[origin + a] : end_of[origin + z + WINDOW - 2]]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["reference", "shard", "doc", "text_hash", "start", "words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return found.mapInArrow(cut, "reference boolean, shard long, doc long, text_hash long, start long, words binary")


class SuffixAutomaton:
    """Over whole numbers. ``first[state]`` is the end of the first place where the state's strings occur."""

    def __init__(self):
        self.step, self.link, self.length, self.first = [{}], [-1], [0], [-1]
        self.last, self.size = 0, 0

    def add(self, symbol: int) -> None:
        step, link, length, first = self.step, self.link, self.length, self.first
        new, at = len(step), self.last
        step.append({})
        length.append(length[at] + 1)
        first.append(self.size)
        link.append(0)
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            old = step[at][symbol]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(step)
                step.append(step[old].copy())
                length.append(length[at] + 1)
                first.append(first[old])
                link.append(link[old])
                link[old] = link[new] = copy
                while at >= 0 and step[at].get(symbol) == old:
                    step[at][symbol] = copy
                    at = link[at]
        self.last = new
        self.size += 1

    def matches(self, symbols: list[int], least: int) -> Iterator[tuple[int, int]]:
        """(end in ``symbols``, end of the first place) wherever the last ``least`` symbols occur."""
        step, link, length, first = self.step, self.link, self.length, self.first
        state = have = 0
        for end, symbol in enumerate(symbols):
            while state and symbol not in step[state]:
                state = link[state]
                have = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                have += 1
            if have >= least:
                at = state
                while length[link[at]] >= least:
                    at = link[at]
                yield end, first[at]


def judge(reference: pd.DataFrame, stream: pd.DataFrame) -> pd.DataFrame:
    """doc, text_hash, start, size of the stretches to remove, by one shard's automaton."""
    columns = ["doc", "text_hash", "start", "size"]
    if reference.empty or stream.empty:
        return pd.DataFrame(columns=columns)
    number: dict[bytes, int] = {}
    automaton, docs, places = SuffixAutomaton(), [], []
    ordered = reference.sort_values(["doc", "start", "text_hash"])
    for k, (doc, start, raw) in enumerate(zip(ordered["doc"], ordered["start"], ordered["words"], strict=True)):
        words = raw.split()
        for w in words:
            automaton.add(number.setdefault(w, len(number)))
        automaton.add(-1 - k)  # no word: nothing matches across passages
        docs += [doc] * (len(words) + 1)
        places += range(start, start + len(words) + 1)
    out = []
    for doc, mark, start, raw in zip(stream["doc"], stream["text_hash"], stream["start"], stream["words"], strict=True):
        open_ = None
        for end, first in automaton.matches([number.get(w, 1 << 40) for w in raw.split()], WINDOW):
            at = first - WINDOW + 1
            if (docs[at], places[at]) < (doc, start + end - WINDOW + 1):
                if open_ and end - WINDOW + 1 <= open_[1]:
                    open_[1] = end + 1
                else:
                    if open_:
                        out.append((doc, mark, start + open_[0], open_[1] - open_[0]))
                    open_ = [end - WINDOW + 1, end + 1]
        if open_:
            out.append((doc, mark, start + open_[0], open_[1] - open_[0]))
    return pd.DataFrame(out, columns=columns)


def repeated_stretches(docs: DataFrame, work: Scratch) -> DataFrame:
    """doc, text_hash, gone: array of (start, size) to remove from each text of ``docs`` (doc, text_hash, text) that has any."""
    anchor = work.write(anchors(docs.select("doc", "text")), "anchors")
    # The counts are a table of their own, so that both sides of the join are dealt out for it and a hot anchor can be split.
    shared = work.write(anchor.groupBy("anchor").count().where("count > 1").select("anchor"), "shared")
    spans = anchor.join(shared.hint("shuffle_hash"), "anchor").groupBy("doc").agg(F.collect_list("span").alias("spans"))
    spans = work.write(spans, "spans")
    work.drop("anchors", "shared")
    region = work.write(regions(docs.join(spans.hint("shuffle_hash"), "doc")), "regions")
    work.drop("spans")
    every = windows(region)
    place = F.min(F.struct(F.col("doc").alias("first_doc"), F.col("start").alias("first_start")))
    first = every.groupBy("hash").agg(place.alias("f"), F.count("*").alias("n")).where("n > 1").select("hash", "f.*")
    first = work.write(first, "first").hint("shuffle_hash")
    hits = every.join(first, "hash").groupBy("doc").agg(F.collect_list(F.struct("start", "first_doc", "first_start")).alias("hits"))
    run = work.write(runs(hits), "runs")
    own = F.aggregate(
        F.filter("runs", lambda r: (r["first_doc"] == F.col("doc")) & (r["first_start"] == r["start"])), F.lit(0).cast("long"), lambda s, r: s + r["size"]
    )
    total = run.agg(F.sum(own).alias("n")).first()["n"] or 0
    piece = work.write(pieces(region.join(run.hint("shuffle_hash"), "doc"), 1 + total // SHARD_WINDOWS), "pieces")
    work.drop("regions", "runs", "first")
    reference, stream = piece.where("reference").drop("reference"), piece.where("NOT reference").drop("reference")
    tasks = stream.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("words")) / (6 * TASK_WORDS)).cast("int").alias("tasks"))
    reference = reference.join(tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    stream = stream.join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("doc", "start"), F.col("tasks")).cast("int"))
    gone = renewed(reference).groupBy("shard", "task").cogroup(stream.groupBy("shard", "task")).applyInPandas(judge, "doc long, text_hash long, start long, size long")
    gone = gone.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "size")).alias("gone"))
    gone = work.write(gone, "gone")
    work.drop("pieces")
    return gone


def _gone(n: int, gone: list[dict]) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    for g in gone:
        step[min(g["start"], n)] += 1
        step[min(g["start"] + g["size"], n)] -= 1
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, text without repeated windows, and n_words, n_removed, kept_sha256.

    What is left of a changed text is its words in order, each with the white space that follows it; other texts stay as
    they are, null included. kept_sha256 is over the kept words joined by one space. Columns named like the new ones are
    replaced. Rows with the same doc_id count as one document: windows at the same start aren't earlier than one another.
    A null id comes before all others. An empty table gives no rows.
    """
    spark, work = docs.sparkSession, Scratch(docs.sparkSession, "substrings")
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    doc, mark, gone = collision_free(docs.columns, "doc_key", "text_hash", "gone")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    hashed = F.coalesce(F.xxhash64("text"), F.lit(0))
    found = repeated_stretches(docs.select(key.alias("doc"), hashed.alias("text_hash"), "text"), work)
    found = found.select(F.col("doc").alias(doc), F.col("text_hash").alias(mark), F.col("gone").alias(gone))
    joined = docs.withColumns({doc: key, mark: hashed}).join(found.hint("shuffle_hash"), [doc, mark], "left").select(*docs.columns, gone)
    at = docs.columns.index("text")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(parts):
            raw, begin, end, starts = _positions(part.column(at))
            data, texts, changed, removed, digests = raw.tobytes(), [], [], [], []
            for k, out in enumerate(part.column(len(part.columns) - 1).to_pylist()):
                a, z = int(starts[k]), int(starts[k + 1])
                words = data[begin[a] : end[z - 1]].split() if a < z else []
                flags = _gone(z - a, out) if out else None
                changed.append(flags is not None and bool(flags.any()))
                if changed[-1]:
                    # The white space after the last word is the end of the row's text.
                    text = part.column(at)[k].as_py().encode("utf-8", "surrogatepass")
                    lead = len(text) - len(text.lstrip(b" \t\n\v\f\r"))
                    cuts = [*(begin[a:z] - begin[a] + lead).tolist(), len(text)]
                    stay = np.nonzero(~flags)[0].tolist()
                    texts.append(b"".join([text[cuts[i] : cuts[i + 1]] for i in stay]).decode("utf-8", "surrogatepass"))
                    words = [words[i] for i in stay]
                removed.append(int(flags.sum()) if flags is not None else 0)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            counts = np.diff(starts)
            columns = list(part.columns[:-1])
            if texts:
                columns[at] = pc.replace_with_mask(columns[at], pa.array(changed), pa.array(texts, columns[at].type))
            new = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *new], [*part.schema.names[:-1], "n_words", "n_removed", "kept_sha256"])

    schema = docs.schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return joined.mapInArrow(cut, schema)


_SQL = rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, row_id, unnest(range(1, len(words) - {WINDOW - 2})) AS start, words FROM w WHERE len(words) >= {WINDOW}),
k AS (SELECT doc_id, row_id, start, array_to_string(words[start : start + {WINDOW - 1}], ' ') AS run FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS turn FROM k),
g AS (SELECT DISTINCT row_id, unnest(range(start, start + {WINDOW})) AS pos FROM f WHERE turn > 1),
p AS (
  SELECT w.doc_id, w.row_id, u.pos, words[u.pos] AS word, g.pos IS NULL AS stays
  FROM w, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS pos) u LEFT JOIN g ON g.row_id = w.row_id AND g.pos = u.pos),
c AS (
  SELECT row_id, count(*) AS n_words, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (stays) AS kept
  FROM p GROUP BY row_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (row_id)
"""


@query("op3_substring_dedup", _SQL)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
