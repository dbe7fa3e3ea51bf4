"""Packing by minimum bin slack: documents as token ids, laid into sequences of at most ``CAPACITY`` ids.

Every document is cut into full sequences and one remaining piece. The remaining pieces of a task are a multiset of
lengths. For each window the longest length left is set, and a subset-sum dynamic program over bitsets (bit s says that
the sum s can be reached; a length with a count enters as 1, 2, 4, ... copies) finds the multiset that comes closest to
the room left. Going back through the bitsets gives how often each length is taken, and the same multiset is used as
often as the counts allow. Where no sum fills a window, one more piece is cut to fill it. What is left at the end of a
task is cut into sequences whose lengths are powers of two, so nothing is padded.

Each task packs its own documents, chunk after chunk, so nothing is shuffled and memory is bounded by ``CHUNK_IDS`` and
the longest document. Sequence numbers are the task's number times 2^40 plus a number inside the task; a repeated task
reads the same split and gives the same rows.
"""

from __future__ import annotations

import json
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import table
from govspark.llm.registry import query

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 1
#: Ids a task holds at once (4 bytes each), and pieces it may keep back for the next chunk when no window can be filled.
CHUNK_IDS, HELD_IDS = 4_000_000, 500_000
KEPT_UNITS, KEPT_LENGTH = 1_000_000, 64
#: Ids sent on in one Arrow batch.
BATCH_IDS = 1_000_000

#: White space as the tokenizer's own split pattern sees it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?"
_PLAIN = re.compile(f" ?[{_LETTER}]+|[{_MARK}]+").fullmatch
_UNITS = re.compile(
    f" ?[{_LETTER}]+(?=[{_WHITE}{_MARK}]|\\Z)|[{_MARK}]+(?=[{_WHITE}{_LETTER}]|\\Z)| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
).findall


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Ids(dict):
    """Token ids as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer never merges over a place where its pattern splits, so the ids of a text are those of its
    units one after another: a word of Latin letters with the space before it, a run of marks, another run without white
    space, or white space. Units met before are looked up. Other tokenizers, and texts that hold a special token's string,
    go through the tokenizer whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, shape = Tokenizer.from_str(spec), json.loads(spec)
        split = shape.get("pre_tokenizer") or {}
        self.by_unit = (
            split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and shape.get("normalizer") is None
        )
        self.special = [t["content"] for t in shape.get("added_tokens", [])]
        # Byte-level vocabularies write a byte that prints as itself, and the others as U+0100 and on, in order.
        prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.letters = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in prints)}

    def __missing__(self, unit: str) -> bytes:
        if _PLAIN(unit):  # one stretch of the split pattern: straight to the merges
            letters = unit.encode().decode("latin-1").translate(self.letters)
            ids = _packed([t.id for t in self.tokenizer.model.tokenize(letters)])
        else:
            ids = self.whole(unit)
        if len(unit) <= KEPT_LENGTH:
            if len(self) >= KEPT_UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        if not self.by_unit or any(t in text for t in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _UNITS(text)))


_LOADED: dict[str, Ids] = {}


def loaded(spec: str) -> Ids:
    """The tokenizer of this worker, with the units that earlier tasks met."""
    if spec not in _LOADED:
        _LOADED[spec] = Ids(spec)
    return _LOADED[spec]


def closest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How often to take each of the ascending ``lengths``, at most ``counts`` times, for the largest sum up to ``room``."""
    reach, steps, full = 1, [], 1 << room
    for k in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        size = lengths[k]
        left, times = min(counts[size], room // size), 1
        while left:
            times = min(times, left)
            steps.append((size, times, reach))
            reach |= reach << size * times & (full << 1) - 1
            left, times = left - times, times * 2
        if reach & full:
            break
    at, taken = reach.bit_length() - 1, {}
    for size, times, before in reversed(steps):
        if not before >> at & 1:
            taken[size] = taken.get(size, 0) + times
            at -= size * times
    return taken


class Windows:
    """The remaining pieces of a task by length; a piece is (document, start)."""

    def __init__(self, capacity: int):
        self.capacity, self.pieces, self.lengths, self.counts, self.held = capacity, {}, [], {}, 0

    def add(self, length: int, piece: tuple) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
            self.pieces[length], self.counts[length] = [], 0
        self.pieces[length].append(piece)
        self.counts[length] += 1
        self.held += length

    def _take(self, length: int) -> tuple:
        piece = self.pieces[length].pop()
        self.counts[length] -= 1
        self.held -= length
        if not self.counts[length]:
            del self.pieces[length], self.counts[length], self.lengths[bisect_left(self.lengths, length)]
        return piece

    def fill(self, last: bool) -> Iterator[list[tuple]]:
        """Windows as lists of (document, start, length). Before the last chunk, what fills no window is kept if it is little."""
        while self.held >= self.capacity:
            longest = self.lengths[-1]
            self.counts[longest] -= 1
            chosen = closest(self.lengths, self.counts, self.capacity - longest)
            self.counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = self.capacity - sum(size * times for size, times in chosen.items())
            if slack:
                if not last and self.held < HELD_IDS:
                    return
                window = [(*self._take(size), size) for size, times in chosen.items() for _ in range(times)]
                # Every piece left is longer than the slack, or it would have been taken.
                size = self.lengths[-1]
                doc, start = self._take(size)
                self.add(size - slack, (doc, start + slack))
                yield [*window, (doc, start, slack)]
                continue
            for _ in range(min(self.counts[size] // times for size, times in chosen.items())):
                yield [(*self._take(size), size) for size, times in chosen.items() for _ in range(times)]
        if last:
            yield from self._powers()

    def _powers(self) -> Iterator[list[tuple]]:
        """The rest, less than a window, in sequences whose lengths are powers of two."""
        rest = [(*self._take(size), size) for size in self.lengths[::-1] for _ in range(self.counts[size])]
        room, window = 0, []
        total = sum(size for _, _, size in rest)
        while rest or window:
            if not room:
                if window:
                    yield window
                if not rest:
                    return
                room, window = 1 << total.bit_length() - 1, []
                total -= room
            doc, start, size = rest.pop()
            part = min(size, room)
            window.append((doc, start, part))
            room -= part
            if part < size:
                rest.append((doc, start + part, size - part))


_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _batches(windows: Iterator[list[tuple]], first: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Rows of the windows and the number of windows so far."""
    rows, held, number = [], 0, first

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)

    for window in windows:
        offset = 0
        for (doc_id, ids), start, length in window:
            rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, number, offset))
            offset += length
        number, held = number + 1, held + offset
        if held >= BATCH_IDS:
            yield batch(), number
            rows, held = [], 0
    if rows:
        yield batch(), number


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text; other columns are left alone. A document's ids are those of its text, then ``end_id``;
    ``ids`` holds those of the piece, four little-endian bytes each. Null and empty texts are one piece with ``end_id``
    alone. Repeated rows, and rows without an id, are documents of their own. An empty table gives no rows. The vocabulary
    file is read by the driver and sent to the tasks; its size doesn't depend on the documents.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    end = _packed([end_id])

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pool = loaded(spec.value), Windows(capacity)
        number = TaskContext.get().partitionId() << 40
        full, held = [], 0
        for part in parts:
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                whole = ids.of(text or "") + end
                doc, n = (doc_id, whole), len(whole) // 4
                cut = n - n % capacity
                full += [[(doc, start, capacity)] for start in range(0, cut, capacity)]
                if cut < n:
                    pool.add(n - cut, (doc, cut))
                held += n
                if held >= CHUNK_IDS:
                    for windows in (iter(full), pool.fill(last=False)):
                        for batch, number in _batches(windows, number):  # noqa: B020
                            yield batch
                    full, held = [], 0
        for windows in (iter(full), pool.fill(last=True)):
            for batch, number in _batches(windows, number):  # noqa: B020
                yield batch

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, _SCHEMA)


@query("op11_pack_windows")
def op11_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents; the checksum of each piece is taken from the ids that the operator laid there."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
