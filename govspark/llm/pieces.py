"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At each position of the text the automaton's state and its output links name every piece that ends there; each relaxes
the best score at that position by the one at its start. Characters that no piece covers fall back to byte pieces. Ties
go to fewer pieces, then to the longer last piece. A space becomes U+2581, and one is put before the text; U+2581 itself is
written as its bytes, so decoding always gives the text back.

No piece of such a vocabulary goes on past the end of a word (U+2581 stands at its head only, or forms a run), and none
holds a Latin letter next to a mark such as a comma; both are checked when a model is loaded. The best encoding is
therefore the encodings of the words, cut between letters and marks, one after another, and a worker keeps those it has
met, up to ``KEPT_WORDS`` of them. A model without the second property is run word by word, one without the first over whole texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import table
from govspark.llm.registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 64
_NEVER = float("-inf")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
#: A score so low that bytes are used only where no piece fits, as in the model's own byte pieces.
BYTE_SCORE = -1_000_000_000


class Pieces:
    """Encoder and decoder for the pieces of a model file."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool]):
        """``plain`` tells ordinary pieces from control, unknown and byte ones."""
        self.text, self.bytes = {}, [0] * 256
        self.of_byte: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score, ordinary) in enumerate(zip(pieces, scores, plain, strict=True)):
            if ordinary and piece:
                self.text[i] = piece
                self.automaton.add_word(piece, (len(piece), float(score), i))
            elif m := _BYTE.match(piece):
                self.bytes[int(m[1], 16)] = i
                self.of_byte[i] = int(m[1], 16)
        if self.text:
            self.automaton.make_automaton()
        self.by_word = all(SPACE not in p.lstrip(SPACE) for p in self.text.values())
        self.by_unit = self.by_word and not any(_CROSSING(p) for p in self.text.values())
        plain_bytes = lambda i: self.text[i].replace(SPACE, " ").encode("utf-8", "surrogatepass") if i in self.text else b""
        self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else plain_bytes(i) for i in range(len(pieces))]
        self._kept, self.unlike = _Kept(self._find), False

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        plain = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in ids]
        return cls([m.id_to_piece(i) for i in ids], [m.get_score(i) for i in ids], plain)

    def best(self, text: str) -> tuple[int, ...]:
        """Viterbi over one stretch, in which U+2581 stands for a space."""
        n = len(text)
        score, count, start, last = [_NEVER] * (n + 1), [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0

        def by_bytes(to: int) -> None:
            """A position is final once the next is reached; bytes may still be the best way to it."""
            width = len(text[to - 1].encode("utf-8", "surrogatepass"))
            new, pieces = score[to - 1] + BYTE_SCORE * width, count[to - 1] + width
            if new > score[to] or (new == score[to] and pieces < count[to]):
                score[to], count[to], start[to], last[to] = new, pieces, to - 1, -1

        done = 0
        for end, (size, value, i) in self.automaton.iter(text) if self.text else ():
            while done < end:
                done += 1
                if score[done] <= score[done - 1] + BYTE_SCORE:
                    by_bytes(done)
            to = end + 1
            at = to - size
            new = score[at] + value
            if new >= score[to]:
                pieces = count[at] + 1
                if new > score[to] or pieces < count[to] or (pieces == count[to] and at < start[to]):
                    score[to], count[to], start[to], last[to] = new, pieces, at, i
        while done < n:
            done += 1
            if score[done] <= score[done - 1] + BYTE_SCORE:
                by_bytes(done)
        out, at = [], n
        while at:
            if last[at] < 0:
                out.extend(self.bytes[b] for b in reversed(text[start[at] : at].encode("utf-8", "surrogatepass")))
            else:
                out.append(last[at])
            at = start[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def packed(self, text: str) -> bytes:
        """The ids of a text, four little-endian bytes each."""
        if not text:
            return b""
        if SPACE in text:
            mark = self._pack([self.bytes[b] for b in SPACE.encode()])
            return mark.join(self._stretch(part.replace(" ", SPACE)) for part in (" " + text).split(SPACE))
        return self._stretch((" " + text).replace(" ", SPACE))

    def gives_back(self, text: str, packed: bytes) -> bool:
        """Whether decoding gives the text. Each unit is decoded when it is met first, and bytes of a text are those of its
        units, so only where a unit came back changed, or text holds U+2581 itself, is the whole text decoded."""
        if self.by_word and not self.unlike and SPACE not in text:
            return True
        return self.decode(np.frombuffer(packed, "<i4").tolist()) == text

    @staticmethod
    def _pack(ids) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def _raw(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def _stretch(self, text: str) -> bytes:
        if not self.by_word:
            return self._pack(self.best(text))
        return b"".join(map(self._kept.__getitem__, (_UNITS if self.by_unit else _WORDS)(text)))

    def _find(self, word: str) -> bytes:
        ids = self.best(word)
        if self._raw(ids) != word.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
            self.unlike = True
        return self._pack(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; control and unknown pieces are empty."""
        text = self._raw(ids).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


class _Kept(dict):
    """What was found for the words met so far, forgotten when there are too many."""

    def __init__(self, find):
        super().__init__()
        self._find = find

    def __missing__(self, word: str) -> bytes:
        found = self._find(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?"
_CROSSING = re.compile(f"[{_LETTER}][{_MARK}]|[{_MARK}][{_LETTER}]").search
_UNITS = re.compile(f"{SPACE}*[{_LETTER}]+(?=[{_MARK}])|[{_MARK}]+(?=[{_LETTER}{SPACE}]|\\Z)|{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The model of this worker, read once."""
    if path not in _LOADED:
        _LOADED[path] = Pieces.load(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip for every row of ``docs`` (doc_id, text; other columns are left alone).

    ``round_trip`` tells whether decoding gave the text back. Null and empty texts have no pieces. Repeated rows stay; an
    empty table gives no rows. The model file must be at the same path on every executor.
    """

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for whole in parts:
            for at in range(0, whole.num_rows, 64):  # so that long texts don't pile up
                part = whole.slice(at, 64)
                texts = [t or "" for t in part["text"].to_pylist()]
                rows = [pieces.packed(t) for t in texts]
                same = [pieces.gives_back(t, ids) for t, ids in zip(texts, rows, strict=True)]
                flat = pa.array(np.frombuffer(b"".join(rows), "<i4"))
                sizes = np.array([len(ids) // 4 for ids in rows], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                arrays = [part["doc_id"], pa.array(sizes), pa.ListArray.from_arrays(offsets, flat), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with ``ids``; null ids give an empty text."""

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for part in parts:
            texts = [pieces.decode(ids or []) for ids in part["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decode, "doc_id long, text string")


@query("op7_piece_ids")
def op7_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text and decodes it again."""
    return encode_pieces(table(spark, sf_dir, "documents"))
