"""Quality rules by line labelling: Viterbi decoding of a linear-chain conditional random field.

Each line with a word is content or boilerplate. The field has one weight per line feature and label and one per pair
of neighbouring labels; it is trained by maximum likelihood (forward-backward, full-batch gradient steps) on the lines
of labelled documents: the lines of a good document count as content, those of a bad one as boilerplate. That labelling
is coarse, and what both kinds share comes out as content, as good documents are far more. A document is kept when at
least half of its words lie in content lines.

Training reads at most ``TRAIN_DOCS`` labelled documents, taken by the hash of their id, and of each at most ``TRAIN_LINES``
lines: a longer one gives a window of lines in a row, whose place the hash of its id chooses;
decoding reads every line of every text, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from govspark.llm.common import table
from govspark.llm.registry import query
from govspark.llm.textstats import LINE_FEATURES, base_counts, line_features

#: The pairs' penalty is the larger one: marks of whole documents say nothing about where labels change.
#: Bounds of the training sample; the driver holds no more than TRAIN_DOCS * TRAIN_LINES rows of 13 numbers.
TRAIN_DOCS, TRAIN_LINES = 2000, 100
STEPS, RATE, RIDGE, MOVE_RIDGE = 150, 0.5, 1e-3, 0.05
CONTENT_SHARE = 0.5
CONTENT, BOILERPLATE = 1, 0


def line_rows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (with a leading 1) and word counts of the lines that have a word (``str.split`` words)."""
    seen, rows, sizes = set(), [], []
    for line in text.split("\n"):
        words = line.split()
        if words:
            rows.append((1.0, *line_features(line, words, line in seen)))
            sizes.append(len(words))
            seen.add(line)
    return np.array(rows, np.float64).reshape(-1, 1 + len(LINE_FEATURES)), np.array(sizes, np.int64)


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label of each line; ties go to content."""
    n = len(emit)
    if not n:
        return np.zeros(0, np.int64)
    from_0 = np.zeros((n, 2), np.bool_)
    a, b = emit[0]
    (m00, m01), (m10, m11) = move
    for i, (e0, e1) in enumerate(emit.tolist()[1:], 1):
        stay0, stay1 = a + m00 > b + m10, a + m01 > b + m11
        from_0[i] = stay0, stay1
        a, b = (a + m00 if stay0 else b + m10) + e0, (a + m01 if stay1 else b + m11) + e1
    labels = np.empty(n, np.int64)
    labels[-1] = now = BOILERPLATE if a > b else CONTENT
    for i in range(n - 1, 0, -1):
        labels[i - 1] = now = 0 if from_0[i, now] else 1
    return labels


def train_field(sequences: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights per feature and label, and per pair of labels. Without both labels the field calls all lines content."""
    width = 1 + len(LINE_FEATURES)
    weights, move = np.zeros((width, 2)), np.zeros((2, 2))
    if len({*labels}) < 2:
        weights[0, CONTENT] = 1.0
        return weights, move
    longest = max(map(len, sequences))
    x = np.zeros((len(sequences), longest, width))
    there = np.zeros((len(sequences), longest), np.bool_)
    for i, s in enumerate(sequences):
        x[i, : len(s)], there[i, : len(s)] = s, True
    y = np.array(labels)
    # Both labels weigh alike, whatever their numbers of lines.
    lines = there.sum(1)
    share = np.where(y == 1, 0.5 / max(1, lines[y == 1].sum()), 0.5 / max(1, lines[y == 0].sum()))
    truth = np.zeros((len(y), longest, 2))
    truth[np.arange(len(y)), :, y] = 1
    mass = share[:, None] * there
    pairs = mass[:, 1:].sum(1)
    observed = np.einsum("ntf,ntk,nt->fk", x, truth, mass)
    seen_pairs = np.zeros((2, 2))
    for k in (0, 1):
        seen_pairs[k, k] = pairs[y == k].sum()
    scale = 1 / (np.einsum("ntf,nt->f", x * x, mass) + 1e-2)
    for _ in range(STEPS):
        emit = np.where(there[..., None], x @ weights, 0.0)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1]) + emit[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = emit[:, t + 1] + backward[:, t + 1]
            step = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
            backward[:, t] = np.where(there[:, t + 1, None], step, 0.0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])[:, None, None]
        single = np.exp(forward + backward - total)
        expected = np.einsum("ntf,ntk,nt->fk", x, single, mass)
        joint = forward[:, :-1, :, None] + move + (emit + backward)[:, 1:, None, :] - total[..., None]
        wanted = np.einsum("ntjk,nt->jk", np.exp(np.minimum(joint, 0)), mass[:, 1:])
        weights += RATE * scale[:, None] * (observed - expected - RIDGE * weights)
        move += RATE * (seen_pairs - wanted - MOVE_RIDGE * move)
    return weights, move


def training_window(doc_id: int, x: np.ndarray) -> np.ndarray:
    """TRAIN_LINES lines in a row of a longer document, else all."""
    start = xxhash.xxh64_intdigest(str(doc_id)) % max(1, len(x) - TRAIN_LINES + 1)
    return x[start : start + TRAIN_LINES]


def labelled_lines(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], list[int]]:
    """The bounded training sample: half good and half bad documents as far as there are, by the hash of their id."""
    marks = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = None
    for quality in (0, 1):
        some = marks.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS // 2)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most TRAIN_DOCS ids and marks; the texts of the table stay where they are.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())

    def features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [(i, q, line_rows(t)[0]) for i, q, t in zip(*(part[c].to_pylist() for c in ("doc_id", "quality", "text")), strict=True)]
            rows = [(i, q, training_window(i, x)) for i, q, x in rows if len(x)]
            arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].ravel() for r in rows], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "quality", "x"])

    # An id that repeats gives one window, the least, before anything comes to the driver: at most TRAIN_DOCS rows do.
    windows = texts.mapInArrow(features, "doc_id long, quality int, x array<double>")
    rows = windows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    width = 1 + len(LINE_FEATURES)
    return [np.array(r["x"]).reshape(-1, width) for r in rows], [r["quality"] for r in rows]


def judge_lines(docs: DataFrame, weights: np.ndarray, move: np.ndarray, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, base_failed, content_words, n_lines, n_content_lines and kept for every row of ``docs``.

    A null or empty text has no words and fails the base rules. Other columns are left alone; repeated rows are judged
    one by one; an empty table gives no rows.
    """
    wide = weights.tolist(), move.tolist()

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m = np.array(wide[0]), np.array(wide[1])
        for part in parts:
            out = []
            for text in part["text"].to_pylist():
                text = text or ""
                base = base_counts(text)
                x, sizes = line_rows(text)
                label = viterbi(x @ w, m)
                good = int(sizes[label == CONTENT].sum())
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                out.append((*base, failed, good, len(sizes), int(label.sum()), not failed and good >= share * int(sizes.sum())))
            columns = list(zip(*out, strict=True)) or [()] * 10
            kinds = [pa.bool_() if i in (5, 9) else pa.int64() for i in range(10)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], NAMES)

    schema = "doc_id long, " + ", ".join(f"{n} {'boolean' if n in ('base_failed', 'kept') else 'long'}" for n in NAMES[1:])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, schema)


NAMES = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_words", "n_lines",
    "n_content_lines", "kept",
]


@query("op2_line_labels")
def op2_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every document with a field trained on the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    weights, move = train_field(*labelled_lines(docs, table(spark, sf_dir, "labels")))
    return judge_lines(docs, weights, move)
