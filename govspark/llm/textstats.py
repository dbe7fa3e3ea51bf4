"""Word and line statistics of a text, shared by the line model and the document model."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WHITE = re.compile(r"[\x20\x09-\x0D]")


def repeated_words(words: list, width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text has twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in zip(*(words[i:] for i in range(width)), strict=False)), np.int64, n)
    if len(seen) == n:
        return 0
    twice = np.bincount(ids, minlength=len(seen))[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[width : width + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, doubles = set(), 0
    for line in text.split("\n"):
        if line in seen:
            doubles += 1
        elif line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    return len(words), len(_WHITE.sub("", text)), len(_SYMBOLS.findall(text)), doubles, repeated_words(words)


LINE_FEATURES = (
    "log_words", "mean_word", "distinct", "top_share", "symbols", "bangs", "bars", "upper", "digits", "capital", "stop", "doubled",
)


def line_features(line: str, words: list[str], doubled: bool) -> tuple[float, ...]:
    """Numbers between 0 and about 1 that tell prose from lists, shouting, stuffing and marks."""
    n, chars = len(words), sum(map(len, words))
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = max(1, chars)
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return (
        min(1.0, np.log1p(n) / 6),
        min(1.0, chars / n / 12),
        len(counts) / n,
        max(max(counts.values()) / n if n > 3 else 0.0, pairs),
        min(1.0, 4 * len(_SYMBOLS.findall(line)) / letters),
        min(1.0, 4 * line.count("!") / letters),
        min(1.0, 4 * line.count("|") / n),
        sum(c.isupper() for c in line) / letters,
        sum(c.isdigit() for c in line) / letters,
        float(words[0][0].isupper()),
        float(words[-1][-1] in ".?!…"),
        float(doubled),
    )


DOC_FEATURES = (
    "log_words", "mean_word", "distinct", "top_share", "same_next", "symbols", "bangs", "bars", "upper", "digits", "marks",
    "log_lines", "mean_line", "doubled_lines", "stops", "long_words",
)


def document_features(text: str) -> tuple[float, ...]:
    """The document model's inputs; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(DOC_FEATURES)
    chars = sum(map(len, words))
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    return (
        float(np.log1p(n)),
        chars / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(_SYMBOLS.findall(text)) / chars,
        text.count("!") / chars,
        text.count("|") / n,
        sum(w.isupper() for w in words) / n,
        len(_DIGITS.findall(text)) / chars,
        (text.count(".") + text.count(",")) / n,
        float(np.log1p(len(lines))),
        float(np.log1p(n / len(lines))),
        1.0 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1] in ".?!…" for x in lines) / len(lines),
        sum(len(w) > 14 for w in words) / n,
    )


_DIGITS = re.compile(r"[0-9]")


def batches(column) -> chain:
    """The texts of Arrow batches, null as empty."""
    return (x or "" for x in column.to_pylist())
