"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if counts[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def removed(rows, width=20):
    """Flags per row, for rows (doc_id, text) with null ids first."""
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        w = words(rows[i][1])
        for s in range(len(w) - width + 1):
            key = (rows[i][0] is not None, rows[i][0] or 0, s)
            run = tuple(w[s : s + width])
            first[run] = min(first.get(run, key), key)
    for doc, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (doc is not None, doc or 0, s):
                gone[s : s + width] = [True] * width
        out.append((w, gone))
    return out


def simhash(text):
    import xxhash

    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(items, linked):
    """Least name of each item's component; items are (name, value)."""
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for k in range(i):
            if linked(items[i][1], items[k][1]):
                a, b = root(i), root(k)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (name, _) in enumerate(items):
        if name is not None:
            least[root(i)] = min(least.get(root(i), name), name)
    return [least.get(root(i)) for i in range(len(items))]
