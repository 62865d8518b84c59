"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(rows, window=35):
    """rows: (doc_id, text). -> sorted (doc_id, n_words, n_removed, sha256)"""
    docs = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[s : s + window]) for _, w in docs for s in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def shingle_set(text, k=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, percent=75):
    """rows: (doc_id, text), ids unique. -> sorted (doc_id, n_shingles, component_id, kept)"""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets:
        for g in s:
            where.setdefault(g, []).append(i)
    by = dict(sets)
    pairs = Counter()
    for ids in where.values():
        for x in range(len(ids)):
            for y in range(x):
                pairs[ids[x], ids[y]] += 1
    for (x, y), n in pairs.items():
        if 100 * n >= percent * (len(by[x]) + len(by[y]) - n):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)
