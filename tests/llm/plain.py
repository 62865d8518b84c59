"""Plain versions of the operators on vectors and conversations."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]")
ROLE = {"u": "user", "a": "assistant"}
MAY = {"": "su", "s": "u", "u": "a", "a": "u"}


def integers(v):
    """Components as integers, or None for a vector that takes no part; zeros at the end do not matter."""
    if v is None or any(c is None or not np.isfinite(c) for c in v):
        return None
    return [max(-(1 << 26), min(1 << 26, int(np.floor(1024 * float(np.float32(c)))))) for c in v]


def codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, label, embedding)."""
    kept = [(i, label, x) for i, label, v in rows if (x := integers(v)) is not None]
    if not kept:
        return []
    width = max(1, -(-max(len(x) for _, _, x in kept) // parts)) * parts
    kept = sorted(((i, label, x + [0] * (width - len(x)), x) for i, label, x in kept), key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    x = np.array([r[2] for r in kept], dtype=np.int64).reshape(len(kept), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = np.stack([((x[:, p, None] - book[p][None]) ** 2).sum(-1) for p in range(parts)], axis=1)
        return d.argmin(-1), d.min(-1).sum(-1)

    for _ in range(rounds):
        own, _ = assign()
        for p in range(parts):
            for e in set(own[:, p]):
                book[p, e] = x[own[:, p] == e, p].sum(0) // (own[:, p] == e).sum()
    own, error = assign()
    total = defaultdict(int)
    for r, e in zip(kept, error):
        total[r[1]] += int(e)
    digest = hashlib.sha256(",".join(map(str, book.reshape(-1))).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in o), int(e), total[r[1]], digest) for r, o, e in zip(kept, own, error)), key=repr)


def repairs(rows):
    """rows: (conv_id, turn, role, text). Every state's best rest as a whole string, from the end."""
    found, out = {r[0] for r in rows}, {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        by[conv] += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)

    def order(r):
        return r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}\0{r[1]}\0{r[2]}".encode()).hexdigest()[:40]

    def inserted(best):
        for _ in range(4):
            for s, may in MAY.items():
                for c in set(may) & set(ROLE):
                    if c in best:
                        way = (best[c][0] + 2, "I" + best[c][1], (ROLE[c] + ":", *best[c][2]))
                        best[s] = min(best.get(s, way), way)
        return best

    for conv in found:
        turns, seen, faults = sorted(by[conv], key=order), set(), []
        for _, role, text in turns:
            w = WORD.findall(text)
            faults.append("blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else "")
            seen.add((role, text))
        best = inserted({"": (0, "", ()), "a": (0, "", ())})
        for (_, role, text), fault in zip(reversed(turns), reversed(faults)):
            now, more = {}, fault == "truncated"
            for s, may in MAY.items():
                ways = [(best[s][0] + 3, "D" + best[s][1], best[s][2])] if s in best else []
                for c in set(may) & set(best) if fault not in ("blank", "duplicate") else ():
                    if role[:1] == c:
                        ways.append((best[c][0] + more, "K" + best[c][1], (f"{role}:{text}", *best[c][2])))
                    if c in ROLE:
                        ways.append((best[c][0] + 2 + more, "R" + best[c][1], (f"{ROLE[c]}:{text}", *best[c][2])))
                if ways:
                    now[s] = min(ways)
            best = inserted(now)
        cost, audit, lines = best[""]
        some = [t for t, _, _ in turns if t is not None]
        gaps = max(some) - min(some) + 1 - len(set(some)) if some else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def search(rows, k=10, every=100):
    """rows: (vec_id, embedding)."""
    points = {(i, tuple(np.trim_zeros(x, "b"))) for i, v in rows if (x := integers(v)) is not None}
    out = []
    for i, x in points:
        if i is None or i % every:
            continue
        rest = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), j is None, j or 0) for j, y in points if (j, y) != (i, x))
        out += [(i, n + 1, None if null else j, -s) for n, (s, null, j) in enumerate(rest[:k])]
    return sorted(out, key=repr)
