"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def repeats(rows, length=50):
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, 1 << 62), 1 << 61 if d is None else d)
    out = []
    for d, t in rows:
        b, last, gone = (t or "").encode(), -1, []
        for i in range(len(b)):
            if i + length <= len(b) and first[b[i : i + length]] < (1 << 61 if d is None else d):
                last = i + length
            gone.append(i < last)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows]
    u, held = Union({d for d, _ in sets if d is not None}), {}
    for i, (d, s) in enumerate(sets):
        for g in s if d is not None else ():
            held.setdefault(g, []).append(i)
    for i, (d, s) in enumerate(sets):
        for j, k in Counter(j for g in s if d is not None for j in held[g] if j < i).items():
            if den * k >= num * (len(s) + len(sets[j][1]) - k):
                u.join(d, sets[j][0])
    return [(d, len(s), None if d is None else u.find(d)) for d, s in sets]


def one_of_each(rows):
    """A row of each class, that with the smallest id and of such rows the least text; rows without an id stay."""
    out, best = [], {}
    for (d, t), (_, _, c) in zip(rows, classes(rows, 5, 80, 100), strict=True):
        if d is None:
            out.append((d, t))
        elif d == c and (d not in best or (t is None, t or "") < (best[d] is None, best[d] or "")):
            best[d] = t
    return out + list(best.items())


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        k = int(c) * (2 if i % 2 else 1)
        total += k - 9 if k > 9 else k
    return total % 10 == 0


def private(text):
    def good(kind, v):
        digits = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": kind == "card" and 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def edit_distance_within(p, t):
    """Least edits between p and any part of t."""
    col = list(range(len(p) + 1))
    best = col[-1]
    for c in t:
        before = col[0]
        for i in range(1, len(p) + 1):
            col[i], before = min(before + (p[i - 1] != c), col[i] + 1, col[i - 1] + 1), col[i]
        best = min(best, col[-1])
    return best


def best_fit(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(room, k) for k, (room, held) in enumerate(bins) if room >= size and room > 0 and (source < 0 or sum(s == source for s, _ in held) < per_source) and (cluster < 0 or all(c != cluster for _, c in held))]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([capacity, []])
        bins[k][0] -= size
        bins[k][1].append((source, cluster))
        out.append(k)
    return out
