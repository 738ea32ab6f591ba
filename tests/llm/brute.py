"""Plain forms of the operators, one document or pair at a time, to hold results against."""

import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def low(text):
    return (text or "").translate(_LOW)


def words(text):
    return WORD.findall(low(text))


def spaced(text):
    return SPACED.findall(low(text))


def fold(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m if doc_id is not None else 0


def shingles(text):
    w = spaced(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs):
    """docs: [(id, text)] to {id: (n, component)}, by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    shared = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def katz(docs, min_count=2, cutoff=5):
    """docs: [(id, text)] to {id: (held, n_tokens, n_known, N, base, score)} and the function P(w | v)."""
    train = [spaced(t) + [None] for d, t in docs if fold(d, 7) != 2]
    uni = Counter(w for x in train for w in x)
    bi = Counter(p for x in train for p in zip(["<s>", *x], x))
    tokens, kinds = sum(uni.values()), len(uni)

    def discounts(counts, least):
        n = Counter(counts.values())
        out = {}
        for r in range(1, cutoff + 1):
            top = (cutoff + 1) * n[cutoff + 1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - top / n[1]) / (1 - top / n[1]) if n[1] > top and n[r] else -1
            out[r] = 0.0 if r < least else d if 0 < d < 1 else r / (r + 1)
        return lambda r: out.get(r, 1.0)

    d1, d2 = discounts(uni, 1), discounts(bi, min_count)
    kept = sum(d1(n) * n for n in uni.values())
    over = tokens if tokens - kept > 1e-6 * tokens else tokens + 1
    unknown = (1 - kept / over) / (kinds + 1)
    p1 = lambda w: d1(uni[w]) * uni[w] / over + unknown if w in uni else unknown
    after = {}
    for (v, w), n in bi.items():
        if n >= min_count:
            after.setdefault(v, {})[w] = n
    size = lambda v: len(train) if v == "<s>" else uni[v]
    state = {}
    for v, ws in after.items():
        k = sum(d2(n) * n for n in ws.values())
        o = size(v) if size(v) - k > 1e-6 * size(v) else size(v) + 1
        state[v] = (o, (1 - k / o) / (1 - sum(p1(w) for w in ws)))

    def p(w, v):
        o, alpha = state.get(v, (1, 1.0))
        n = after.get(v, {}).get(w)
        return d2(n) * n / o if n else alpha * p1(w)

    out = {}
    for d, t in docs:
        x = spaced(t) + [None]
        out[d] = (fold(d, 7) == 2, len(x), sum(w in uni for w in x), tokens, sum(math.log10((uni[w] + 1) / (tokens + kinds + 1)) for w in x), sum(math.log10(p(w, v)) for v, w in zip(["<s>", *x], x)))
    return out, p, uni
