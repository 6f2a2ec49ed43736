"""Plain-Python answers to the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def suffix(docs, window=50):
    """op3: {(doc_id, n_bytes, n_removed, n_spans, kept)}"""
    docs = [(d, (t or "").encode()) for d, t in docs]
    low = {}
    rank = lambda d: -1 << 70 if d is None else d
    for d, b in docs:
        for i in range(len(b) - window + 1):
            k = b[i : i + window]
            low[k] = min(low.get(k, rank(d)), rank(d))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if low[b[i : i + window]] < rank(d):
                gone[i : i + window] = b"\1" * window
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def substring(docs, window=35):
    """op6"""
    docs = [(d, WORD.findall(t or "")) for d, t in docs]
    count = defaultdict(int)
    for _, w in docs:
        for i in range(len(w) - window + 1):
            count[tuple(w[i : i + window])] += 1
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def shingles(text, width=2):
    t = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = WORD.findall(t)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near(docs, width=2, percent=80):
    """op5: (doc_id, n_shingles, component_id, kept)"""
    sets = [(d, shingles(t, width)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, (d, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                if j < k:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                up[max(a, b)] = min(a, b)
    return [(d, len(s), find(d), find(d) == d) for d, s in sets]


def store(docs, tokenizer):
    """op9"""
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def leaks(docs, items, percent=80, k=5):
    """op1: {(doc_id, item_id)}"""
    from collections import Counter

    clean = lambda t: WORD.findall(re.sub(r"[^\w\s]|_", "", (t or "").lower()))
    bag = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = set()
    items = [(i, clean(t)) for i, t in items]
    for d, t in docs:
        w = clean(t)
        known = bag(w, k)
        for i, v in items:
            if not v or len(w) < len(v):
                continue
            n = min(k, len(v))
            want = bag(v, n)
            if n == k and not (known.keys() & want.keys()):
                continue
            for s in range(len(w) - len(v) + 1):
                own = bag(w[s : s + len(v)], n)
                shared = sum((own & want).values())
                if 100 * shared >= percent * sum((own | want).values()):
                    out.add((d, i))
                    break
    return out
