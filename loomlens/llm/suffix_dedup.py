"""Suffix-array dedup of byte strings by threshold-bounded interval expansion.

A byte goes if a string of ``window`` bytes over it also starts in a document with a smaller doc_id.

1. Winnowing picks 20-byte anchors: every window holds one, equal windows the same one. Anchors that
   occur in one document alone rule their windows out (one round of ``rounds``).
2. The windows of one anchor span a context of at most 80 bytes. Contexts are asked for whole: does a
   smaller document hold the very same one? Where it does, all windows are settled at once; so are anchors
   with one context.
3. What is left lies around the edges of repeated passages. There a chunk orders the suffixes of its
   contexts that begin in an anchor (an interval each, of the value 20) and extends all intervals breadth
   first, by one symbol and one value at a time, to either side: backwards a step is the LF mapping of a
   Burrows-Wheeler transform, a stable sort by the symbol before; forwards it is that of the reversed
   texts. Intervals of one suffix are given up. Where the values of both sides make up ``window``, the
   intervals are the classes of equal windows; longer common prefixes are never derived.
4. The classes are what the last round asks about, each once a chunk with its smallest document and a
   fingerprint of one of its windows, and what is removed: the answer to a class is its windows' fate.

Within a chunk bytes are compared; between chunks fingerprints of 128 bits (contexts) and 96 bits
(classes) stand for them, so that a window that a third of all documents hold is one short entry a
chunk. Of 10**13 different ones, two agree with a probability below 0.001. No text leaves its chunk, and
after the second round none is hashed again: positions and classes travel as the chunk's state.
Documents are compared on the input, never on what is left.

Defined results: null and empty texts have no bytes; texts under ``window`` bytes lose nothing; rows of
one doc_id are one document, so that they do not remove each other's bytes; a null doc_id counts as
smaller than any other (and as the same document as -2**63); ids that are no integers are refused; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import U, mix
from .rounds import FAN, Chunk, Rounds, occurs_elsewhere, smaller_elsewhere, spread

WINDOW, ANCHOR = 50, 20
#: Window starts handled at once: their arrays stay in a core's own cache.
STRIDE = 1 << 15
_LOW = U((1 << 17) - 1)
_ODD = mix(np.arange(2001, 2041, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number; shorter by seven."""
    n = len(raw) - 7
    out = np.empty(max(0, n), U)
    for o in range(min(8, max(0, n))):
        part = np.frombuffer(raw[o : o + (len(raw) - o) // 8 * 8].tobytes(), "<u8")
        out[o::8] = part
    return out


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every position as one number; shorter by seven."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", raw.data if len(raw) > 7 else bytes(8), 0, (1,))


def gram_hashes(raw: np.ndarray, size: int, at: np.ndarray | slice | None = None) -> np.ndarray:
    """Hash of ``size`` bytes (16 to 24) at every position or at those given, from three loads of eight."""
    w = words8(raw) if at is None else eights(raw)
    n = len(raw) - size + 1
    load = (lambda k: w[k : k + n]) if at is None else (lambda k: w[at + k])
    h = (load(0) + _ODD[0]) * _ODD[1]
    h ^= h >> U(32)
    h += load(8)
    h *= _ODD[2]
    h ^= h >> U(29)
    h += load(size - 8)
    h *= _ODD[3]
    h ^= h >> U(32)
    h *= _ODD[4]
    h ^= h >> U(29)
    return h


def hashes_at(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``size`` bytes (8 or more) at each of the positions."""
    w, out = eights(raw), (np.empty(len(starts), U), np.empty(len(starts), U))
    steps = [*range(0, size - 8, 8), size - 8]
    for i in range(0, len(starts), STRIDE):
        at = starts[i : i + STRIDE]
        g, h = np.zeros(len(at), U), np.zeros(len(at), U)
        for k, o in enumerate(steps):
            x = w[at + o]
            g = (g ^ (g >> U(31))) * _ODD[5] + (x ^ (x >> U(33))) * _ODD[8 + k]
            h = (h ^ (h >> U(27))) * _ODD[6] + (x ^ (x >> U(35))) * _ODD[20 + k]
        out[0][i : i + STRIDE], out[1][i : i + STRIDE] = mix(g), mix(h)
    return out


def byte_anchors(raw: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its hash, first window, last window) for each maximal run of windows with one anchor.

    A window's anchor is its smallest gram, the leftmost of equal ones, so that equal windows have
    their anchors at equal offsets. Windows lie inside one document.
    """
    n = len(raw) - window + 1
    span = window - anchor + 1
    found = []
    for b in range(0, max(0, n), STRIDE):
        count = min(STRIDE, n - b)
        h = gram_hashes(raw[b : b + count + window - 1], anchor)
        best, step = (h | _LOW) ^ _LOW | np.arange(len(h), dtype=U), 1
        while 2 * step <= span:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        if step < span:
            best = np.minimum(best[: step - span], best[span - step :])
        valid = np.ones(count, bool)
        i, j = np.searchsorted(offsets, [b, b + count + window], side="left")
        for e in offsets[max(1, i) : j].tolist():
            valid[max(0, e - window + 1 - b) : max(0, min(count, e - b))] = False
        starts = np.flatnonzero(valid)
        if not len(starts):
            continue
        chosen = (best[starts] & _LOW).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
        at = chosen[heads]
        found.append((at + b, h[at], starts[heads] + b, starts[np.r_[heads[1:], len(starts)] - 1] + b))
    if not found:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, U), none, none
    at, h, low, high = (np.concatenate(x) for x in zip(*found))
    new = np.r_[True, (at[1:] != at[:-1]) | (low[1:] != high[:-1] + 1)]
    heads = np.flatnonzero(new)
    return at[heads], h[heads], low[heads], high[np.r_[heads[1:], len(at)] - 1]


def extended(order: np.ndarray, interval: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All intervals extended by one symbol: the new order of the suffixes, and each one's interval.

    ``order`` has the members of an interval together. Sorted by symbol, stably, those of one interval and
    symbol are together again; each such run is an interval of the next value.
    """
    seen = symbols[order]
    step = np.argsort(seen, kind="stable")
    order, seen = order[step], seen[step]
    was = interval[order]
    edge = np.ones(len(order), bool)
    edge[1:] = (seen[1:] != seen[:-1]) | (was[1:] != was[:-1])
    run = np.cumsum(edge) - 1
    size = np.bincount(run)
    out = np.full(len(interval), -1, np.int32)
    out[order] = run
    lone = size[run] < 2
    out[order[lone]] = -1
    return order[~lone], out


def window_classes(raw: np.ndarray, print_: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, class) of every window of the contexts; equal classes are equal bytes.

    A context is the windows that start in [low, high] around the ``size`` bytes at ``anchor``. Windows
    alone in their intervals get classes of their own.
    """
    n, room = len(anchor), window - size
    by_print = np.argsort(print_, kind="stable")
    edge = np.ones(n, bool)
    edge[1:] = print_[by_print][1:] != print_[by_print][:-1]
    whole = np.empty(n, np.int32)
    whole[by_print] = np.cumsum(edge)
    lead, tail, ends = anchor - low, anchor - high, high + window
    sides = []
    for backwards in (True, False):
        order, interval, levels = by_print, whole, [whole]
        for k in range(1, room + 1):
            at = anchor - k if backwards else anchor + size + k - 1
            inside = at >= low if backwards else at < ends
            order = order[inside[order]]
            symbols = np.zeros(n, np.uint8)
            symbols[order] = raw[at[order]]
            order, interval = extended(order, interval, symbols)
            levels.append(interval)
        sides.append(levels)
    context, start, kind, free = [], [], [], 0
    for a in range(room + 1):  # bytes of the window before the anchor
        own = np.flatnonzero((a >= tail) & (a <= lead))
        left, right = sides[0][a][own].astype(np.int64), sides[1][room - a][own].astype(np.int64)
        both = np.flatnonzero((left >= 0) & (right >= 0))
        c = np.arange(free, free + len(own))
        if len(both):
            _, head, inverse = np.unique(left[both] << 32 | right[both], return_index=True, return_inverse=True)
            c[both] = c[both[head]][inverse]
        context.append(own), start.append(anchor[own] - a), kind.append(c)
        free += len(own)
    return np.concatenate(context), np.concatenate(start), np.concatenate(kind)


def anchors_of(chunk: Chunk, window: int, size: int) -> tuple[np.ndarray, ...]:
    """(position, hash, first and last window, document) of each anchor, and the short hash for the first round."""
    at, h, low, high = byte_anchors(chunk.raw, chunk.offsets, window, size)
    return at, h, low, high, chunk.ids[np.searchsorted(chunk.offsets, at, side="right") - 1], h >> U(24) << U(24)


def _first_round(chunk: Chunk, told: list, window: int, size: int) -> tuple:
    *_, owner, short = anchors_of(chunk, window, size)
    order = np.lexsort((owner, short))
    s, d = short[order], owner[order]
    new, other = np.ones(len(s), bool), np.zeros(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    other[1:] = ~new[1:] & (d[1:] != d[:-1])
    many = np.zeros(int(new.sum()), bool)
    many[(np.cumsum(new) - 1)[other]] = True
    return [s[new], many], None


def _distinct(keys: np.ndarray, second: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the distinct (key, second) stand in order, where each input stands among them, the smallest document of each."""
    order = np.lexsort((docs, second, keys))
    k, s = keys[order], second[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    at = np.empty(len(k), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at, docs[order][new]


CONTEXT_STATE = ["<i4", "<i4", "u1", "<i4", "bits"]


def _second_round(chunk: Chunk, told: list, window: int, size: int) -> tuple:
    at, h, low, high, owner, short = anchors_of(chunk, window, size)
    ((known,), _), keys = told[0], np.unique(short)
    ok = known[np.searchsorted(keys, short)] if len(keys) else np.zeros(0, bool)
    at, h, low, high, owner = (x[ok] for x in (at, h, low, high, owner))
    # Two windows cover the context: the first and the last.
    (a, _), (b, _) = hashes_at(chunk.raw, low, window), hashes_at(chunk.raw, high, window)
    context = mix(a * _ODD[7] + b + (high - low).astype(U) * _ODD[16] + (at - low).astype(U))
    heads, place, least = _distinct(h, context, owner)
    return [h[heads], context[heads], least], [at, low, high - low, place, owner > least[place]]


CLASS_STATE = ["<i4", "<i4", "<i4", "<i4", "bits"]


def _third_round(chunk: Chunk, told: list, window: int, size: int) -> tuple:
    (one, two), (at, low, span, place, later) = told[1]
    at, low, high = at.astype(np.int64), low.astype(np.int64), low.astype(np.int64) + span
    gone = one[place] | later
    open_ = np.flatnonzero(~gone & two[place])
    c_at, c_low, c_high = at[open_], low[open_], high[open_]
    owner = chunk.ids[np.searchsorted(chunk.offsets, c_at, side="right") - 1]
    if not len(open_):
        none = np.zeros(0, np.int64)
        return [np.zeros(0, U), np.zeros(0, "<u4"), none], [low[gone], high[gone], none, none, np.zeros(0, bool)]
    context, start, kind = window_classes(chunk.raw, gram_hashes(chunk.raw, size, c_at), c_at, c_low, c_high, window, size)
    # The smallest document of each class, and one of its windows, stand for it.
    _, head, number = np.unique(kind, return_index=True, return_inverse=True)
    doc = owner[context]
    by_class = np.lexsort((doc, number))
    least = doc[by_class[np.flatnonzero(np.r_[True, number[by_class][1:] != number[by_class][:-1]])]]
    whole, second = hashes_at(chunk.raw, start[head], window)
    order = np.argsort(whole)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [whole[order], (second[order] >> U(32)).astype("<u4"), least[order]], [low[gone], high[gone], start, rank[number], doc > least[number]]


def _removed(chunk: Chunk, told: list, window: int) -> np.ndarray:
    (one, _), (low, high, start, rank, later) = told[2]
    gone = start[one[rank] | later]
    return spread(len(chunk.raw), np.concatenate([low, gone]), np.concatenate([high, gone]) + window)


def suffix_dedup(docs: DataFrame, finish: Callable[[np.ndarray, np.ndarray], tuple] | None = None, schema: str = "n_bytes long, spans array<array<long>>, kept binary", window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id and what ``finish(bytes, removed mask)`` gives: by default the removed spans and the bytes left."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    finish = finish or (lambda raw, gone: (len(raw), runs(gone).tolist(), raw[~gone].tobytes()))
    rounds = Rounds(docs, id_col, text_col, fan)
    rounds.ask(lambda c, t: _first_round(c, t, window, anchor), occurs_elsewhere, ["up", "bits"], ["bits"])
    rounds.ask(lambda c, t: _second_round(c, t, window, anchor), smaller_elsewhere, ["up", "<u8", "<i8"], ["bits", "bits"], CONTEXT_STATE)
    rounds.ask(lambda c, t: _third_round(c, t, window, anchor), smaller_elsewhere, ["up", "<u4", "<i8"], ["bits", "bits"], CLASS_STATE, forget=True)
    full = f"doc_id long, {schema}"
    out = to_arrow_schema(T._parse_datatype_string(full))

    def last(chunk: Chunk, told: list) -> pa.Table:
        gone, rows, at = _removed(chunk, told, window), [], chunk.offsets.tolist()
        for name, a, b in zip(chunk.names(), at[:-1], at[1:], strict=True):
            rows.append((name, *finish(chunk.raw[a:b], gone[a:b])))
        return pa.table({name: list(c) for name, c in zip(out.names, zip(*rows), strict=True)}, schema=out)

    return rounds.finish(last, full)


def runs(gone: np.ndarray) -> np.ndarray:
    """[start, end) of each maximal run of removed bytes."""
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def op3(spark, sf_dir: str) -> DataFrame:
    def digest(raw: np.ndarray, gone: np.ndarray) -> tuple:
        n = int(np.count_nonzero(gone))
        kept = raw[~gone] if n else raw
        return len(raw), n, len(runs(gone)) if n else 0, hashlib.sha256(kept.tobytes()).hexdigest()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs, digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
