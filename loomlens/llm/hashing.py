"""Vectorised hashing of words, shingles and windows over Arrow text buffers (numpy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_MULT = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


TABLE = mix(np.arange(1, 257, dtype=U) * _MULT)
_ODD = mix(np.arange(1001, 1129, dtype=U) * _MULT) | U(1)
IS_WS = np.zeros(256, bool)
IS_WS[[32, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents whose bytes together stay under ``most`` (one larger document stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each document): maximal non-white-space runs that never cross documents."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    solid = ~IS_WS[raw[lo:hi]]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1] - lo
    edges = edges[(edges > 0) & (edges < len(solid))]
    first[edges] |= solid[edges]
    last[edges - 1] |= solid[edges - 1]
    starts, ends = np.flatnonzero(first) + lo, np.flatnonzero(last) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each word's bytes; words over 48 bytes go through xxhash."""
    size = ends - starts
    h = np.full(len(starts), 0x51ED270B, U)
    at = np.flatnonzero(size > 0)
    for t in range(48):
        if t:
            at = at[size[at] > t]
        if not len(at):
            break
        h[at] = (h[at] ^ TABLE[raw[starts[at] + t]]) * _MULT
    for i in np.flatnonzero(size > 48):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return mix(h + size.astype(U))


def run_hashes(symbols: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive symbols, by doubling; shorter by width - 1 than the input."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    power, step, done, out, k = symbols, 1, 0, None, 0
    while True:
        if width & step:
            part = power[done : done + n]
            out = part.copy() if out is None else out * _ODD[2 * k + 1] + part
            done += step
        if done == width:
            return mix(out)
        # A multiplier of its own for every level: no two symbols of a run weigh the same.
        power = power[:-step] * _ODD[2 * k] + power[step:]
        step, k = 2 * step, k + 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes; a shorter text is one shingle, no words is empty."""
    for i, j in slices(offsets, 4 << 20):
        at = offsets[i : j + 1]
        lo = int(at[0])
        part = raw[lo : int(at[-1])]
        if lower:
            part = LOWERED[part]
        starts, ends, first = word_spans(part, at - lo)
        h = word_hashes(part, starts, ends)
        runs = run_hashes(h, width)
        for k in range(j - i):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                x = np.array([b - a], U)
                for w in h[a:b]:
                    x = mix(x * _MULT + w)
                yield x
            else:
                yield np.zeros(0, U)
