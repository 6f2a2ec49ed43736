"""Substring dedup by level-wise doubling: 9 words, then 18, then 35.

Windows of nine words are asked for first, and of those only the ones that winnowing picks: every window
of 35 words holds at least one, and equal windows hold the same one. A window of 35 words stays a
candidate while the shorter windows that make it up are repeated; only those are extended: to 18 words
at both of its ends (9 + 9), then to 35 (18 + 18, overlapping in one word). See ``rounds`` for how a
round travels; a chunk remembers its candidates from one to the next.
Fingerprints of 96 bits decide the last level: among 10**13 different windows two agree with a
probability below 0.001, and a false one would also have to repeat at every shorter level.

Defined results: null or blank texts have no words; a text shorter than a window loses nothing; every
occurrence of a repeated window goes, the first included, and a repeated row is an occurrence; a null
doc_id is a document like any other; ids that are no integers are refused; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import U, mix, run_hashes, word_hashes, word_spans
from .rounds import FAN, Chunk, Rounds, expand, occurs_elsewhere, pair_occurs_elsewhere, spread, winnow

WINDOW = 35


def _levels(window: int) -> tuple[int, int, int]:
    half = (window + 1) // 2
    return window, half, (half + 1) // 2


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, which of them occur twice, where each input stands."""
    keys, place, counts = np.unique(h, return_inverse=True, return_counts=True)
    return keys, counts > 1, place


def _words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(chunk.raw, chunk.offsets)
    return word_hashes(chunk.raw, starts, ends), first


def _first_round(chunk: Chunk, told: list, window: int) -> tuple:
    """Picked windows of a quarter. A short fingerprint does: it only has to rule windows out."""
    _, _, quarter = _levels(window)
    h, first = _words(chunk)
    hashes = run_hashes(h, quarter)
    anchor, low, high = winnow(hashes, first, window, quarter)
    keys, many, place = _distinct(hashes[anchor] >> U(24) << U(24))
    return [keys, many], [low, high - low, place]


def _ends(alive: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where halves start that are in question, and the places of each window's two among them."""
    shift = window - _levels(window)[1]
    at = np.unique(np.r_[alive, alive + shift])
    return at, np.searchsorted(at, alive), np.searchsorted(at, alive + shift)


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive places."""
    heads = np.flatnonzero(np.r_[True, np.diff(places) != 1])[: len(places)]
    return places[heads], places[np.r_[heads[1:], len(places)] - 1][: len(heads)] if len(places) else places


def _second_round(chunk: Chunk, told: list, window: int) -> tuple:
    """Halves at both ends of the windows left."""
    _, half, _ = _levels(window)
    (known,), (low, span, place) = told[0]
    ok = known[place]
    alive = expand(low[ok].astype(np.int64), low[ok].astype(np.int64) + span[ok]) if ok.any() else np.zeros(0, np.int64)
    h, _ = _words(chunk)
    keys, many, place = _distinct(run_hashes(h, half)[_ends(alive, window)[0]])
    first, last = _runs(alive)
    return [keys, many], [first, last - first, place]


def _third_round(chunk: Chunk, told: list, window: int) -> tuple:
    """Whole windows whose halves both repeat."""
    _, half, _ = _levels(window)
    (known,), (first, span, place) = told[1]
    alive = expand(first.astype(np.int64), first.astype(np.int64) + span) if len(first) else np.zeros(0, np.int64)
    _, left, right = _ends(alive, window)
    ok = known[place]
    alive = alive[ok[left] & ok[right]]
    h, _ = _words(chunk)
    halves, whole = run_hashes(h, half), run_hashes(h, window)[alive]
    # A second hash of the window from hashes of its halves, under multipliers of its own.
    second = (mix(halves[alive] * U(0xD6E8FEB86659FD93) + mix(halves[alive + window - half] * U(0xA0761D6478BD642F))) >> U(32)).astype("<u4")
    order = np.lexsort((second, whole))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order][1:] != whole[order][:-1]) | (second[order][1:] != second[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    many = np.bincount(place, minlength=int(new.sum())) > 1
    return [whole[order][new], second[order][new], many], [alive, place]


def substring_dedup(docs: DataFrame, finish: Callable[[list, np.ndarray], tuple] | None = None, schema: str = "n_words long, n_removed long, text string", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id and what ``finish(words, removed mask)`` gives: by default the counts and the text that is left."""
    finish = finish or (lambda words, gone: (len(words), int(gone.sum()), b" ".join(compress(words, ~gone)).decode()))
    rounds = Rounds(docs, id_col, text_col, fan)
    rounds.ask(lambda c, t: _first_round(c, t, window), occurs_elsewhere, ["up", "bits"], ["bits"], ["<i4", "<i4", "<i4"])
    rounds.ask(lambda c, t: _second_round(c, t, window), occurs_elsewhere, ["up", "bits"], ["bits"], ["<i4", "<i4", "<i4"])
    rounds.ask(lambda c, t: _third_round(c, t, window), pair_occurs_elsewhere, ["up", "<u4", "bits"], ["bits"], ["<i4", "<i4"], forget=True)

    def last(chunk: Chunk, told: list) -> pa.Table:
        (known,), (alive, place) = told[2]
        starts, _, first = word_spans(chunk.raw, chunk.offsets)
        lost = alive[known[place]].astype(np.int64)
        gone = spread(len(starts), lost, lost + window)
        rows, body, at, first = [], chunk.raw.tobytes(), chunk.offsets.tolist(), first.tolist()
        for i, name in enumerate(chunk.names()):
            rows.append((name, *finish(body[at[i] : at[i + 1]].split(), gone[first[i] : first[i + 1]])))
        return pa.table({name: list(c) for name, c in zip(out.names, zip(*rows), strict=True)}, schema=out)

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"doc_id long, {schema}"
    out = to_arrow_schema(T._parse_datatype_string(full))
    return rounds.finish(last, full)


def op6(spark, sf_dir: str) -> DataFrame:
    def digest(words: list, gone: np.ndarray) -> tuple:
        kept = words if not gone.any() else list(compress(words, ~gone))
        return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()

    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest, "n_words long, n_removed long, kept_sha256 string")
