"""Byte-level BPE by a monoid tree: halves are encoded alone and joined at their common edge.

A text longer than ``leaf_chars`` is halved recursively. Joining re-encodes a window around the cut
whose two ends grow outwards (doubling) until each stands at a place where a pre-token begins
whatever surrounds it; ids outside the window then cannot change.

Why such a place is safe under the public pattern: take a blank followed by a character that is not
white space. No alternative holds a blank behind a non-blank, so a match that started earlier either
ends before the blank or is a white-space run; ``\\s+(?!\\S)`` gives back exactly the run's last
character, the blank, because what follows it is not white space. So a match always begins at that
blank, with any text to its left, and the pattern never looks further left. The two ends of the text
are safe too, so the window stops growing at the latest there.

Decoding halves the ids in the same way and concatenates bytes up the tree; it is exact for any ids.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded each; an empty
table gives no rows; only the id and text columns are read. Memory is bounded by one Arrow batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import narrowed

LEAF_CHARS = 8192


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=4)
def load(path: str, pattern: str | None = None):
    """The tiktoken encoding of a rank file; kept for the life of a worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space that the pattern matches (the library's, not Python's), in runs that may overflow the stack of its regex.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


def leaf_encoder(enc) -> Callable[[str], list]:
    """``enc.encode_ordinary`` for texts with blanks of any length.

    A run of white space is one match but for its last character, or all of it at the end of the text; so
    very long ones go to the merges directly.
    """

    def encode_leaf(text: str) -> list:
        if len(text) < 50000:
            return enc.encode_ordinary(text)
        out, at = [], 0
        for m in LONG_BLANK.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += enc.encode_ordinary(text[at : m.start()]) + enc._encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + enc.encode_ordinary(text[at:])

    return encode_leaf


def _left_edge(text: str, lo: int, mid: int) -> int:
    """The last safe place before mid, or lo."""
    width = 64
    while True:
        start = max(lo, mid - width)
        at = mid - 1
        while (at := text.rfind(" ", start, at)) > lo:
            if not text[at + 1].isspace():
                return at
        if start == lo:
            return lo
        width *= 2


def _right_edge(text: str, mid: int, hi: int) -> int:
    """The first safe place after mid, or hi."""
    at = mid
    while 0 <= (at := text.find(" ", at + 1, hi - 1)):
        if not text[at + 1].isspace():
            return at
    return hi


def encode(text: str, encode_leaf: Callable[[str], list], leaf_chars: int = LEAF_CHARS) -> list:
    """Ids of the whole text, equal to ``encode_leaf(text)``."""

    def tree(lo: int, hi: int) -> list:
        if hi - lo <= leaf_chars:
            return encode_leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return join(lo, mid, hi, tree(lo, mid), tree(mid, hi))

    def join(lo: int, mid: int, hi: int, left: list, right: list) -> list:
        a, b = _left_edge(text, lo, mid), _right_edge(text, mid, hi)
        drop_left, drop_right = len(encode_leaf(text[a:mid])), len(encode_leaf(text[mid:b]))
        return left[: len(left) - drop_left] + encode_leaf(text[a:b]) + right[drop_right:]

    return tree(0, len(text))


def decode(ids: list, decode_leaf: Callable[[list], bytes], leaf_ids: int = LEAF_CHARS) -> bytes:
    """Bytes of the ids: halves are decoded alone and concatenated up the tree."""
    if len(ids) <= leaf_ids:
        return decode_leaf(ids)
    mid = len(ids) // 2
    return decode(ids[:mid], decode_leaf, leaf_ids) + decode(ids[mid:], decode_leaf, leaf_ids)


def map_tokens(
    docs: DataFrame, finish: Callable[[list, bytes], tuple], schema: str, path: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """id and the columns of ``schema`` that ``finish(ids, decoded bytes)`` gives for each document."""
    path = path or default_path()
    src = narrowed(docs, id_col, text_col)
    out = T.StructType([src.schema[id_col], *T._parse_datatype_string(schema).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path)
        encode_leaf = leaf_encoder(enc)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = encode(text.as_py() or "", encode_leaf, leaf_chars)
                rows.append(finish(ids, decode(ids, enc.decode_bytes)))
            columns = zip(*rows) if rows else [[] for _ in arrow.names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *[pa.array(list(c), f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    return src.mapInArrow(run, out)


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """id, ``ids`` and the text decoded from them again."""
    return map_tokens(docs, lambda ids, raw: (ids, raw.decode("utf-8", "replace")), "ids array<int>, decoded string", path, id_col, text_col, leaf_chars)


@lru_cache(maxsize=1)
def _decimals() -> list:
    return [str(i) for i in range(1 << 18)]


def digests(ids: list, raw: bytes) -> tuple:
    text = ",".join(map(_decimals().__getitem__, ids))
    return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return map_tokens(docs, digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
