"""Question rounds over chunks of documents: which of my windows occur elsewhere, or in a smaller document?

Documents are gathered, where they lie, into chunks of a few MB, written once to the shared folder as a
table bucketed by chunk number. A round sends, from every chunk, the sorted fingerprints of what is in
question (differences of sorted numbers, compressed) to buckets by fingerprint. A bucket answers each
chunk with some bits for each fingerprint, in the order in which they were sent, so that no fingerprint
travels back and no document travels at all: the bucketed table meets the answers without a shuffle. What
a chunk wants to remember until the next round (its state) travels beside its answers.

A fingerprint leaves a chunk once, however often it occurs in it: a passage that a third of all
documents hold costs one entry a chunk. Buckets split the fingerprint space evenly and their number
follows the counted size of the input, so each fits in memory. Nothing is collected.

Chunks and buckets both grow in number with the input, so their rows would get smaller and smaller. Beyond
``fan`` buckets a round therefore takes two hops: a chunk sends to the square root of the number of
buckets, *gangs* of chunks are regrouped there, and go on to the buckets together; answers come back the
same way. A row then holds as many fingerprints as with a chunk of the size of a gang.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_key, materialize, narrowed, new_path, shuffle_partitions
from .hashing import U, buffers

CHUNK_BYTES = 2 << 20
#: Bytes of text for each bucket of a round, and buckets that one row a chunk each is worth.
BUCKET_BYTES, FAN = 32 << 20, 1024
#: Stands for a null id, which counts as smaller than any other.
NULL_ID = -(1 << 63)
_CODEC = pa.Codec("zstd", compression_level=1)
ROW = "bucket int, gang long, level int, chunks binary, counts binary, parts array<binary>"
_ROW_TYPES = pa.schema([("bucket", pa.int32()), ("gang", pa.int64()), ("level", pa.int32()), ("chunks", pa.binary()), ("counts", pa.binary()), ("parts", pa.list_(pa.binary()))])


def pack(x: np.ndarray, kind: str) -> bytes:
    """An array as bytes after its length: "bits", "up" (ascending numbers as differences), or planes of a type's bytes."""
    n = len(x).to_bytes(8, "little")
    if kind == "bits":
        return n + np.packbits(x).tobytes()
    if kind == "up":
        x, kind = np.diff(x, prepend=U(0)), "<u8"
    x = np.ascontiguousarray(x.astype(kind, copy=False))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else x
    return n + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, kind: str) -> np.ndarray:
    n, body = int.from_bytes(data[:8], "little"), data[8:]
    if kind == "bits":
        return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
    dtype = np.dtype("<u8" if kind == "up" else kind)
    if not n:
        return np.zeros(0, dtype)
    raw = np.frombuffer(_CODEC.decompress(body, n * dtype.itemsize, asbytes=True), np.uint8)
    x = np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
    return np.cumsum(x, dtype=U) if kind == "up" else x


class Chunk:
    """Some whole documents: ids (NULL_ID for null), bytes and offsets."""

    def __init__(self, number: int, ids: bytes, nulls: bytes, sizes: bytes, body: bytes):
        self.number, self.ids, self.nulls = number, np.frombuffer(ids, "<i8"), nulls
        self.raw = np.frombuffer(body, np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))]).astype(np.int64)

    def names(self) -> list:
        """The ids as they were, nulls included."""
        none = np.unpackbits(np.frombuffer(self.nulls, np.uint8), count=len(self.ids))
        return [None if x else k for k, x in zip(self.ids.tolist(), none.tolist(), strict=True)]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, ids, sizes, parts, held = TaskContext.get().partitionId() << 33, [], [], [], 0

    def row() -> pa.RecordBatch:
        known = np.array([NULL_ID if k is None else k for k in ids], "<i8").tobytes()
        cells = (known, np.packbits([k is None for k in ids]).tobytes(), np.array(sizes, "<i8").tobytes(), b"".join(parts))
        return pa.RecordBatch.from_arrays([pa.array([number]), *[pa.array([x], pa.binary()) for x in cells]], ["chunk", "ids", "nulls", "sizes", "body"])

    for batch in batches:
        raw, at = buffers(batch.column(1))
        names, size, at = batch.column(0).to_pylist(), np.diff(at).tolist(), at.tolist()
        begin = 0
        for i, n in enumerate(size):
            held += n
            if held >= CHUNK_BYTES or i == len(size) - 1:  # documents of a batch lie side by side
                ids += names[begin : i + 1]
                sizes += size[begin : i + 1]
                parts.append(raw[at[begin] : at[i + 1]].tobytes())
                begin = i + 1
            if held >= CHUNK_BYTES:
                yield row()
                number, ids, sizes, parts, held = number + 1, [], [], [], 0
    if ids:
        yield row()


def _chunk(r: dict) -> Chunk:
    return Chunk(r["chunk"], r["ids"], r["nulls"], r["sizes"], r["body"])


def _row(bucket: int, gang: int, level: int, chunks, counts, parts: list) -> dict:
    return {"bucket": bucket, "gang": gang, "level": level, "chunks": np.asarray(chunks, "<i8").tobytes(), "counts": np.asarray(counts, "<i8").tobytes(), "parts": parts}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_ROW_TYPES)


class Rounds:
    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN):
        spark = self.spark = docs.sparkSession
        src = narrowed(docs, id_col, text_col).select(integer_key(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
        self.tasks, self.fan = shuffle_partitions(spark), fan
        name = f"chunks_{uuid.uuid4().hex}"
        chunks = src.mapInArrow(_gather, "chunk long, ids binary, nulls binary, sizes binary, body binary")
        chunks.write.option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(self.tasks, "chunk").saveAsTable(name)
        self.chunks = spark.table(name)
        size = self.chunks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
        # The plan knows the files and their buckets; the catalog need not keep the name.
        spark.sql(f"DROP TABLE {name}")
        self.depth = max(1, int(np.ceil(np.log2(max(self.tasks, size / BUCKET_BYTES)))))
        self.told: DataFrame | None = None
        self.kinds: list[tuple[list, list]] = []

    def _over_chunks(self, fn: Callable[[Chunk, list], pa.Table], schema: str) -> DataFrame:
        """fn(chunk, [(answers, state) of each round so far]) for every chunk."""
        if self.told is None:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for r in batch.to_pylist():
                        yield from fn(_chunk(r), []).to_batches()

            return self.chunks.mapInArrow(run, schema)
        kinds = list(self.kinds)

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            (r,) = left.to_pylist()
            rows, told = sorted(right.to_pylist(), key=lambda x: (x["level"], x["bucket"])), []
            for k, (answers, state) in enumerate(kinds):
                own = [x["parts"] for x in rows if x["level"] == k and x["bucket"] >= 0]
                kept = [x["parts"] for x in rows if x["level"] == k and x["bucket"] < 0]
                told.append((
                    [np.concatenate([np.zeros(0, bool if a == "bits" else a), *[unpack(p[i], a) for p in own]]) for i, a in enumerate(answers)],
                    [unpack(kept[0][i], s) for i, s in enumerate(state)] if kept else [],
                ))
            return fn(_chunk(r), told)

        return self.chunks.groupBy("chunk").cogroup(self.told.groupBy("gang")).applyInArrow(pair, schema)

    def ask(self, question: Callable[[Chunk, list], tuple], judge: Callable, sent: list[str], answers: list[str], state: list[str] | None = None, forget: bool = False) -> None:
        """question gives (arrays, state) of a chunk: arrays of the kinds ``sent``, the first ascending keys.

        judge gets those arrays of one bucket, chunks one after another, and returns one array of each
        kind in ``answers``. ``forget`` drops what earlier rounds told, where the state holds all of it.
        """
        depth, level, state = self.depth, len(self.kinds), state or []
        fine = depth // 2 if 1 << depth > self.fan else 0
        coarse, first = depth - fine, sent[0]
        # (A number is a partition's and a count: both spread.)
        spread_ = lambda number, bits: (number ^ number >> 33) & ((1 << bits) - 1)

        def send(chunk: Chunk, told: list) -> pa.Table:
            arrays, kept = question(chunk, told)
            bucket = (arrays[0] >> U(64 - coarse)).astype(np.int64)
            gang = chunk.number if not fine else spread_(chunk.number, fine)
            heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[: len(bucket)]
            rows = [
                _row(int(bucket[i]), gang, level, [chunk.number], [j - i], [pack(x[i:j], k) for x, k in zip(arrays, sent, strict=True)])
                for i, j in zip(heads, [*heads[1:], len(bucket)])
            ]
            if state:  # to a place of its own, past the judge
                rows.append(_row(-1 - spread_(chunk.number, min(depth, 30)), chunk.number, level, [chunk.number], [0], [pack(x, k) for x, k in zip(kept, state, strict=True)]))
            return _table(rows)

        def onward(t: pa.Table) -> pa.Table:
            """Rows of a gang's chunks for one coarse bucket, regrouped for its fine ones."""
            rows = t.to_pylist()
            if rows[0]["bucket"] < 0:
                return _table(rows)
            whole = [[unpack(r["parts"][i], k) for r in rows] for i, k in enumerate(sent)]
            cell = [((x >> U(64 - depth)) & U((1 << fine) - 1)).astype(np.int64) for x in whole[0]]
            numbers = [int(np.frombuffer(r["chunks"], "<i8")[0]) for r in rows]
            out = []
            for b in np.unique(np.concatenate(cell)):
                some = [(i, *np.searchsorted(c, [b, b + 1])) for i, c in enumerate(cell)]
                some = [(i, x, y) for i, x, y in some if y > x]
                # (Each chunk's keys ascend, but not those of one chunk after another.)
                parts = [pack(np.concatenate([w[i][x:y] for i, x, y in some]), "<u8" if k == "up" else k) for w, k in zip(whole, sent, strict=True)]
                out.append(_row(rows[0]["bucket"] << fine | int(b), rows[0]["gang"], level, [numbers[i] for i, _, _ in some], [y - x for _, x, y in some], parts))
            return _table(out)

        def meet(t: pa.Table) -> pa.Table:
            rows = t.to_pylist()
            if rows[0]["bucket"] < 0:
                return _table(rows)
            kinds = ["<u8" if fine and k == "up" else k for k in sent]
            told = judge(*[np.concatenate([unpack(r["parts"][i], k) for r in rows]) for i, k in enumerate(kinds)])
            cut = np.cumsum([np.frombuffer(r["counts"], "<i8").sum() for r in rows])[:-1]
            pieces = zip(*[np.split(x, cut) for x in told], strict=True)
            return _table([r | {"parts": [pack(x, k) for x, k in zip(p, answers, strict=True)]} for r, p in zip(rows, pieces, strict=True)])

        def back(t: pa.Table) -> pa.Table:
            """Answers to a gang from the fine buckets of one coarse bucket, dealt to its chunks."""
            rows = sorted(t.to_pylist(), key=lambda r: r["bucket"])
            if rows[0]["bucket"] < 0:
                return _table(rows)
            own: dict = {}
            for r in rows:
                cut = np.cumsum(np.frombuffer(r["counts"], "<i8"))[:-1]
                pieces = zip(*[np.split(unpack(p, k), cut) for p, k in zip(r["parts"], answers, strict=True)], strict=True)
                for number, p in zip(np.frombuffer(r["chunks"], "<i8").tolist(), pieces, strict=True):
                    own.setdefault(number, []).append(p)
            return _table([_row(rows[0]["bucket"] >> fine, c, level, [c], [0], [pack(np.concatenate(x), k) for x, k in zip(zip(*ps, strict=True), answers, strict=True)]) for c, ps in own.items()])

        rows = self._over_chunks(send, ROW)
        if fine:
            rows = rows.groupBy("bucket", "gang").applyInArrow(onward, ROW)
        rows = rows.groupBy("bucket").applyInArrow(meet, ROW)
        if fine:
            rows = rows.groupBy(F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.shiftright("bucket", fine)).alias("way"), "gang").applyInArrow(back, ROW)
        rows = materialize(rows, "answers")
        self.told = rows if self.told is None or forget else self.told.unionByName(rows)
        self.kinds.append((answers, state))
        assert first in ("up", "<u8")

    def finish(self, fn: Callable[[Chunk, list], pa.Table], schema: str) -> DataFrame:
        return self._over_chunks(fn, schema)


def occurs_elsewhere(keys: np.ndarray, many: np.ndarray) -> tuple[np.ndarray]:
    """The key was sent by two chunks, or occurs twice in one."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[inverse[many]] = True
    return (twice[inverse],)


def pair_occurs_elsewhere(keys: np.ndarray, second: np.ndarray, many: np.ndarray) -> tuple[np.ndarray]:
    """The same of (key, second)."""
    order, new = ordered(keys, second)
    return occurs_elsewhere(_places(order, new), many)


def ordered(keys: np.ndarray, second: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in order of (key, second, least), and which of them begin another (key, second)."""
    order = np.lexsort((second, keys) if least is None else (least, second, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, new


def _places(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The number of each entry's class."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def smaller_elsewhere(keys: np.ndarray, second: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """one: some entry of the same (key, second) has a smaller ``least``. two: the key has several seconds."""
    order, new = ordered(keys, second, least)
    lowest = least[order][new][np.cumsum(new) - 1]
    one = np.zeros(len(keys), bool)
    one[order] = least[order] > lowest
    _, inverse = np.unique(keys, return_inverse=True)
    kinds = np.bincount(inverse[order[new]], minlength=inverse.max() + 1 if len(inverse) else 0)
    return one, (kinds > 1)[inverse]


def winnow(hashes: np.ndarray, offsets: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window): for each maximal run of windows with the same smallest run hash.

    ``hashes[i]`` is the hash of ``run`` symbols at i; a window is ``width`` symbols inside one document.
    The leftmost of equal hashes is the anchor, so equal windows have their anchors at equal offsets.
    """
    none = np.zeros(0, np.int64)
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return none, none, none
    valid = np.ones(n, bool)
    for e in offsets[1:]:
        valid[max(0, int(e) - width + 1) : max(0, min(n, int(e)))] = False
    span = width - run + 1
    best, at, step = hashes, np.arange(len(hashes)), 1

    def smaller(b1, a1, b2, a2):
        right = b2 < b1
        return np.where(right, b2, b1), np.where(right, a2, a1)

    while 2 * step <= span:
        best, at = smaller(best[:-step], at[:-step], best[step:], at[step:])
        step *= 2
    if step < span:
        d = span - step
        best, at = smaller(best[:-d], at[:-d], best[d:], at[d:])
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none
    chosen = at[starts]
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]
    heads = np.flatnonzero(new)
    return chosen[heads], starts[heads], starts[np.r_[heads[1:], len(starts)] - 1]


def spread(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of n places covered by any [first, last)."""
    edge = np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def expand(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the inclusive ranges, in order."""
    lens = last - first + 1
    return np.repeat(first - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
