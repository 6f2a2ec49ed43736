"""Token-id shards with a minimal perfect hash index.

Documents are dealt into shards by ranges of their key (and of a hash of the text, so that rows of one hot
key spread) and sorted in them, so shards in order hold the ids in ascending key order. A shard is a few
rows, *parts*, of a table in the shared folder (any store that Spark writes): the raw ids of its documents,
little-endian, and an index in three byte strings:

* ``seeds``: one 32-bit displacement per bucket of about four keys (hash and displace). With a key's
  bucket and its displacement a key falls on a slot of its own, and there are as many slots as keys;
* ``prints``: the 64-bit fingerprint of the key in each slot, so that an absent key is refused;
* ``slots``: where its ids begin (in ids, within the part), how many ids and how many rows.

A lookup filters the parts by their first and last key, which the files' own statistics answer, so other
parts are not read. In the part it reads one displacement, one fingerprint and one slot: constant time,
whatever the size of the part. Of the payload only the slot's slice leaves the scan.

Ids are encoded by the tokenizers library. Texts are cut where a pre-token begins whatever surrounds it
(``cuts``); a piece of at most 24 bytes is its own key in a table of fixed size, where numpy finds all pieces
of a megabyte at once. Pieces that are not there go to the library together.

Defined results: a null text is empty and has just the end id; a null key sorts first; rows of equal
keys stay apart (in order of a hash of their text), those of one part share a slot, which counts them; an
empty table writes an empty store; extra columns are ignored; keys are integers or strings, other types
are refused.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import narrowed, new_path, shuffle_partitions
from .hashing import U, buffers, mix, slices

END_ID = 0
_G = U(0x9E3779B97F4A7C15)
#: A part is closed at so many ids (one document may hold more), so that a row stays far below 2 GB.
PART_IDS = 1 << 20
#: Slots of the table of pieces, and ids that they may refer to before the table is emptied.
SLOTS, POOL = 1 << 21, 1 << 23
SLICE = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


WS, BLANK, LETTER, MARK, SOLID, QUOTE, LEAD, REST = (1 << k for k in range(8))


def _classes() -> np.ndarray:
    """What the cuts ask of a byte. LEAD and REST together are a letter of Latin-1; SOLID surely begins no white space."""
    out = np.zeros(256, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = WS
    out[32] |= BLANK
    for b in range(33, 127):
        out[b] = SOLID | (LETTER if chr(b).isalpha() else 0 if chr(b).isdigit() else MARK)
    out[ord("'")] |= QUOTE
    out[0xC3:0xF5] |= SOLID
    out[0xE1:0xE4] = 0
    out[0xC3] |= LEAD
    out[0x80:0xC0] |= REST
    out[[0x97, 0xB7]] = 0
    return out


CLASSES = _classes()


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], more = chr(more), more + 1
    return out


def cuts(raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts of pieces: places where a match of the byte-level pattern begins, with any text around.

    White space is a match of its own but for the last blank before a word. A run of it that is followed by
    something else is matched without its last character, which stands alone or, if a blank, leads the word.
    Letters end before a mark, and marks other than a quote (it may begin a contraction) before a letter.
    """
    n = len(raw)
    c = np.zeros(n + 2, np.uint8)  # one place before and behind, of no class
    c[1:-1] = CLASSES[raw]
    inner = np.ones(n + 2, bool)  # is the byte before in the same document?
    inner[begins + 1] = False
    inner[[0, n + 1]] = False
    latin = np.zeros(n + 2, bool)
    latin[:-1] = (c[:-1] & LEAD > 0) & (c[1:] & REST > 0)
    ascii_letter = c & LETTER > 0
    starts_letter, ends_letter = ascii_letter | latin, ascii_letter.copy()
    ends_letter[1:] |= latin[:-1]
    mark, ws = c & MARK > 0, c & WS > 0
    graphic = np.zeros(n + 2, bool)
    graphic[1:-1] = (raw > 32) & (raw < 127)
    solid_end = graphic | ends_letter
    last = np.zeros(n + 2, bool)  # last of a run of white space before something else
    last[:-1] = ws[:-1] & (c[1:] & SOLID > 0) & inner[1:]
    cut = last.copy()
    cut[1:] |= last[:-1] & (c[:-1] & BLANK == 0)
    behind = ws[1:] & solid_end[:-1] | mark[1:] & ends_letter[:-1] | starts_letter[1:] & mark[:-1] & (c[:-1] & QUOTE == 0)
    cut[1:] |= behind & inner[1:]
    cut = cut[1:-1]
    cut[begins[begins < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Texts to ids through a table of pieces, direct mapped: slot by hash, key in three words and a length."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        described = str(t.pre_tokenizer)
        #: Cuts hold for the byte-level pattern alone; texts of other tokenizers go to the library whole.
        self.direct = "ByteLevel" in described and "Sequence" not in described and "add_prefix_space=False" in described and "use_regex=True" in described and t.normalizer is None
        self.letters = _byte_letters()
        added = [re.escape(x.content.encode()) for x in t.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added)) if added else None
        self.keys, self.sizes = np.zeros((3, SLOTS), U), np.full(SLOTS, 255, np.uint8)
        self.off, self.count = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.uint8)
        self.pool, self.held = np.zeros(POOL, "<u4"), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # fast: without offsets

    def together(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces: letters, with a blank or without, are one pre-token, which the library's BPE model takes directly."""
        out, rest, tokenize, letters = [None] * len(pieces), [], self.tokenizer.model.tokenize, self.letters
        for i, p in enumerate(pieces):
            if (p[1:] if p[0] == " " else p).isalpha():
                out[i] = [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))]
            else:
                rest.append(i)
        for i, x in zip(rest, self.whole([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _slice(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = cuts(raw, offsets[:-1])
        size = np.diff(np.r_[starts, len(raw)])
        padded = np.r_[raw, np.zeros(32, np.uint8)]
        at8 = np.ndarray((len(raw) + 24,), "<u8", padded.data, 0, (1,))  # eight bytes from every place
        low = lambda k: _MASK[np.clip(size - 8 * k, 0, 8)]
        k0, k1, k2 = (at8[starts + 8 * k] & low(k) for k in range(3))
        slot = (mix(k0 * _G + (k1 ^ (k1 >> U(29))) * U(0xD6E8FEB86659FD93) + (k2 ^ (k2 >> U(31))) * U(0xA0761D6478BD642F) + size.astype(U)) >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        hit = (self.sizes[slot] == size) & (self.keys[0, slot] == k0) & (self.keys[1, slot] == k1) & (self.keys[2, slot] == k2)
        off, count = self.off[slot].astype(np.int64), self.count[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            body, first, inverse = raw.tobytes(), {}, np.empty(len(miss), np.int64)
            begin, end = starts[miss].tolist(), (starts[miss] + size[miss]).tolist()
            for j, (a, b) in enumerate(zip(begin, end, strict=True)):
                inverse[j] = first.setdefault(body[a:b], len(first))
            ids = self.together([p.decode() for p in first])
            n = np.array([len(x) for x in ids], np.int64)
            if self.held + n.sum() > len(self.pool):
                # Ids of this slice's hits must stay: the old pool is read before it is left.
                old, keep = self.pool, np.flatnonzero(hit)
                self.sizes[:] = 255
                self.pool, self.held = np.zeros(max(POOL, int(2 * n.sum() + 2 * count[keep].sum())), "<u4"), 0
                kept = old[_expand(off[keep], count[keep])]
                self.pool[: len(kept)] = kept
                off[keep] = np.cumsum(count[keep]) - count[keep]
                self.held = len(kept)
            place = self.held + np.cumsum(n) - n
            self.pool[self.held : self.held + n.sum()] = np.concatenate(ids)
            self.held += int(n.sum())
            off[miss], count[miss] = place[inverse], n[inverse]
            short = miss[size[miss] <= 24]
            s = slot[short]
            # (Several pieces may want one slot: each column must take the same one, the last.)
            winner = np.zeros(0, np.int64) if not len(s) else len(s) - 1 - np.unique(s[::-1], return_index=True)[1]
            short, s = short[winner], s[winner]
            self.keys[0, s], self.keys[1, s], self.keys[2, s], self.sizes[s] = k0[short], k1[short], k2[short], size[short]
            self.off[s], self.count[s] = off[short], count[short]
        total = np.r_[0, np.cumsum(count)]
        docs = np.diff(total[np.searchsorted(starts, offsets)])
        return self.pool[_expand(off, count)], docs

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(documents, ids of all of them, ids of each) for runs of documents of about a megabyte."""
        for i, j in slices(offsets, SLICE):
            lo = int(offsets[i])
            part, at = raw[lo : int(offsets[j])], offsets[i : j + 1] - lo
            if not self.direct or (self.added is not None and self.added.search(part)):
                ids = self.whole([part[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])])
                yield j - i, np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
            elif not len(part):
                yield j - i, np.zeros(0, "<u4"), np.zeros(j - i, np.int64)
            else:
                yield j - i, *self._slice(part, at)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def _expand(off: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places off[i] .. off[i] + count[i] - 1, in order."""
    ends = np.cumsum(count)
    return np.repeat(off - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def key_hashes(keys: list) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"\0" if k is None else b"\1" + str(k).encode()) for k in keys], U)


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacement per bucket, slot of each hash): a minimal perfect hash of distinct hashes."""
    n = len(hashes)
    buckets = max(1, -(-n // 4))
    bucket = (hashes % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    heads = np.searchsorted(bucket[order], np.arange(buckets + 1))
    seeds, taken, slots = np.zeros(buckets, "<u4"), np.zeros(n, bool), np.zeros(n, np.int64)
    for b in np.argsort(-np.diff(heads), kind="stable"):
        rows = order[heads[b] : heads[b + 1]]
        if not len(rows):
            break
        seed, h = 0, hashes[rows]
        while True:
            tries = np.arange(seed, seed + 64, dtype=U)
            at = (mix(h[None, :] + (tries[:, None] + U(1)) * _G) % U(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if len(rows) > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                seeds[b], slots[rows] = seed + k, at[k]
                taken[at[k]] = True
                break
            seed += 64
    return seeds, slots


def find(h: np.ndarray, seeds: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Slot of each key hash, or -1 where the fingerprint says that the key is absent."""
    n = len(prints)
    if not n:
        return np.full(len(h), -1)
    seed = seeds[(h % U(len(seeds))).astype(np.int64)].astype(U)
    slot = (mix(h + (seed + U(1)) * _G) % U(n)).astype(np.int64)
    return np.where(prints[slot] == mix(h ^ _G), slot, -1)


def _row(shard: int, part: int, before: int, keys: list, ids: np.ndarray, sizes: np.ndarray) -> dict:
    hashes = key_hashes(keys)
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    begins = np.cumsum(sizes) - sizes
    seeds, slot = build_index(hashes[first])
    prints, slots = np.zeros(len(first), "<u8"), np.zeros((len(first), 3), "<i8")
    prints[slot] = mix(hashes[first] ^ _G)
    slots[slot] = np.stack([begins[first], np.add.reduceat(sizes, first), np.diff(np.r_[first, len(keys)])], axis=1)
    known = [k for k in keys if k is not None]
    return {
        "shard": shard, "part": part, "before": before, "has_null": len(known) < len(keys), "first_key": known[0] if known else None, "last_key": known[-1] if known else None,
        "n_docs": len(keys), "n_ids": int(sizes.sum()), "keys": keys, "counts": sizes.astype("<u4").tobytes(),
        "seeds": seeds.tobytes(), "prints": prints.tobytes(), "slots": slots.tobytes(), "payload": ids.tobytes(),
    }


def store_schema(kind: str) -> str:
    return f"shard int, part int, before long, has_null boolean, first_key {kind}, last_key {kind}, n_docs long, n_ids long, keys array<{kind}>, counts binary, seeds binary, prints binary, slots binary, payload binary"


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, part_ids: int = PART_IDS) -> None:
    """Encode every text, append the end id, and write the shards under ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tokenizer = tokenizer or default_path()
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        raise TypeError(f"keys must be integers or strings, not {kind.simpleString()}")
    # Rows of one key are told apart by a hash: a hot key spreads over shards, and no sort compares whole texts.
    src = narrowed(docs, id_col, text_col).select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_first(), F.col("h")]
    dealt = src.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("key", "text")
    schema = store_schema(kind.simpleString())
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, before, encode = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer).encode
        keys, ids, sizes, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_row(shard, part, before, keys, np.concatenate(ids), np.concatenate(sizes))], schema=arrow)

        for batch in batches:
            names, done = batch.column(0).to_pylist(), 0
            for n, x, size in encode(*buffers(batch.column(1))):
                keys += names[done : done + n]
                done += n
                ids.append(np.insert(x, np.cumsum(size), end)), sizes.append(size + 1)
                held += len(ids[-1])
                if held >= part_ids:
                    yield row()
                    before, part = before + held, part + 1
                    keys, ids, sizes, held = [], [], [], 0
        if keys:
            yield row()

    dealt.mapInArrow(run, schema).write.option("compression", "zstd").mode("errorifexists").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The parts with ``base``: the ids in all parts before each.

    A part knows the ids before it in its shard. Sums over shards are one row a shard, never more than
    there were shuffle partitions, so their table is broadcast and no payload is shuffled for it.
    """
    store = spark.read.parquet(path)
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = store.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("shard_base", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    return store.join(F.broadcast(shards), "shard").withColumn("base", F.col("shard_base") + F.col("before")).drop("shard_base")


def parts_of(store: DataFrame, wanted: list) -> DataFrame:
    """The parts whose range of keys holds one of the wanted ones: bounds are compared with the files' statistics."""
    known, kind = sorted({k for k in wanted if k is not None}), store.schema["first_key"].dataType
    lit = lambda k: F.lit(k).cast(kind)
    cond = F.col("has_null") if None in wanted else F.lit(False)
    if known:
        between = (F.col("first_key") <= lit(known[-1])) & (F.col("last_key") >= lit(known[0]))
        if len(known) > 1:
            between &= F.exists(F.array(*map(lit, known)), lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key")))
        cond = between if None not in wanted else cond | between
    return store.where(cond)


def lookup(store: DataFrame, wanted: list) -> DataFrame:
    """(key, start, ids) of the wanted keys that the store holds, by the indexes of their parts; rows of a key that share a part come as one."""
    kind = store.schema["first_key"].dataType.simpleString()
    near = parts_of(store, wanted)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, asked = [], list(dict.fromkeys(wanted))
            h = key_hashes(asked)
            for r in batch.to_pylist():
                slots = np.frombuffer(r["slots"], "<i8").reshape(-1, 3)
                at = find(h, np.frombuffer(r["seeds"], "<u4"), np.frombuffer(r["prints"], "<u8"))
                for k, s in zip(asked, at, strict=True):
                    if s >= 0:
                        begin, n, _ = slots[s].tolist()
                        out.append({"shard": r["shard"], "part": r["part"], "key": k, "start": r["base"] + begin, "at": 4 * begin + 1, "length": 4 * n})
            yield pa.RecordBatch.from_pylist(out, schema=found_types)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").tolist() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], ["key", "start", "ids"])

    from pyspark.sql.pandas.types import to_arrow_schema

    found = f"shard int, part int, key {kind}, start long, at int, length int"
    found_types = to_arrow_schema(T._parse_datatype_string(found))
    spots = near.select("shard", "part", "base", "seeds", "prints", "slots").mapInArrow(locate, found)
    hit = near.select("shard", "part", "payload").join(F.broadcast(spots), ["shard", "part"])
    return hit.select("key", "start", F.substring("payload", F.col("at"), F.col("length")).alias("raw")).mapInArrow(decode, f"key {kind}, start long, ids array<long>")


def read_store(store: DataFrame) -> DataFrame:
    """Every stored row in order: key, start, n_tokens and the crc32 of its ids, each found by the index."""
    kind = store.schema["first_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = batch.column(0), {c: batch.column(c).to_pylist() for c in ("base", "counts", "seeds", "prints", "slots")}
            for i in range(batch.num_rows):
                keys = names[i].values
                slot = find(key_hashes(keys.to_pylist()), np.frombuffer(columns["seeds"][i], "<u4"), np.frombuffer(columns["prints"][i], "<u8"))
                if (slot < 0).any():
                    raise ValueError("a stored key is missing from its index")
                begin, n, rows = np.frombuffer(columns["slots"][i], "<i8").reshape(-1, 3)[slot].T.copy()
                counts = np.where(rows == 1, n, np.frombuffer(columns["counts"][i], "<u4"))  # a slot knows the sum of its rows alone
                for j in np.flatnonzero(slot[1:] == slot[:-1]) + 1:  # further rows of one key follow its first
                    begin[j] = begin[j - 1] + counts[j - 1]
                view = memoryview(batch.column("payload")[i].as_buffer())
                crc = [zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(begin + columns["base"][i]), pa.array(counts), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    return store.select("keys", "base", "counts", "seeds", "prints", "slots", "payload").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")


def op9(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(open_store(spark, path)).withColumnRenamed("key", "doc_id")
