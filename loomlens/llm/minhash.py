"""MinHash near-dedup with HyperMinHash registers.

Each of ``BANDS * ROWS`` buckets keeps the smallest hash of a document's shingles under the bucket's
own permutation, compressed to 16 bits: the count of leading zeros (6) and the ten mantissa bits after
the leading one. (A permutation per bucket, not a split of one hash: no bucket is ever empty, so texts
of a few words are matched as surely as long ones.) Bands of compressed registers are hashed; equal
bands make candidates; the register agreement, corrected for accidental register collisions, estimates
the similarity, and full shingle sets confirm it with integers.

Scale. Equal shingle sets fold into one representative before anything is compared (partial sums on
the map side, so a third of all rows being copies costs one row a task). Then

* every representative is compared with the smallest members of its bands (``LEADERS`` of them, one row
  each), and components of these confirmed links are its label: a large group of near copies is mostly one
  label after this, at a cost in proportion to its size;
* bands whose members have several labels are compared bucket by bucket, never by components of band
  collisions, which could chain unlike texts. Only pairs of different labels are compared, in the first
  band that they share. A bucket is cut into blocks of ``block_bytes``: small labels share blocks, a large
  one has blocks of its own, which are not paired with one another. Each pair of blocks is a group of its
  own, and groups are packed by bytes, so no task holds more than a bounded size;
* a task returns spanning links alone. Components of all links come from ``connected_components``.

What is left quadratic is a bucket of large labels that no chain of leaders joins: its blocks meet in pairs.

Defined results: texts without words have an empty set and are linked with nothing; a text with fewer
words than a shingle is one shingle; a null doc_id is never linked to and stands alone; rows
of one doc_id are one node of the graph; ids that are no integers are refused; an empty table gives no
rows; extra columns are ignored.

Chance: bands of 4 in 25 miss a pair of similarity 0.8 with probability 2e-6, less above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, integer_key, materialize, narrowed, shuffle_partitions
from .hashing import U, buffers, mix, shingle_sets, slices

BANDS, ROWS = 25, 4
M = BANDS * ROWS
_seed = mix(np.arange(1, 2 * M + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_A, _B = _seed[:M] | U(1), _seed[M:]
#: Two unequal minima share a register this often (HyperMinHash, ten mantissa bits).
COLLISION = 0.169919487159739 * 2.0 ** (1 - 10)
#: Members of its bands that a text is compared with at first; bytes in a block, and in a pack of groups.
LEADERS = 4
BLOCK_BYTES, PACK_BYTES = 8 << 20, 16 << 20
#: Bytes of text whose sets a Python worker holds at once.
SLICE_BYTES = 4 << 20
#: Bytes of a text beside its shingles: registers, bands and what Python needs to hold them.
ROW_BYTES = 2 * M + 8 * BANDS + 300


def registers(shingles: np.ndarray) -> np.ndarray:
    """M registers of 6 bits of leading zeros and 10 of mantissa, as uint16."""
    low = np.full(M, ~U(0), U)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[i : i + 4096, None] * _A + _B).min(axis=0))
    _, e = np.frexp((low >> U(11)).astype(np.float64))
    zeros = (53 - e).astype(U)  # 53 for a zero
    mantissa = (low << np.minimum(zeros + U(1), U(63))) >> U(54)
    return ((np.minimum(zeros, U(63)) << U(10)) | mantissa).astype(np.uint16)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from register agreement, corrected for accidental agreement."""
    t = (many == one).mean(axis=1)
    return (t - COLLISION) / (1 - COLLISION)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_no = np.arange(BANDS, dtype=U)
        for batch in batches:
            raw, at = buffers(batch.column(1))
            sizes, keys, bands, regs = [], [], [], []
            for s in shingle_sets(raw, at, width):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), regs.append(None)
                    continue
                r = registers(s)
                b = r.reshape(BANDS, ROWS).view("<u8")[:, 0]
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(mix(b + band_no * U(0x9E3779B97F4A7C15)).view(np.int64))
                regs.append(r.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(regs, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "regs"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(buffers(whole.column(1))[1], SLICE_BYTES):
                batch = whole.slice(i, j - i)
                raw, at = buffers(batch.column(1))
                sets = [s.tobytes() for s in shingle_sets(raw, at, width)]
                # Rows of one doc_id may hold other texts than the representative's: those are not its set.
                own = [xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column(2).to_pylist(), strict=True)]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), *[batch.column(i) for i in range(3, batch.num_columns)], pa.array(sets, pa.binary())],
                    ["doc_id", *batch.schema.names[3:], "shingles"],
                )
                yield out.filter(pa.array(own, pa.bool_()))

    return run


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                self.up = nxt
                return nxt
            up = nxt

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def links_within(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, bands: np.ndarray, no: int, percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links (exact: 100 * intersection >= percent * union) between texts of different labels.

    ``no`` is the band that they share: pairs that share an earlier one are left to it. ``left`` marks the
    first block of a pair of blocks: only links across are looked for then. Each text is compared with all
    others that are not yet connected to it: by size and by estimated similarity (five standard errors
    below the threshold) first, then on full sets.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    least = percent / 100 - 5 * (0.25 / M) ** 0.5
    _, head, inverse = np.unique(labels, return_index=True, return_inverse=True)
    groups, out, postings = Union(n), [], None
    groups.up = head[inverse]
    for i in range(n) if left is None else np.flatnonzero(left):
        roots = groups.roots()
        open_ = roots != roots[i]
        if left is None:
            open_[:i] = False
        else:
            open_ &= ~left
        j = np.flatnonzero(open_)
        j = j[(100 * sizes[j] >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes[j])]
        if len(j):
            j = j[(bands[j, :no] != bands[i, :no]).all(axis=1)]
        if len(j):
            j = j[estimate(regs[i], regs[j]) >= least]
        if len(j) <= 16:
            j = np.array([k for k in j if similar(sets[i], sets[k], percent)], np.int64)
        else:
            if postings is None:
                vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
                ends, owner = np.cumsum(sizes), np.repeat(np.arange(n), sizes)
                order = np.argsort(flat, kind="stable")
                postings, heads = owner[order], np.searchsorted(flat[order], np.arange(len(vocabulary) + 1))
            terms = flat[ends[i] - sizes[i] : ends[i]]
            lens = heads[terms + 1] - heads[terms]
            at = np.repeat(heads[terms] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
            shared = np.bincount(postings[at], minlength=n)[j]
            j = j[100 * shared >= percent * (sizes[i] + sizes[j] - shared)]
        for k in j:
            if groups.find(i) != groups.find(k):
                groups.join(i, k)
                out.append((int(ids[i]), int(ids[k])))
    return out


def _confirm(percent: int):
    """A pack of pairs of blocks to spanning links."""

    def run(t: pa.Table) -> pa.Table:
        column = lambda c: t.column(c).to_numpy()
        ids, labels, band, no, low, high, block = (column(c) for c in ("doc_id", "label", "band", "no", "low", "high", "block"))
        (raw, at), regs = buffers(t.column("shingles")), np.stack([np.frombuffer(x, np.uint16) for x in t.column("regs").to_pylist()])
        bands = t.column("bands").combine_chunks().values.to_numpy().reshape(-1, BANDS)
        order, out = np.lexsort((ids, high, low, band)), []
        same = lambda c: c[order][1:] == c[order][:-1]
        for rows in np.split(order, np.flatnonzero(~(same(band) & same(low) & same(high))) + 1):
            left = None
            if low[rows[0]] != high[rows[0]]:
                left = block[rows] == low[rows[0]]
                if left.all() or not left.any():
                    continue
            if (labels[rows] == labels[rows[0]]).all():
                continue
            out += links_within(ids[rows], labels[rows], [raw[at[r] : at[r + 1]].view(U) for r in rows], regs[rows], bands[rows], int(no[rows[0]]), percent, left)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _star_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_at), (y, y_at) = buffers(batch.column(2)), buffers(batch.column(3))
            ok = [similar(x[x_at[i] : x_at[i + 1]].view(U), y[y_at[i] : y_at[i + 1]].view(U), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def blocks_of(open_: DataFrame, block_bytes: int) -> DataFrame:
    """open_(band, no, rep, label, bytes) with ``block`` and, one row each, the pairs (low, high) of blocks that it is in.

    Blocks of a band are numbered: first those that small labels share, then each large label's own. A pair
    of blocks of one label is left out, as nothing in it is compared.
    """
    big = open_.groupBy("band", "label").agg(F.sum("bytes").alias("size"))
    own = F.when(F.col("size") > block_bytes, F.ceil(F.col("size") / block_bytes)).otherwise(0).cast("int")
    big = big.select("band", "label", own.alias("own"), F.when(own == 0, F.col("size")).otherwise(0).alias("loose"))
    per_band = big.groupBy("band").agg(F.ceil(F.sum("loose") / block_bytes).cast("int").alias("shared"), F.sort_array(F.collect_list(F.when(F.col("own") > 0, F.struct("label", "own")))).alias("large"))
    # Where each large label's blocks begin, and how many blocks there are.
    begins = F.aggregate("large", F.struct(F.col("shared").alias("next"), F.array().cast("array<struct<label:bigint,first:int,own:int>>").alias("at")), lambda acc, x: F.struct((acc["next"] + x["own"]).alias("next"), F.concat(acc["at"], F.array(F.struct(x["label"].alias("label"), acc["next"].alias("first"), x["own"].alias("own")))).alias("at")))
    per_band = per_band.withColumn("b", begins).select("band", "shared", F.col("b.next").alias("all"), F.col("b.at").alias("at"))
    single = per_band.where("all <= 1").select("band", F.lit(True).alias("single"))
    x = open_.join(single, "band", "left")
    plain = x.where("single").select("band", "no", "rep", "label", "bytes", *[F.lit(0).alias(c) for c in ("block", "low", "high")])
    firsts = per_band.where("all > 1").select("band", "shared", "all", F.explode_outer("at").alias("l")).select("band", F.col("l.label").alias("label"), F.col("l.first").alias("first"), F.col("l.own").alias("own"))
    x = x.where("single IS NULL").drop("single").join(firsts, ["band", "label"], "left").join(per_band.where("all > 1").select("band", "shared", "all"), "band")
    large = F.col("first").isNotNull()
    spot = F.when(large, F.col("first") + F.pmod(F.xxhash64("rep"), F.col("own").cast("long")).cast("int")).otherwise(F.pmod(F.xxhash64("label"), F.col("shared").cast("long")).cast("int"))
    x = x.withColumn("block", spot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    x = x.where(~large | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("own")))
    return plain.unionByName(x.select("band", "no", "rep", "label", "bytes", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, leaders: int = LEADERS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    spark = docs.sparkSession
    src = narrowed(docs, id_col, text_col).select(integer_key(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sig = materialize(src.mapInArrow(_signatures(width), "doc_id long, n_shingles long, set_key binary, bands array<long>, regs binary"), "signatures")
    # Equal sets fold into their smallest document, on the map side first.
    reps = materialize(
        sig.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("regs").alias("regs"), F.first("n_shingles").alias("n")),
        "representatives",
    )
    members = reps.select("rep", F.posexplode("bands").alias("no", "band"))
    buckets = members.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", "low")
    # (At most BANDS leaders a text.)
    stars = members.join(buckets, "band").groupBy("rep").agg(F.sort_array(F.collect_set("low")).alias("lows"))
    stars = materialize(stars.select("rep", F.slice(F.filter("lows", lambda x: x != F.col("rep")), 1, leaders).alias("lows")), "leaders")
    chosen = reps.join(stars.select("rep"), "rep")
    # (Repeated rows lie in one partition after the join: they are dropped there without another shuffle.)
    texts = src.join(chosen.withColumnRenamed("rep", "doc_id"), "doc_id").withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "set_key", "bands", "regs", "n")
    sets = materialize(texts.mapInArrow(_sets(width), "doc_id long, bands array<long>, regs binary, n long, shingles binary"), "candidate-sets")
    side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("shingles").alias(f"s_{name}"))
    pairs = stars.select(F.col("rep").alias("a"), F.explode("lows").alias("b")).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))).select("a", "b", "s_a", "s_b")
    linked = materialize(pairs.mapInArrow(_star_links(percent), "a long, b long"), "leader-links")
    labels = connected_components(linked).select(F.col("node").alias("rep"), "component")
    labelled = materialize(stars.select("rep").join(labels, "rep", "left").select("rep", F.coalesce("component", "rep").alias("label")), "labels")
    open_ = members.join(labelled, "rep")
    several = open_.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    open_ = open_.join(several, "band").join(reps.select("rep", (8 * F.col("n") + ROW_BYTES).alias("bytes")), "rep")
    open_ = materialize(open_.select("band", "no", "rep", "label", "bytes"), "open-bands")
    dealt = materialize(blocks_of(open_, block_bytes), "blocks")
    size = dealt.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    packs = max(shuffle_partitions(spark), size // PACK_BYTES)
    dealt = dealt.withColumn("pack", F.pmod(F.xxhash64("band", "low", "high"), F.lit(packs)))
    crossed = dealt.join(sets.select(F.col("doc_id").alias("rep"), "bands", "regs", "shingles"), "rep").withColumnRenamed("rep", "doc_id").drop("bytes").groupBy("pack").applyInArrow(_confirm(percent), "a long, b long")
    links = connected_components(linked.unionByName(crossed))
    labels = reps.select("set_key", "rep").join(links.select(F.col("node").alias("rep"), "component"), "rep", "left")
    labels = labels.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
