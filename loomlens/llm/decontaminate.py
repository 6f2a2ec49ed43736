"""Benchmark decontamination [native]: SimHash of item-sized windows, Hamming blocks, exact verification.

A document leaks an item if some window of as many words as the item has a weighted shingle similarity
(sum of the smaller counts over sum of the larger) of at least 0.8 with it. A document of fewer words
than the item is one window as a whole. Words are lower-cased and
stripped of punctuation; shingles are five words, or the whole item where it is shorter.

1. Every text becomes one array of shingle hashes. Those that occur in an item are found by a hash join
   with the items' distinct shingles and leave the text with their position; texts never move.
2. A window can only reach the threshold if enough of its shingles occur in the item, so windows with
   fewer are dropped at once. The count bounds the shared weight from above: nothing is lost.
3. The windows left get a SimHash of their shingles; further copies of one are numbered first, so that
   a bag is a set of as many hashes. The fingerprint is cut into nine blocks; two within 26 bits differ in
   at most two bits of one block. An item is listed under every value within two bits of each of its blocks
   (multi-probe), so the equi-join of a window with the item that it was found for, on (item, block number,
   block value), reaches everything within the radius.
4. Exact weighted similarity of the full shingle bags, in integers, decides.

At the threshold two bags differ in 15 % of fingerprint bits at the angle of their cosine (0.889), 9.7
of 64 with a deviation of 2.9; the radius of 26 is 5.6 deviations above that.

The benchmark is the small side. Its shingles, bags and listed values are broadcast only if their counted
number is under ``max_broadcast_rows``; above it the same join shuffles. No row of the documents is ever collected.

Defined results: null or blank texts and items have no words and never match; equal items each match;
repeated rows count as one document; an empty table gives no rows; extra columns are ignored. Leaks of
a null doc_id are reported under null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrowed, words_of

SHINGLE, PERCENT, BITS = 5, 80, 64
#: Two fingerprints within the radius differ in at most FLIPS bits of one block at least.
BLOCKS, FLIPS = 9, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1


def _clean_words(text: Column) -> Column:
    return words_of(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", ""))


def _shingles(words: str, k: int) -> Column:
    """Hashes of each k consecutive words of an array column."""
    parts = lambda i: [F.get(words, i + j) for j in range(1, k)]
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *parts(i)))
    return F.when(F.size(words) >= k, F.slice(hashes, F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<bigint>"))


def _simhash(bag: str) -> Column:
    """Majority of each of 64 bits over the bag's hashes, packed into one long."""

    def vote(acc: Column, b: Column) -> Column:
        ones = F.size(F.filter(bag, lambda h: F.getbit(h, b) == 1))
        return acc.bitwiseOR(F.when(2 * ones > F.size(bag), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))

    # (Never null: else every join on it would be preceded by a test that computes it again.)
    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), vote), F.lit(0).cast("bigint"))


def _numbered(bag: str) -> Column:
    """The bag as a set: the second copy of a hash and further ones become hashes of their own."""
    copies = lambda h, i: F.size(F.filter(F.slice(bag, F.lit(1), i), lambda x: x == h))
    each = F.transform(bag, lambda h, i: F.when(copies(h, i) == 0, h).otherwise(F.xxhash64(h, copies(h, i))))
    return F.when(F.size(F.array_distinct(bag)) == F.size(bag), F.col(bag)).otherwise(each)


def _cuts() -> list[tuple[int, int]]:
    """(first bit, last bit + 1) of the blocks that cover all bits."""
    return [(i * BITS // BLOCKS, (i + 1) * BITS // BLOCKS) for i in range(BLOCKS)]


def _masks() -> list[int]:
    """Each block's bits, as signed longs."""
    return [m - (1 << 64) if m >> 63 else m for m in (((1 << (hi - lo)) - 1) << lo for lo, hi in _cuts())]


def _blocks(fingerprint: str, flips: int) -> Column:
    """(block number, block value), exploded: every value within so many bits of the block's own."""

    def cell(i: int, lo: int, hi: int) -> Column:
        value = F.shiftrightunsigned(F.col(fingerprint), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("bigint"))
        near = F.array(*[F.lit(m).cast("bigint") for m in range(1 << (hi - lo)) if m.bit_count() <= flips])
        return F.transform(near, lambda m: F.struct(F.lit(i).alias("no"), value.bitwiseXOR(m).alias("value")))

    return F.explode_outer(F.flatten(F.array(*[cell(i, lo, hi) for i, (lo, hi) in enumerate(_cuts())])))


def decontaminate(
    docs: DataFrame, items: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    max_broadcast_rows: int = 200_000,
) -> DataFrame:
    """doc_id, item_id, start (word of the first leaking window), n_windows, similarity (largest, six digits)."""
    item = narrowed(items, item_col, item_text).select(F.col(item_col).alias("item"), _clean_words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    item = materialize(item.withColumn("k", F.least(F.lit(shingle), F.size("w"))), "items")
    # Widths are at most ``shingle`` numbers: five for short items, usually one.
    widths = sorted(r[0] for r in item.select("k").distinct().collect()) or [shingle]
    by_width = None
    for k in widths:
        part = item.where(F.col("k") == k).select("item", F.size("w").alias("len"), F.lit(k).alias("k"), _shingles("w", k).alias("bag"))
        by_width = part if by_width is None else by_width.unionByName(part)
    item = materialize(by_width.withColumn("numbered", _numbered("bag")).withColumn("item_print", _simhash("numbered")), "item-bags")
    n_shingles, n_items = item.agg(F.coalesce(F.sum(F.size("bag")), F.lit(0)), F.count(F.lit(1))).first()
    hint = lambda rows, x: F.broadcast(x) if rows <= max_broadcast_rows else x

    src = narrowed(docs, id_col, text_col).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def hashed(texts: DataFrame, *keep: str) -> DataFrame:
        out, words = None, texts.withColumn("w", _clean_words(F.col("text")))
        for k in widths:
            part = words.select("doc", *keep, F.lit(k).alias("k"), _shingles("w", k).alias("all"), (F.size("w") - (k - 1)).alias("total"))
            out = part if out is None else out.unionByName(part)
        return out

    # Positions of shingles that some item holds, with the items that hold them.
    holders = item.select("item", "len", "k", F.explode(F.array_distinct("bag")).alias("h"))
    # (The outer form: else the optimizer tests the array's size below, which computes every hash twice.)
    hits = hashed(src).select("doc", "k", "total", F.posexplode_outer("all").alias("pos", "h")).join(hint(n_shingles, holders), ["k", "h"])
    spots = hits.groupBy("doc", "item", "len", "k", "total").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # Windows [s, s + m) of shingle positions, m = n = len - k + 1 or the whole of a shorter text: at least
    # ceil(p(m + n) / (100 + p)) must be hits.
    n = F.col("len") - F.col("k") + 1
    need = F.ceil(percent * (F.col("m") + F.col("n")) / F.lit(100 + percent)).cast("int")
    spots = spots.withColumn("n", n).withColumn("m", F.least("n", "total")).withColumn("need", need).where(F.size("at") >= F.col("need"))
    # A window that holds ``need`` hits starts within m - need positions before some hit with need - 1 hits after it.
    first = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + F.col("need") - 1) - p < F.col("m"), F.lit(False)))
    starts = F.array_distinct(F.flatten(F.transform(first, lambda p: F.sequence(F.greatest(F.lit(0), p - (F.col("m") - F.col("need"))), p))))
    windows = spots.where(F.size(first) > 0).select("doc", "item", "k", "len", "n", "m", F.explode_outer(starts).alias("start")).distinct()
    per_doc = windows.groupBy("doc").agg(F.collect_set(F.struct("item", "k", "len", "n", "m", "start")).alias("windows")).withColumnRenamed("doc", "leaky")
    texts = src.join(per_doc, src["doc"].eqNullSafe(per_doc["leaky"])).select("doc", "text", "windows")
    bags = hashed(texts, "windows").select("doc", "k", "all", "total", F.explode_outer("windows").alias("x"))
    bags = bags.where((F.col("x.k") == F.col("k")) & (F.col("x.m") == F.least("x.n", "total")))  # (rows of one doc may differ in length)
    bags = bags.select("doc", *[F.col(f"x.{c}").alias(c) for c in ("item", "start", "n", "m")], F.slice("all", F.col("x.start") + 1, F.col("x.m")).alias("bag")).where(F.size("bag") == F.col("m"))
    prints = bags.withColumn("numbered", _numbered("bag")).drop("bag").withColumn("print", _simhash("numbered"))
    a = prints.withColumn("b", _blocks("print", 0)).select("*", F.col("b.no").alias("no"), F.col("b.value").alias("value")).drop("b")
    b = item.select("item", "item_print", _blocks("item_print", FLIPS).alias("b")).select("item", "item_print", F.col("b.no").alias("no"), F.col("b.value").alias("value"))
    probes = sum(1 for lo, hi in _cuts() for m in range(1 << (hi - lo)) if m.bit_count() <= FLIPS)
    pairs = a.join(hint(n_items * probes, b), ["item", "no", "value"]).withColumn("x", F.col("print").bitwiseXOR(F.col("item_print"))).where(F.bit_count("x") <= RADIUS)
    # The first block that agrees so far alone reports a pair: no set of pairs is kept to find repeats.
    masks = F.array(*[F.lit(m).cast("bigint") for m in _masks()])
    pairs = pairs.where(~F.exists(F.slice(masks, F.lit(1), F.col("no")), lambda m: F.bit_count(F.col("x").bitwiseAND(m)) <= FLIPS))
    # (Bags, which may be long, join once a pair, not once a listed value.)
    pairs = pairs.join(hint(n_shingles, item.select("item", F.col("numbered").alias("item_bag"))), "item")
    shared = F.size(F.array_intersect("numbered", "item_bag"))
    scored = pairs.withColumn("shared", shared).withColumn("all_weight", F.col("m") + F.col("n") - F.col("shared")).where(100 * F.col("shared") >= percent * F.col("all_weight"))
    return scored.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(
        F.min("start").cast("long").alias("start"),
        F.countDistinct("start").alias("n_windows"),
        F.max(F.floor(F.lit(1_000_000) * F.col("shared") / F.col("all_weight")) / 1_000_000).alias("similarity"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
