"""Clones: repeated token windows, groups of equal spans, covered lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..session import materialize


def _hashed(df: DataFrame, key: str, tokens: str | Column, m: int, *more: str) -> tuple[DataFrame, Callable]:
    """Rows of at least m tokens as hashes of 1, 2, 4 ... tokens from each place, and the hashes that n tokens from a place consist of."""
    t = df.select(F.col(key).alias(key), *more, F.transform(tokens, lambda x: F.xxhash64(x)).alias("_1")).where(F.size("_1") >= m)
    power = 1
    while 2 * power <= m:
        t = t.withColumn(f"_{2 * power}", _doubled(f"_{power}", power))
        power *= 2

    def parts(i: Column, n: int) -> list[Column]:
        step, at, out = power, 0, []
        while at < n:
            while at + step > n:
                step //= 2
            out.append(F.get(f"_{step}", i + at))
            at += step
        return out

    return t, parts


def _doubled(column: str, power: int):
    return F.transform(column, lambda x, i: F.xxhash64(x, F.get(column, i + power)))


def _lesser(column: str, power: int):
    return F.transform(column, lambda x, i: F.least(x, F.get(column, i + power)))


def windows(df: DataFrame, key: str, tokens: str | Column, m: int, within: str) -> DataFrame:
    """(key, pos, h, g) of m consecutive tokens in the runs of array<struct<first,n>> ``within``: 96 bits of hash by doubling, a few
    steps a token whatever m; the tokens stay behind."""
    t, parts = _hashed(df, key, tokens, m, within)
    both = F.transform(_places(within), lambda i: F.struct(i.alias("pos"), F.xxhash64(*parts(i, m)).alias("h"), F.hash(*parts(i, m)).alias("g")))
    return t.select(key, F.inline_outer(both))


def _places(within: str) -> Column:
    return F.flatten(F.transform(within, lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))


def runs(df: DataFrame, key: str, tokens: str | Column, m: int) -> DataFrame:
    """(key, pick, sig, first, n) of every run of n windows from ``first`` that share a pick, about two runs to m / 2 windows.

    A window's pick is the place of its least gram of about m / 2 tokens, the leftmost of equal ones. Equal windows pick equal grams,
    and at different places if they are different windows: a window can only repeat where the gram of its pick is picked at
    two places. ``pick`` is the gram's hash. ``sig`` is one of all tokens of the run, as its first and last window overlap.
    """
    width = 1
    while 2 * width <= (m + 2) // 2:
        width *= 2
    gram, place = m - width + 1, (1 << 31) - 1
    t, parts = _hashed(df, key, tokens, m)
    grams = F.transform(F.sequence(F.lit(0), F.size("_1") - gram), lambda i: F.xxhash64(*parts(i, gram)).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("bigint")))
    t, power = t.withColumn("_p1", grams), 1
    while power < width:
        t = t.withColumn(f"_p{2 * power}", _lesser(f"_p{power}", power))
        power *= 2
    picks = f"_p{width}"
    heads = F.filter(F.sequence(F.lit(0), F.size("_1") - m), lambda i: (i == 0) | (F.get(picks, i) != F.get(picks, i - 1)))
    t = t.withColumn("_s", heads)
    t = t.withColumn("_r", F.transform("_s", lambda x, j: F.struct(x.alias("b"), (F.coalesce(F.get("_s", j + 1), F.size("_1") - m + 1) - 1).alias("e"), F.get(picks, x).bitwiseAND(F.lit(place)).cast("int").alias("p"))))
    found = F.transform("_r", lambda r: F.struct(
        F.xxhash64(*parts(r["p"], gram)).alias("pick"), F.xxhash64(*parts(r["b"], m), *parts(r["e"], m), r["e"] - r["b"]).alias("sig"), r["b"].alias("first"), (r["e"] - r["b"] + 1).alias("n"),
    ))
    return t.select(key, F.inline_outer(found))


def repeated_windows(df: DataFrame, key: str, tokens: str | Column, m: int) -> DataFrame:
    """(window_md5, n) of the windows that occur more than once; ``key`` names each row.

    Runs of windows are shuffled, not windows. Equal runs are counted first and spelt out at one place only, and only
    where another run has the same pick; what is spelt out is counted by its md5. ``tokens`` may be an expression over df, then
    df's columns are shuffled and not their tokens.
    """
    same = F.col("first").cast("bigint") * (m + 1) + F.col("n")  # a run has at most m windows
    kinds = runs(df, key, tokens, m).select(key, "pick", "sig", same.alias("span")).groupBy("pick", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias(key), F.min_by("span", key).alias("span"))
    kinds = kinds.withColumn("total", F.sum("n").over(Window.partitionBy("pick"))).where("total > 1")
    first, length = F.floor(F.col("span") / (m + 1)).cast("int"), (F.col("span") % (m + 1)).cast("int")
    places = kinds.groupBy(key).agg(F.collect_list(F.struct(first.alias("first"), length.alias("length"), "n")).alias("places"))
    t = df.join(places, key).select("places", F.col(tokens).alias("_t") if isinstance(tokens, str) else tokens.alias("_t"))
    md5 = lambda i: F.unhex(F.md5(F.array_join(F.slice("_t", i + 1, F.lit(m)), " ")))
    spelt = F.flatten(F.transform("places", lambda x: F.transform(F.sequence(x["first"], x["first"] + x["length"] - 1), lambda i: F.struct(md5(i).alias("w"), x["n"].alias("n")))))
    found = t.select(F.inline_outer(spelt)).groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    return found.select(F.lower(F.hex("w")).alias("window_md5"), "n")


def covered_lines(ranges: DataFrame, path: str, first: str, last: str) -> DataFrame:
    """Lines of each path that some inclusive range covers. Ranges are merged in order, not exploded:
    a line is counted by the range that reaches it first."""
    w = Window.partitionBy(path).orderBy(first, last)
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.where(F.col(last) >= F.col(first)).withColumn("_b", F.coalesce(before, F.col(first) - 1))
    fresh = F.greatest(F.lit(0), F.col(last) - F.greatest(F.col("_b"), F.col(first) - 1))
    return r.groupBy(path).agg(F.sum(fresh).cast("long").alias("duplicated_lines"))


SPANS = "array<struct<file_idx:int,start_line:int,end_line:int>>"
PAIRS = f"k long, fingerprint string, token_count int, line_count int, instances {SPANS}, edge struct<part:long,side:int,file_idx:int,tail:array<string>,starts:array<int>,ends:array<int>>"
#: Suffixes that a task compares at once.
STRIDE = 1024


def fingerprints(keys: list[bytes]) -> list[str]:
    """FNV-1a (32 bits) of each key, all keys a byte at a time."""
    order = sorted(range(len(keys)), key=lambda i: -len(keys[i]))
    lens = np.array([len(keys[i]) for i in order], np.int64)
    raw, at = np.frombuffer(b"".join(keys[i] for i in order), np.uint8), np.cumsum(lens) - lens
    h = np.full(len(keys), 2_166_136_261, np.uint32)
    for j in range(int(lens[0]) if len(lens) else 0):
        n = np.searchsorted(-lens, -j)  # keys longer than j
        h[:n] = (h[:n] ^ raw[at[:n] + j]) * np.uint32(16_777_619)
    out = [""] * len(keys)
    for i, x in zip(order, h.tolist()):
        out[i] = f"dup:{x:08x}"
    return out


def fingerprint(tokens: list) -> str:
    """FNV-1a (32 bits) of the tokens with zero bytes between them."""
    return fingerprints(["\0".join(tokens).encode()])[0]


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """b with buffers of its own, so that offsets begin at 0."""
    return pa.RecordBatch.from_arrays([c.take(pa.array(range(len(c)))) for c in b.columns], b.schema.names)


def _neighbours(m: int, min_lines: int, across: bool):
    """Suffixes in order to the pairs of neighbours that share at least m tokens.

    Neighbours in one file that overlap in lines must begin at least min_lines apart. Each task also returns its
    first and last suffix as edges; ``across`` then pairs the edges of different tasks.
    """
    schema = to_arrow_schema(_parse_datatype_string(PAIRS))  # (this needs the driver)

    def pairs(b: pa.RecordBatch, first: int) -> tuple[list, list]:
        """Rows of neighbours in b, the first of them numbered ``first``, and what their fingerprints are of."""
        lists = {c: b.column(c) for c in ("tail", "starts", "ends")}
        at = lists["tail"].offsets.to_numpy()
        words = lists["tail"].values
        codes = words.dictionary_encode().indices.to_numpy()
        begin, end = (lists[c].values.to_numpy() for c in ("starts", "ends"))
        files, parts, out, keys = b.column("file_idx").to_numpy(), b.column("part").to_numpy(), [], []
        for i in range(len(at) - 2):
            x, y, n = at[i], at[i + 1], min(at[i + 1] - at[i], at[i + 2] - at[i + 1])
            if across == (parts[i] == parts[i + 1]):
                continue
            other = codes[x : x + n] != codes[y : y + n]
            n = int(other.argmax()) if other.any() else int(n)
            if n < m:
                continue
            if files[i] == files[i + 1] and begin[x + n - 1] >= begin[y] and begin[y + n - 1] >= begin[x] and abs(int(begin[x]) - int(begin[y])) < min_lines:
                continue
            spans = [(int(files[r]), int(begin[o]), int(end[o + n - 1])) for r, o in ((i, x), (i + 1, y))]
            lines = [e - s + 1 for _, s, e in spans]
            if min(lines) < min_lines:
                continue
            k = int(parts[i + 1]) << 33 | (0 if across else first + i)
            out.append({"k": k, "token_count": n, "line_count": max(lines), "instances": [dict(zip(("file_idx", "start_line", "end_line"), s)) for s in spans], "edge": None})
            keys.append("\0".join(words[x : x + n].to_pylist()).encode())
        return out, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        edge = lambda b, i, side: {c: v[0] for c, v in b.slice(i, 1).to_pydict().items()} | {"side": side}
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIDE):
                b = batch.slice(lo, STRIDE)
                if not across:
                    b = pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int64()), *b.columns], ["part", *b.schema.names])
                whole = b if last is None else pa.concat_batches([last, b])
                out, keys = pairs(_packed(whole), max(seen, 1))
                for row, f in zip(out, fingerprints(keys), strict=True):
                    row["fingerprint"] = f
                if last is None and not across:
                    out.append({"edge": edge(b, 0, 0)})
                last, seen = b.slice(b.num_rows - 1, 1), seen + b.num_rows
                yield pa.RecordBatch.from_pylist(out, schema)
        if last is not None and not across:
            yield pa.RecordBatch.from_pylist([{"edge": edge(last, 0, 1)}], schema)

    return run


def numbered(paths: DataFrame) -> DataFrame:
    """(path, file_idx): places in order of path components, counted by ranges; one number a range is summed in order."""
    parts = F.split("path", "/")
    dealt = paths.select("path").repartitionByRange(parts).sortWithinPartitions(parts)
    dealt = materialize(dealt.select("path", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "numbered")
    base = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(base), "part").select("path", (F.col("base") + F.col("i")).cast("int").alias("file_idx"))


def clone_groups(files: DataFrame, min_tokens: int = 30, min_lines: int = 5, min_occurrences: int = 2) -> DataFrame:
    """files(path, tokens array<struct<text,line,end_line>>) to fingerprint, token_count, line_count, instances.

    Suffixes that share ``min_tokens`` tokens share a window hash, so hashes that occur once are dropped by a
    count before any suffix leaves its file; windows whose pick occurs once are not even counted. What two suffixes share ends within the run of repeated windows that
    they begin in, so a suffix is cut one token behind its run: no two are equal then, and their order is that of
    a suffix array of the whole project. They are sorted by ranges of all suffixes and not by window, so a window
    in every file is spread over tasks, each of which streams over its neighbours and holds two suffixes and a
    batch. The driver sees a sample of suffixes for the ranges.
    """
    if min_tokens < 1 or min_lines < 1 or min_occurrences < 2:
        raise ValueError("min_tokens and min_lines must be positive, min_occurrences at least 2")
    files = files.join(numbered(files), "path")
    t = files.select("file_idx", "path", F.transform("tokens", lambda x: x["text"]).alias("texts"), F.transform("tokens", lambda x: x["line"]).alias("starts"), F.transform("tokens", lambda x: x["end_line"]).alias("ends"))
    r = runs(t, "file_idx", "texts", min_tokens)
    twice = r.groupBy("pick").agg(F.count(F.lit(1)).alias("x")).where("x > 1").select("pick")
    within = r.join(twice, "pick").groupBy("file_idx").agg(F.collect_list(F.struct("first", "n")).alias("within"))
    w = materialize(windows(t.join(within, "file_idx"), "file_idx", "texts", min_tokens, "within"), "windows")
    seeds = w.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    hit = w.join(seeds, ["h", "g"]).select("file_idx", "pos")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("file_idx").orderBy("pos"))
    hit = hit.withColumn("run", run).withColumn("last", F.max("pos").over(Window.partitionBy("file_idx", "run")))
    hit = materialize(hit.select("file_idx", "pos", "last"), "repeats").join(t, "file_idx")
    # The end of a file is a token of its own; two files' ends differ.
    closed = F.concat("texts", F.array(F.concat(F.lit("\0EOF:"), F.col("file_idx").cast("string"))))
    cut = lambda c: F.slice(c, F.col("pos") + 1, F.col("last") - F.col("pos") + min_tokens + 1)
    tails = hit.select("file_idx", cut(closed).alias("tail"), *[cut(F.concat(c, F.array(F.lit(0)))).alias(c) for c in ("starts", "ends")])
    tails = tails.repartitionByRange("tail").sortWithinPartitions("tail")
    found = materialize(tails.mapInArrow(_neighbours(min_tokens, min_lines, False), PAIRS), "clone-pairs")
    # Two suffixes a task.
    edges = found.where("edge IS NOT NULL").select("edge.*").coalesce(1).sortWithinPartitions("part", "side")
    pairs = found.where("edge IS NULL").unionByName(edges.mapInArrow(_neighbours(min_tokens, min_lines, True), PAIRS))
    names = files.select("file_idx", "path")
    # As many tokens, ends of files among them, as two clones have: else there are none.
    enough = files.agg((F.floor((F.coalesce(F.sum(F.size("tokens")), F.lit(0)) + F.count(F.lit(1))) / 2) >= min_tokens).alias("enough")).where("enough")
    flat = pairs.select("fingerprint", "k", "token_count", "line_count", F.posexplode("instances").alias("side", "i")).select("fingerprint", "k", "token_count", "line_count", "side", "i.*").join(names, "file_idx")
    inst = F.struct("k", "side", F.struct("path", "start_line", "end_line").alias("i"))
    longest = F.struct(-F.col("token_count"), F.col("k"))
    g = flat.groupBy("fingerprint").agg(F.max("token_count").alias("token_count"), F.min_by("line_count", longest).alias("line_count"), F.array_sort(F.collect_list(inst)).alias("x"))
    g = g.withColumn("instances", F.array_distinct(F.transform("x", lambda r: r["i"]))).drop("x")
    return g.where(F.size("instances") >= min_occurrences).crossJoin(enough).drop("enough")  # enough is one row or none
