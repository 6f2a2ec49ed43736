"""Line dedup [native]: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

A line's key is the line stripped of white space at both ends with A-Z lower-cased. Only keys of at
least ``min_chars`` code points are exploded, as 128-bit hashes with positions, and written once: line texts
never leave their document. The distinct count runs in two partial steps, so a line that a third of all
documents hold is summed before it meets. Of the keys that are frequent enough, the ``heavy`` most frequent
(a fixed number of rows of 24 bytes) are broadcast, the others are joined by a shuffle; no key that is
not heavy can be large, as it has a smaller share than each of them.

Defined results: a null or empty text is one empty line, which is too short to go; repeated rows of
one doc_id are one document (the largest id keeps its lines in all of them); null doc_ids count as one
document that is smaller than any other; an empty table gives no rows; extra columns are ignored unless
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrowed, strip_ws

HEAVY = 50_000


def key_hash(key: Column) -> Column:
    """128 bits that are equal for keys that differ in the case of A-Z alone.

    The bytes are read as Latin-1 before lower-casing, which runs much faster than a translation by
    characters. Besides A-Z this moves the bytes that lead two others or one (C0-DE by 20 hex); which it was is told by
    the bytes that follow, so no two keys become equal by it.
    """
    return F.unhex(F.md5(F.lower(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"))))


def key_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, pos, h): the hash of each line whose key is long enough; ``row`` tells texts of one id apart."""
    lines = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("pos", "line"))
    # The cheap length test comes first: a key is never longer than its line.
    lines = lines.where(F.char_length("line") >= min_chars).withColumn("key", strip_ws(F.col("line")))
    return lines.where(F.char_length("key") >= min_chars).select("doc", "row", "pos", key_hash(F.col("key")).alias("h"))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(doc, row, lost): the 0-based lines that each text loses, in order."""
    lines = materialize(key_lines(docs, min_chars, id_col, text_col), "lines")
    frequent = (
        lines.groupBy("h").agg(F.countDistinct(F.struct("doc")).alias("n"), F.max("doc").alias("last"))
        .where(F.col("n") >= min_docs)
    )
    frequent = materialize(frequent, "frequent-lines")
    top = materialize(frequent.orderBy(F.col("n").desc(), "h").limit(heavy).select("h", "last"), "heavy-lines")
    lost = lines.join(F.broadcast(top), "h")
    if frequent.count() > heavy:
        rest = frequent.select("h", "last").join(F.broadcast(top.select("h")), "h", "left_anti")
        lost = lost.unionByName(lines.join(F.broadcast(top.select("h")), "h", "left_anti").join(rest, "h"))
    lost = lost.where(~F.col("doc").eqNullSafe(F.col("last")))
    return lost.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("lost"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), heavy: int = HEAVY) -> DataFrame:
    """id, kept columns, ``text`` without the dropped lines, ``n_lines`` before, ``n_dropped``."""
    docs = narrowed(docs, *dict.fromkeys((id_col, text_col, *keep)))
    lost = dropped_lines(docs, min_chars, min_docs, id_col, text_col, heavy).toDF("__doc", "__row", "__lost")
    joined = docs.withColumn("__of", F.xxhash64(F.col(f"`{text_col}`"))).join(lost, docs[f"`{id_col}`"].eqNullSafe(lost["__doc"]) & (F.col("__of") == F.col("__row")), "left")
    joined = joined.withColumn("__lines", F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n"))
    # The runs of lines between those that go, one slice each: time in proportion to the lines.
    behind = lambda p, i: F.slice("__lines", p + 2, F.coalesce(F.get("__lost", i), F.size("__lines")) - p - 1)
    stays = F.array_join(F.flatten(F.transform(F.concat(F.array(F.lit(-1)), "__lost"), behind)), "\n")
    return joined.select(
        F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep if c not in (id_col, text_col)],
        F.when(F.col("__lost").isNull(), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).otherwise(stays).alias(text_col),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id, r"""
