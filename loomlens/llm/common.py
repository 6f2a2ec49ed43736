"""Shared helpers: schema hygiene, shared-folder tables and components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every contract: \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrowed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones never matter."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def integer_key(df: DataFrame, column: str) -> Column:
    """An id column as long; ids of other types are refused, as a cast would make nulls of them."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{column} must be an integer, not {kind.simpleString()}")
    return F.col(f"`{column}`").cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words_of(c: Column) -> Column:
    """Maximal runs of non-white-space; null or blank text gives an empty array."""
    s = strip_ws(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_CLASS + "+"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where none is set and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints/loomlens"
    return base.rstrip("/")


#: Folders written by this process and not yet deleted.
_WRITTEN: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    _WRITTEN.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df from the shared folder, where it is written once, and its path: the lineage ends there, safe if executors die."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once. Results read the folder when they are used, so it stays until ``release``."""
    return written(df, tag)[0]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of ours through Hadoop's own file system layer, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def release(spark: SparkSession) -> int:
    """Delete every folder that this process has written so far; call it when the results are stored elsewhere."""
    paths = list(_WRITTEN)
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds, which need a number of rounds logarithmic in the
    longest path; each round's edges are written to the shared folder, and those of the round before
    deleted. A hub of any degree is only ever one side of an equi-join, which adaptive execution can split.
    Loops and repeated edges are harmless; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    cur, path = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "cc-edges"
    )

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        return tuple(r)

    seen, settled = mark(cur), False
    while seen[0] and not settled:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (
            both.join(low, both.a == low.u)
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a > b")
            .distinct()
        )
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        joined = large.join(low2, large.a == low2.u)
        small = (
            joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a > b")
            .distinct()
        )
        before = path
        cur, path = written(small, "cc-edges")
        delete_path(spark, before)
        now = mark(cur)
        settled, seen = now == seen, now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
