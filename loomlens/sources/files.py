"""Source trees as DataFrames."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import is_test_path

NOISE = ("node_modules", ".git", "target", "Packages", "ServerPackages")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """files(path, source, mtime, is_test) under root: any store that Spark reads; filters come before contents."""
    if "://" not in root:
        root = str(Path(root).resolve())
        if not Path(root).is_dir():
            raise FileNotFoundError(root)
        if not any(Path(root).rglob("*.lua*")):
            return spark.createDataFrame([], "path string, source string, mtime timestamp, is_test boolean")
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{lua,luau}").load(root)
    plain = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^file:/*", "/") if "://" not in root else F.col("path")
    b = b.withColumn("path", F.substring(plain, len(root.rstrip("/")) + 2, 1_000_000))
    b = b.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*NOISE)))
    return b.select("path", F.decode("content", "UTF-8").alias("source"), F.col("modificationTime").alias("mtime"), is_test_path(F.col("path")).alias("is_test"))


def from_pairs(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    """files from (path, source), for trees that lie in no folder."""
    df = spark.createDataFrame(sorted(pairs.items()), "path string, source string")
    return df.withColumn("mtime", F.lit(None).cast("timestamp")).withColumn("is_test", is_test_path(F.col("path")))
