"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage takes all that its predecessor kept, and all but the last return the columns of documents.

Defined results, beside those of each operator: null texts go in the first stage; rows of one doc_id are one
document to near-dedup (the first of its component keeps all its rows) and to decontamination (all go or stay),
and each is judged alone by the others; rows without a doc_id are never near duplicates; an empty table passes
through every stage; columns beside those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.llm import bpe, decontaminate, line_dedup, minhash, quality
from loomlens.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged."""
    return quality.quality_rules(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five or more share; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, keep=COLUMNS)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near duplicates (five-word shingles, similarity 0.8); null ids stay."""
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    gone = materialize(found.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct(), "near-duplicates")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = docs.select(*COLUMNS)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items).select(F.col("doc_id").alias("leaky")).distinct()
    return docs.join(materialize(found, "leaks"), docs["doc_id"].eqNullSafe(F.col("leaky")), "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, its number of tokens and digests of the ids and of the text decoded from them."""
    return bpe.map_tokens(docs, bpe.digests, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", token_stage),
]

#: Token ids are beyond SQL; tests compare run() with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
