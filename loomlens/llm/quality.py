"""Quality rules [native]: one projection compiled from a threshold table, no user functions, no shuffle.

``RULES`` lists ratios of two counted columns with a lowest and highest value in thousandths.
``quality_rules`` counts every column once per document and turns the table into one boolean.
All tests are on integers, so every engine agrees on ties.

Defined results: a null or blank text has no words, fails ``n_words < 50`` and is not kept; a rule
whose divisor is 0 passes; repeated rows are each judged alone; an empty table gives no rows; extra
columns are ignored unless kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrowed, words_of

SYMBOLS = r"[#*$%&|<>]"
CAPITALS = "[A-ZÀ-ÖØ-Þ]"

#: Stop words of the corpus languages (en, fr, de, es), ASCII-lower-cased.
STOP_WORDS = tuple(
    "the of and to a in is it that for on as with was by an be this from or are at not "
    "de la le et les des un une du que qui en dans pour pas sur par au est avec elle "
    "der die und das den von zu mit ist im dem nicht ein eine für auf sich auch es als an "
    "el los las se del con no su para al lo como más o y".split()
)

#: (name, counted column, divisor column, least, most), bounds in thousandths of the divisor.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 2_000, 15_000),
    ("symbols_per_word", "n_symbols", "n_words", 0, 150),
    ("shouts_per_word", "n_shouts", "n_words", 0, 250),
    ("capital_share", "n_capitals", "word_chars", 0, 400),
    ("stop_word_share", "n_stop_words", "n_words", 40, 1_000),
    ("duplicate_line_share", "n_dup_lines", "n_lines", 0, 500),
    ("cut_line_share", "n_cut_lines", "n_lines", 0, 300),
)


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean expression over integer columns."""
    out = F.lit(True)
    for _, num, den, low, high in rules:
        n, d = F.col(num) * 1000, F.col(den)
        out = out & ((d == 0) | ((n >= low * d) & (n <= high * d)))
    return out


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """Every count that a rule may use, one row per document."""
    count = lambda c: F.col(c).cast("long")
    df = narrowed(docs, *dict.fromkeys((id_col, text_col, *keep))).withColumn("__t", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    df = df.withColumn("__w", words_of(F.col("__t"))).withColumn("__l", F.split("__t", "\n"))
    df = df.withColumn("__n", F.size("__w")).withColumn("__lw", F.filter("__l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Hashes of the three-word windows; most texts repeat none and stop here.
    tri = F.transform("__w", lambda w, i: F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)))
    df = df.withColumn("__tri", F.when(F.col("__n") > 2, F.slice(tri, F.lit(1), F.col("__n") - 2)).otherwise(F.array().cast("array<bigint>")))
    # Sorted (hash, position): windows beside an equal hash repeat, and their words are counted once each.
    repeats = F.size("__tri") > F.size(F.array_distinct("__tri"))
    df = df.withColumn("__s", F.when(repeats, F.sort_array(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hit = F.filter("__s", lambda x, i: F.coalesce(F.get("__s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__s", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("__p", F.sort_array(F.transform(hit, lambda x: x["i"])))
    steps = F.transform("__p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("__p", i + 1) - p, F.lit(3))))
    stop = F.filter("__w", lambda w: F.lower(w).isin(*STOP_WORDS))
    counts = F.struct(
        count("__n").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lw") - F.size(F.array_distinct("__lw"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.regexp_count("__t", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("__t", F.lit(CAPITALS)).cast("long").alias("n_capitals"),
        F.size(stop).cast("long").alias("n_stop_words"),
        F.size(F.filter("__lw", lambda x: x.rlike("(\\.\\.\\.|…)$"))).cast("long").alias("n_cut_lines"),
    )
    # The counts come out of a generator, which the optimizer neither moves filters through nor writes into
    # what uses them: else a filter on the verdict would hold every count as often as rules and counts name it.
    kept = [F.col(f"`{c}`") for c in dict.fromkeys((id_col, *keep))]
    return df.select(*kept, F.inline_outer(F.array(counts)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, keep: tuple = ()) -> DataFrame:
    """Counts, ``base_failed`` and the verdict ``kept`` of every document."""
    df = quality_metrics(docs, id_col, text_col, keep)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    rule = " AND ".join(f"({d} = 0 OR (1000 * {n} >= {lo} * {d} AND 1000 * {n} <= {hi} * {d}))" for _, n, d, lo, hi in RULES)
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '{ws}+'), lambda x: x <> '') AS w,
         string_split(coalesce(text, ''), chr(10)) AS l,
         row_number() OVER () AS r
  FROM documents),
lines AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lw FROM base),
tri AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM hit, (VALUES (0), (1), (2)) v(k)) GROUP BY r),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lw) - len(list_distinct(lw)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts,
         len(regexp_extract_all(t, '{CAPITALS}'))::BIGINT AS n_capitals,
         len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
         len(list_filter(lw, lambda x: regexp_matches(x, '(\.\.\.|…)$')))::BIGINT AS n_cut_lines
  FROM lines LEFT JOIN rep USING (r)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {rule}) AS kept
FROM judged"""


OP4_SQL = _sql()
