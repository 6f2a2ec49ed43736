"""Switches of behaviour found in the text of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (kind, name where none is quoted, what a lower-cased line holds), the first of a line first.
RULES = (
    ("identifier", "feature", ("featureflag", "feature_flag", "isfeatureenabled", "isenabled(")), ("get_attribute", "attribute", ("getattribute",)),
    ("settings_gate", "settings", ("settings.", "usersettings")), ("env_lookup", "env", ("getenv", "process.env")),
)


def text_flags(files: DataFrame, path: str = "path", source: str = "source") -> DataFrame:
    """(path, line, kind, name, detail, seq) of every rule that a line meets; ``seq`` orders them. One scan for all rules."""
    lines = files.select(F.col(path).alias("path"), F.posexplode_outer(F.split(source, "\r?\n")).alias("i", "s")).withColumn("low", F.lower("s"))
    quoted = F.coalesce(*[F.nullif(F.regexp_extract("s", p, 1), F.lit("")) for p in ('"([^"]+)"', "'([^']+)'")])
    cells = []
    for i, (kind, other, words) in enumerate(RULES):
        test = F.col("low").contains(words[0])
        for w in words[1:]:
            test |= F.col("low").contains(w)
        cells.append(F.when(test, F.struct(F.lit(kind).alias("kind"), F.coalesce(quoted, F.lit(other)).alias("name"), F.lit(i).alias("rule"))))
    hits = lines.select("path", (F.col("i") + 1).alias("line"), F.trim("s").alias("detail"), F.explode_outer(F.array_compact(F.array(*cells))).alias("h")).where("h IS NOT NULL")
    return hits.select("path", "line", "h.kind", "h.name", "detail", F.struct(F.lit(0).alias("a"), F.col("line").alias("b"), F.col("h.rule").alias("c")).alias("seq"))


def first_of_each(hits: DataFrame) -> DataFrame:
    """The first hit of each name in a line."""
    first = F.row_number().over(Window.partitionBy("path", "line", "name").orderBy("seq"))
    return hits.withColumn("_n", first).where("_n = 1").drop("_n")
