"""Module resolution: raw requires joined with the files by an ordered list of candidate paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scope import first_candidate


def normal_path(path: Column) -> Column:
    """Without '.' and with '..' taken back; parts that lead above the root stay."""
    step = lambda acc, p: (
        F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(path: str, specifier: str) -> Column:
    """Paths to try, best first. An ``init`` file stands for its folder and looks from the parent."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    is_init = F.col(path).rlike(r"(^|/)init\.luau?$")
    module = F.when(is_init, folder).otherwise(F.regexp_replace(path, r"\.luau?$", ""))
    base = F.when(is_init, F.regexp_replace(folder, r"/?[^/]*$", "")).otherwise(folder)
    own = F.col(specifier).startswith("@self/")
    spec = F.when(own, F.substring(specifier, 7, 1_000_000)).otherwise(F.col(specifier))
    full = F.when(F.col(specifier).startswith("/"), F.col(specifier)).otherwise(F.concat_ws("/", F.when(own, module).otherwise(base), spec))
    full = normal_path(full)
    return F.when(full.rlike(r"\.luau?$"), F.array(full)).otherwise(F.array(*[F.concat(full, F.lit(x)) for x in (".luau", ".lua", "/init.luau", "/init.lua")]))


def edges(extracted: DataFrame, all_files: DataFrame) -> DataFrame:
    """(from, seq, kind, specifier, to, line): every require, ``to`` null where nothing matches."""
    raw = extracted.select(F.col("path").alias("from"), F.inline("requires"))
    tried = raw.where("kind = 'string_literal'").select("from", "seq", F.posexplode(candidates("from", "specifier")).alias("rank", "to"))
    hit = first_candidate(tried, all_files.select(F.col("path").alias("to")), ["from", "seq"], "rank", "to").drop("rank")
    return raw.join(hit, ["from", "seq"], "left").select("from", "seq", "kind", "specifier", "to", "line")
