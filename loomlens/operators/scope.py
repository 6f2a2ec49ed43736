"""Scoping findings: zones, suppression markers, changed paths, baselines, attribution to a base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zone_violations(edges: DataFrame, members: DataFrame, allowed: DataFrame) -> DataFrame:
    """edges(src, dst), members(node, zone), allowed(zone, target): edges into a zone that is not allowed.

    Zones are a configuration: their tables are left to the optimizer, which broadcasts small ones.
    """
    a = members.select(F.col("node").alias("src"), F.col("zone").alias("from_zone"))
    b = members.select(F.col("node").alias("dst"), F.col("zone").alias("to_zone"))
    pairs = edges.join(a, "src").join(b, "dst").where("from_zone <> to_zone")
    ok = allowed.select(F.col("zone").alias("from_zone"), F.col("target").alias("to_zone"))
    return pairs.join(ok, ["from_zone", "to_zone"], "left_anti")


FAMILY = ("complexity", "high-complexity")
CLONES = ("duplication", "clone", "code-duplication")


def plain_kind(kind: Column) -> Column:
    """Rule names without a name space in front, with dashes."""
    return F.translate(F.regexp_replace(kind, "^(?:[a-z][a-z-]*/)+", ""), "_", "-")


def suppressed(findings: DataFrame, markers: DataFrame, path: str = "path", line: str = "line", kind: str = "kind") -> DataFrame:
    """Findings that no marker (path, line, level, kind) covers: two anti-joins, one for files, one for lines."""
    m = markers.select("path", "level", F.col("line").alias("mline"), F.explode(F.split("kind", r"[,\s]+")).alias("k")).withColumn("k", plain_kind(F.col("k")))
    own = plain_kind(findings[kind])
    f = findings.withColumn("_kind", own)
    match = (
        (F.col("k") == "all") | (F.col("k") == F.col("_kind")) | (F.col("k").isin(*FAMILY) & F.col("_kind").contains("complexity"))
        | ((F.col("k") == "coverage-gaps") & (F.col("_kind") == "high-crap")) | (F.col("k").isin(*CLONES) & (F.col("_kind") == "duplicates"))
    )
    files = m.where("level = 'file'").select(F.col("path").alias("mpath"), "k")
    lines = m.where("level <> 'file'").select(F.col("path").alias("mpath"), (F.col("mline") + 1).alias("target"), "k")
    f = f.join(files, (f[path] == F.col("mpath")) & match, "left_anti")
    return f.join(lines, (f[path] == F.col("mpath")) & (f[line] == F.col("target")) & match, "left_anti").drop("_kind")


def introduced(current: DataFrame, base: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """current with ``introduced``: the first n of a key, n its count in the base, are inherited."""
    counts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    j = current.alias("c").join(counts.alias("b"), cond, "left").select("c.*", F.coalesce("b._n", F.lit(0)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return j.withColumn("introduced", rank > F.col("_n")).drop("_n")


def unused_keys(exports: DataFrame, refs: DataFrame, entries: DataFrame) -> DataFrame:
    """exports(path, name, ..) that no refs(path, name) names; a ref without a name uses every key of its path, and entries(path) are used from outside."""
    named = refs.where("name IS NOT NULL").select("path", "name").distinct()
    escaped = refs.where("name IS NULL").select("path").distinct()
    return exports.join(named, ["path", "name"], "left_anti").join(escaped, "path", "left_anti").join(entries.select("path"), "path", "left_anti")


def touching(issues: DataFrame, changed: DataFrame, keys: list[str], paths: str = "paths") -> DataFrame:
    """Issues one of whose paths (an array that depends on the keys alone) is in changed(path): a semi-join of exploded paths."""
    hit = issues.select(*keys, F.explode(paths).alias("path_")).join(changed.select(F.col("path").alias("path_")).distinct(), "path_", "left_semi")
    hit = hit.select(*[F.col(k).alias(f"{k}_") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & issues[k].eqNullSafe(hit[f"{k}_"])
    return issues.join(hit, cond, "left_semi")


def not_listed(df: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key no baseline lists."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def marker_totals(markers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files and markers, of all or by columns."""
    return markers.groupBy(*(by or [])).agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("markers"))


def first_candidate(candidates: DataFrame, existing: DataFrame, key: list[str], rank: str, value: str) -> DataFrame:
    """The first candidate of each key that exists: aggregation, not a window, so it combines early."""
    hit = candidates.join(existing.select(F.col(value)).distinct(), value, "left_semi")
    return hit.groupBy(*key).agg(F.min_by(value, rank).alias(value), F.min(rank).alias(rank))
