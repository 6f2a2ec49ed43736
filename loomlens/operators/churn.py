"""Churn: decayed commit weights, trends and hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import SECONDS_A_DAY, commit_weight, rounded, trend


def churn(commits: DataFrame, path: str, ts: Column, now: int, window_days: float) -> DataFrame:
    """path, commits (all), weight (in the window), first_half, second_half, trend; one partial aggregation."""
    age = (F.lit(now) - F.col("_ts")) / float(SECONDS_A_DAY)
    inside = (age >= 0) & (age <= window_days)
    late = F.col("_ts") >= F.lit(now - window_days / 2 * SECONDS_A_DAY)
    out = (
        commits.select(F.col(path).alias("path"), ts.cast("long").alias("_ts"))
        .groupBy("path")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.coalesce(F.sum(F.when(inside, commit_weight(age))), F.lit(0.0)).alias("weight"),
            F.coalesce(F.sum(F.when(inside & ~late, 1.0)), F.lit(0.0)).alias("first_half"),
            F.coalesce(F.sum(F.when(inside & late, 1.0)), F.lit(0.0)).alias("second_half"),
        )
    )
    return out.withColumn("trend", trend(F.col("first_half"), F.col("second_half")))


def hotspots(scores: DataFrame, churned: DataFrame, min_commits: int = 1) -> DataFrame:
    """scores(path, density, fan_in) with churn: normalised by the project's largest weight and density."""
    eps = 2.220446049250313e-16
    top_w = churned.agg(F.greatest(F.coalesce(F.max("weight"), F.lit(0.0)), F.lit(eps)).alias("top_w"))
    top_d = scores.agg(F.greatest(F.coalesce(F.max("density"), F.lit(0.0)), F.lit(eps)).alias("top_d"))
    j = scores.join(churned, "path", "left").fillna({"commits": 0, "weight": 0.0, "trend": "stable"})
    j = j.where(~((F.col("commits") < min_commits) & (F.col("weight") == 0)))
    # Both sides are one row: scalar subqueries, not products of tables.
    j = j.crossJoin(F.broadcast(top_w)).crossJoin(F.broadcast(top_d))
    return j.select(
        "path", rounded(F.col("weight") / F.col("top_w") * (F.col("density") / F.col("top_d")) * 100.0, 2).alias("score"), "commits",
        rounded(F.col("weight"), 4).alias("weighted_commits"), rounded(F.col("density"), 4).alias("complexity_density"), "fan_in", "trend",
    ).orderBy(F.col("score").desc(), "path")
