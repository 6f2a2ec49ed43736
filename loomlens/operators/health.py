"""Refactoring targets and the health score over any table with the columns that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..session import materialize

#: Columns of ``targets``: one row a file.
TARGET_COLUMNS = (
    "path", "lines", "function_count", "complexity_density", "fan_in", "fan_out", "dead_code_ratio", "exports", "maintainability_index",
    "crap_above_threshold", "top_name", "top_cognitive", "hotspot", "trend", "in_cycle", "is_entry",
)
#: Columns of ``score``: one row of counts, and the duplication in percent.
SCORE_COLUMNS = ("files", "dead_files", "exports", "dead_exports", "functions", "critical", "over60", "scored", "low_mi", "hot", "loops", "high_fan", "duplication")


def percentiles(df: DataFrame, column: str, ranks: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Nearest ranks of an integer column by group: the value at round((n - 1) * p) in order, 0 if there is none.

    Values are counted first, so that a group comes together as its distinct values alone: of fan counts
    there are at most as many as the root of twice the edges.
    """
    by = by or []
    cells = df.groupBy(*by, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("cells"), F.sum("n").alias("total"))
    kind = df.schema[column].dataType.simpleString()

    def at(p: float) -> Column:
        start = F.struct(F.round((F.col("total") - 1) * F.lit(p)).cast("bigint").alias("left"), F.lit(None).cast(kind).alias("v"))
        walk = F.aggregate("cells", start, lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["n"]), x["v"]).otherwise(a["v"]).alias("v")))
        return F.coalesce(walk["v"], F.lit(0).cast(kind))

    return cells.select(*by, *[at(p).alias(name) for name, p in ranks.items()])


def target_limits(files: DataFrame) -> DataFrame:
    """One row: quartiles and high percentiles of fan-in and fan-out, never below fixed floors."""
    low = lambda c, n: F.greatest(F.col(c), F.lit(n)).alias(c)
    i = percentiles(files, "fan_in", {"p25": 0.25, "p75": 0.75, "p95": 0.95}).select(low("p25", 2), low("p75", 3), low("p95", 5))
    o = percentiles(files, "fan_out", {"out90": 0.90, "out95": 0.95}).select(low("out90", 5), low("out95", 8))
    return i.crossJoin(o)  # of one row each


def targets(files: DataFrame, limits: DataFrame) -> DataFrame:
    """path, priority, efficiency, confidence, category, recommendation, effort, factors, key of files worth changing; unrounded order is kept in ``p``.

    The first rule that holds gives the category, in the order in which they stand.
    """
    t, c = files.crossJoin(F.broadcast(limits)), F.col  # limits are one row
    d, fi, fo, n, mi = c("complexity_density"), c("fan_in"), c("fan_out"), c("function_count"), c("maintainability_index")
    priority = (
        F.least(d, F.lit(1.0)) * 30.0 + c("hotspot") / 100.0 * 25.0 + c("dead_code_ratio") * 20.0
        + F.least(fi / c("p95"), F.lit(1.0)) * 15.0 + F.least(fo / c("out95"), F.lit(1.0)) * 10.0
    )
    effort = F.when((c("lines") < 100) & (n <= 3) & (fi < c("p25")), "low").when((c("lines") >= 500) | (fi >= c("p95")) | ((n >= 15) & (d > 0.5)), "high").otherwise("medium")

    def pick(category: str, text: Column, metric: str, value: Column, limit: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), text.alias("recommendation"), F.lit(metric).alias("metric"), value.cast("double").alias("value"), limit.cast("double").alias("threshold"))

    loop = pick("circular_dep", F.lit("Cut one require of the cycle first; shared behaviour can change safely after that"), "circular-dependency", F.lit(1), F.lit(1))
    choice = (
        F.when((c("hotspot") >= 50) & (c("trend") == "accelerating") & (d > 0.5), pick("urgent_churn_complexity", F.lit("Changes often and is getting complex: settle it before new features"), "hotspot_score", c("hotspot"), F.lit(50)))
        .when(c("in_cycle") & (fi >= 5), loop)
        .when((d > 0.3) & ((fi >= c("p95")) | ((fi >= c("p75")) & (n >= 5))), pick("high_impact", F.concat(F.lit("Split it: each change reaches "), fi.cast("string"), F.lit(" dependents")), "fan_in", fi, c("p95")))
        .when((c("dead_code_ratio") >= 0.5) & (c("exports") >= 3), pick("remove_dead_code", F.lit("Drop exports that nothing uses"), "dead_code_ratio", c("dead_code_ratio"), F.lit(0.5)))
        .when(c("top_cognitive") >= 30, pick("complexity", F.concat(F.lit("Break up "), c("top_name"), F.lit(" (cognitive "), c("top_cognitive").cast("string"), F.lit(")")), "cognitive", c("top_cognitive"), F.lit(30)))
        .when((fo >= c("out90")) & (mi < 60) & ~c("is_entry"), pick("coupling", F.lit("Require less: so many modules are hard to test together"), "fan_out", fo, c("out90")))
        .when((c("crap_above_threshold") >= 2) & (d > 0.3), pick("add_test_coverage", F.lit("Cover the complex functions by a test that requires this file"), "crap_above_threshold", c("crap_above_threshold"), F.lit(2)))
        .when(c("in_cycle"), loop)
    )
    t = t.withColumn("p", priority).withColumn("effort", effort).withColumn("x", choice).where("x IS NOT NULL")
    divisor = F.when(c("effort") == "low", 1.0).when(c("effort") == "medium", 2.0).otherwise(3.0)
    confidence = F.when(c("x.category") == "urgent_churn_complexity", "low").when(c("x.category").isin("high_impact", "coupling"), "medium").otherwise("high")
    factors = F.array(F.struct("x.metric", "x.value", "x.threshold"))
    return t.select(
        "path", S.rounded(c("p"), 2).alias("priority"), S.rounded(c("p") / divisor, 2).alias("efficiency"), confidence.alias("confidence"), "x.category", "x.recommendation", "effort",
        factors.alias("factors"), S.baseline_key(c("path"), c("x.category")).alias("key"),
    )


def in_order(targets_: DataFrame) -> DataFrame:
    """The order in which targets are reported."""
    return targets_.orderBy(F.col("efficiency").desc(), "path")


def places(targets_: DataFrame, by: str) -> DataFrame:
    """``place`` of each target in its group, in the order in which targets are reported.

    Rows are dealt by ranges of the whole order and numbered within a range; what the ranges before hold
    of each group is a table of groups by ranges. So one large group is no single task.
    """
    order = [F.col(by), F.col("efficiency").desc(), F.col("path")]
    dealt = materialize(targets_.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy(F.col("efficiency").desc(), "path"))
    return dealt.join(F.broadcast(base), [by, "_part"]).withColumn("place", own + F.col("_base")).drop("_part", "_base")


def score(counts: DataFrame) -> DataFrame:
    """score, grade, formula_version and the penalties, by name, of one row of counts."""
    c = F.col
    per = lambda a, b, k: c(a) * float(k) / F.greatest(c(b), F.lit(1))
    cap = lambda x, top: F.least(x, F.lit(float(top)))
    pen = {
        "circular_deps": cap(per("loops", "files", 1000) * 0.5, 25), "complexity": cap(per("critical", "functions", 100) * 4.0, 20), "coupling": cap(per("high_fan", "files", 100) * 0.5, 5),
        "dead_exports": cap(per("dead_exports", "exports", 100) * 0.2, 15), "dead_files": cap(per("dead_files", "files", 100) * 0.2, 15), "duplication": cap(F.greatest(c("duplication") - 5.0, F.lit(0.0)), 10),
        "hotspots": cap(c("hot") / F.greatest(F.ceil(c("files") * 0.01), F.lit(1)) * 10.0, 10), "maintainability": cap(per("low_mi", "scored", 100) * 1.5, 15), "unit_size": cap(per("over60", "functions", 1000) * 0.5, 10),
    }
    one = counts.select(F.map_from_arrays(F.array(*map(F.lit, pen)), F.array(*pen.values())).alias("penalties"))
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - F.aggregate(F.map_values("penalties"), F.lit(0.0), lambda a, x: a + x)))
    return one.withColumn("raw", raw).select(S.rounded(c("raw"), 1).alias("score"), S.grade(c("raw")).alias("grade"), F.lit(2).alias("formula_version"), "penalties")
