"""Registered queries: every relational operator over the driver's tables, and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import churn as C
from ..operators import clones, flags, graph, health, scope
from ..session import materialize

NOW = 1_706_745_600  # 2024-02-01
QUERIES: dict = {}
ORACLE_SQL: dict = {}
EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"


def query(sql: str | None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_R = lambda x, k: f"round(({x}) * {10.0**k}) / {10.0**k}"
_EPOCH_SQL = "epoch_us(ts) // 1000000"


def _churn_sql(path: str, window: float) -> str:
    age = f"({NOW} - t) / 86400.0"
    return f"""c0 AS (SELECT {path} AS path, {_EPOCH_SQL} AS t FROM events),
c1 AS (SELECT path, count(*) AS commits,
  coalesce(sum(exp(-({age}) / 90.0 * ln(2))) FILTER (WHERE {age} >= 0 AND {age} <= {window}), 0.0) AS weight,
  count(*) FILTER (WHERE {age} >= 0 AND {age} <= {window} AND t < {NOW - window / 2 * 86400}) AS a,
  count(*) FILTER (WHERE {age} >= 0 AND {age} <= {window} AND t >= {NOW - window / 2 * 86400}) AS b
  FROM c0 GROUP BY path),
c2 AS (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 'stable' WHEN a = 0 THEN 'accelerating' WHEN b / a > 1.5 THEN 'accelerating'
  WHEN b / a < 0.67 THEN 'cooling' ELSE 'stable' END AS trend FROM c1)"""


def _events(spark, d):
    return read(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", F.expr(EPOCH).alias("t"))


def _density(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("user_id").alias("path")).agg((F.sum(F.floor("value")) / F.count(F.lit(1)) / 100.0).alias("density"), F.countDistinct("event_type").alias("fan_in"))


@query(f"""WITH {_churn_sql("user_id", 60.0)},
s AS (SELECT user_id AS path, sum(floor(value)) / count(*) / 100.0 AS density, count(DISTINCT event_type) AS fan_in FROM events GROUP BY 1)
SELECT path, {_R("weight / max(weight) OVER () * (density / max(density) OVER ()) * 100.0", 2)} AS score, commits,
{_R("weight", 4)} AS weighted_commits, {_R("density", 4)} AS complexity_density, fan_in, trend FROM s JOIN c2 USING (path)""")
def churn_hotspots(spark, d):
    """H1: users as files, events as commits."""
    e = _events(spark, d)
    return C.hotspots(_density(e), C.churn(e, "user_id", F.col("t"), NOW, 60.0))


@query(f"""WITH {_churn_sql("event_type", 30.0)} SELECT path, commits, {_R("weight", 4)} AS weighted, a::DOUBLE AS first_half, b::DOUBLE AS second_half, trend FROM c2""")
def churn_trend_types(spark, d):
    c = C.churn(_events(spark, d), "event_type", F.col("t"), NOW, 30.0)
    return c.select("path", "commits", S.rounded(F.col("weight"), 4).alias("weighted"), "first_half", "second_half", "trend")


@query(f"""WITH {_churn_sql("(event_id % 977)", 40.0)} SELECT trend, count(*) AS n, sum(commits)::BIGINT AS commits FROM c2 GROUP BY trend""")
def churn_trend_counts(spark, d):
    """Trends of many sparse paths."""
    e = _events(spark, d).withColumn("p", F.col("event_id") % 977)
    return C.churn(e, "p", F.col("t"), NOW, 40.0).groupBy("trend").agg(F.count(F.lit(1)).alias("n"), F.sum("commits").alias("commits"))


def _imports(spark, d):
    o, l = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return graph.distinct_edges(l.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_suppkey")


_IMPORTS = "e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"WITH {_IMPORTS} SELECT c_custkey AS node, count(dst) AS fan_out FROM customer LEFT JOIN e ON src = c_custkey GROUP BY 1")
def fan_out(spark, d):
    nodes = read(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    return nodes.join(graph.fan_out(_imports(spark, d)), "node", "left").fillna(0, ["fan_out"])


@query(f"WITH {_IMPORTS} SELECT s_suppkey AS node, count(src) AS fan_in FROM supplier LEFT JOIN e ON dst = s_suppkey GROUP BY 1")
def fan_in(spark, d):
    nodes = read(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return nodes.join(graph.fan_in(_imports(spark, d)), "node", "left").fillna(0, ["fan_in"])


_ALLOW = "(VALUES (0, 1), (1, 2), (1, 0), (2, 3), (3, 4)) a(zone, target)"


@query(f"""WITH {_IMPORTS}, n AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM e JOIN customer c ON c_custkey = src JOIN supplier s ON s_suppkey = dst)
SELECT n.src, n.dst, r1.r_name AS from_zone, r2.r_name AS to_zone FROM n JOIN nation a1 ON a1.n_nationkey = n.src JOIN nation a2 ON a2.n_nationkey = n.dst
JOIN region r1 ON r1.r_regionkey = a1.n_regionkey JOIN region r2 ON r2.r_regionkey = a2.n_regionkey
WHERE a1.n_regionkey <> a2.n_regionkey AND NOT EXISTS (SELECT 1 FROM {_ALLOW} WHERE zone = a1.n_regionkey AND target = a2.n_regionkey)""")
def zone_violations(spark, d):
    """H7: nations as files, regions as zones."""
    c, s = read(spark, d, "customer").select("c_custkey", "c_nationkey"), read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    e = _imports(spark, d).join(c, F.col("src") == F.col("c_custkey")).join(s, F.col("dst") == F.col("s_suppkey"))
    e = graph.distinct_edges(e.select("c_nationkey", "s_nationkey"), "c_nationkey", "s_nationkey")
    r = read(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("zone"))
    n = read(spark, d, "nation").join(r, "n_regionkey").select(F.col("n_nationkey").alias("node"), "zone")
    rule = spark.createDataFrame([(0, 1), (1, 2), (1, 0), (2, 3), (3, 4)], "a int, b int")
    rule = rule.join(r.toDF("a", "zone"), "a").join(r.toDF("b", "target"), "b").select("zone", "target")
    return scope.zone_violations(e, n, rule).select("src", "dst", "from_zone", "to_zone")


_Q = (0.25, 0.75, 0.90, 0.95)


@query("WITH v AS (SELECT c_nationkey AS k, list_sort(list(floor(c_acctbal)::BIGINT)) AS v FROM customer GROUP BY 1) SELECT k, "
       + ", ".join(f"v[round((len(v) - 1) * {p}::DOUBLE)::INT + 1] AS p{round(p * 100)}" for p in _Q) + ", greatest(v[round((len(v) - 1) * 0.95::DOUBLE)::INT + 1], 10) AS p95_floor FROM v")
def percentile_floors(spark, d):
    """Nearest ranks with floors."""
    v = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.floor("c_acctbal").alias("v"))
    return health.percentiles(v, "v", {f"p{round(p * 100)}": p for p in _Q}, ["k"]).withColumn("p95_floor", F.greatest("p95", F.lit(10)))


@query("""WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS line, doc_id FROM documents)
SELECT md5(line) AS line_md5, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) > 1""")
def dup_lines(spark, d):
    l = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    l = l.select("doc_id", F.md5("line").alias("line_md5"))
    return l.groupBy("line_md5").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n > 1")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, md5(array_to_string(w[i:i + 29], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 28)) AS i FROM w WHERE len(w) >= 30))
SELECT h AS window_md5, count(*) AS n FROM g GROUP BY h HAVING count(*) > 1""")
def dup_windows(spark, d):
    """G8, seeds: 30-token windows that occur more than once."""
    return clones.repeated_windows(read(spark, d, "documents").select("doc_id", "text"), "doc_id", F.filter(F.split("text", "[ \n]"), lambda x: x != ""), 30)


@query("""WITH r AS (SELECT l_orderkey % 50 AS path, l_partkey % 400 AS a, l_partkey % 400 + l_quantity::INT - 1 AS b FROM lineitem),
u AS (SELECT DISTINCT path, unnest(range(a, b + 1)) AS line FROM r) SELECT path, count(*) AS duplicated_lines FROM u GROUP BY path""")
def dup_line_union(spark, d):
    """Lines covered by overlapping ranges, each once."""
    r = read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("path"), (F.col("l_partkey") % 400).alias("a"), F.col("l_quantity").cast("int").alias("n"))
    return clones.covered_lines(r.select("path", "a", (F.col("a") + F.col("n") - 1).alias("b")), "path", "a", "b")


@query("""SELECT page_id AS src, url AS from_url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS specifier FROM pages""")
def link_edges(spark, d):
    """Links as raw imports."""
    p = read(spark, d, "pages")
    return p.select(F.col("page_id").alias("src"), F.col("url").alias("from_url"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("specifier"))


def _successors(spark, d):
    """Users in the order of all events. Each hour is ordered by itself; its last event leads to the first of the next hour that has any."""
    e = _events(spark, d).select("user_id", "event_id", "t", F.floor(F.col("t") / 3600).alias("hour"))
    own = F.lead(F.struct("user_id")).over(Window.partitionBy("hour").orderBy(F.col("t").asc_nulls_last(), "event_id"))
    heads = e.groupBy("hour").agg(F.min(F.struct("t", "event_id", "user_id")).alias("head"))  # one row an hour
    heads = heads.select(F.col("hour").alias("h"), F.lead("head").over(Window.orderBy(F.col("hour").asc_nulls_last())).alias("following"))
    e = e.withColumn("own", own).join(heads, F.col("hour").eqNullSafe(F.col("h")))
    e = e.select("user_id", F.when(F.col("own").isNotNull(), F.col("own.user_id")).otherwise(F.col("following.user_id")).alias("nxt"))
    return materialize(graph.distinct_edges(e, "user_id", "nxt"), "successors")


_SUCC = f"""e AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY {_EPOCH_SQL}, event_id) AS dst FROM events) WHERE src IS NOT NULL AND dst IS NOT NULL),
nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@query(f"WITH RECURSIVE {_SUCC}, r AS (SELECT min(node) AS node FROM nodes UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r WHERE node IS NOT NULL")
def reach_from_entries(spark, d):
    e = _successors(spark, d)
    return graph.reachable(e, _nodes(e).agg(F.min("node").alias("node")).where("node IS NOT NULL"))


@query(f"WITH RECURSIVE {_SUCC}, r AS (SELECT min(node) AS node FROM nodes UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM r WHERE node IS NOT NULL)")
def unused_nodes(spark, d):
    """Files that no entry reaches."""
    e = _successors(spark, d)
    n = _nodes(e)
    return n.join(graph.reachable(e, n.agg(F.min("node").alias("node")).where("node IS NOT NULL")), "node", "left_anti")


@query(f"""WITH RECURSIVE {_SUCC}, c AS (SELECT * FROM e WHERE dst % 7 <> 0), d AS (SELECT DISTINCT dst AS node FROM c WHERE src % 7 = 0),
r AS (SELECT node FROM d UNION SELECT c.dst FROM r JOIN c ON c.src = r.node AND c.src % 7 <> 0)
SELECT node, CASE WHEN node IN (SELECT node FROM d) THEN 85.0 WHEN node IN (SELECT node FROM r) THEN 40.0 ELSE 0.0 END::DOUBLE AS coverage FROM nodes""")
def coverage_labels(spark, d):
    e = _successors(spark, d)
    return graph.coverage_labels(_nodes(e).withColumn("is_test", F.col("node") % 7 == 0), e)


@query(f"""WITH RECURSIVE {_SUCC}, r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT x.a AS node, min(least(x.a, x.b)) AS scc FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1""")
def scc_members(spark, d):
    return graph.scc(_successors(spark, d))


@query(f"""WITH RECURSIVE {_SUCC}, r AS (SELECT min(node) AS node, 0 AS depth FROM nodes UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT src, dst, depth + 1 AS depth FROM e JOIN m ON m.node = e.src""")
def trace_depth3(spark, d):
    e = _successors(spark, d)
    return graph.trace(e, _nodes(e).agg(F.min("node").alias("node")), 3)


# The same by joins alone, as for graphs that are not small.


@query(ORACLE_SQL["reach_from_entries"])
def reach_by_joins(spark, d):
    """G2 without the driver."""
    e = _successors(spark, d)
    return graph.reachable(e, _nodes(e).agg(F.min("node").alias("node")).where("node IS NOT NULL"), 0)


@query(ORACLE_SQL["coverage_labels"])
def coverage_by_joins(spark, d):
    """G4 without the driver."""
    e = _successors(spark, d)
    return graph.coverage_labels(_nodes(e).withColumn("is_test", F.col("node") % 7 == 0), e, 0)


@query(ORACLE_SQL["scc_members"])
def scc_by_joins(spark, d):
    """G5 without the driver."""
    return graph.scc(_successors(spark, d), 0)


@query(f"WITH {_IMPORTS}, r AS (SELECT DISTINCT src AS node FROM e UNION SELECT dst + 10000000 FROM e WHERE src IN (SELECT min(src) FROM e UNION ALL SELECT max(src) FROM e)), "
       "t AS (SELECT min(src) AS a, max(src) AS b FROM e) SELECT node FROM r, t WHERE node IN (a, b) OR node >= 10000000")  # fmt: skip
def reach_of_imports(spark, d):
    """G2 by joins over the edges from customers to suppliers, from the first and the last customer."""
    e = materialize(_imports(spark, d).withColumn("dst", F.col("dst") + 10_000_000), "imports")
    ends = e.agg(F.array(F.min("src"), F.max("src")).alias("x")).select(F.explode("x").alias("node")).where("node IS NOT NULL")
    return graph.reachable(e, ends, 0)


_UNITS = """u AS (SELECT l_orderkey AS path, sum(l_linenumber) AS cc, floor(sum(l_quantity) / 8)::BIGINT AS lines, count(DISTINCT l_suppkey) AS fan_out, count(*) FILTER (WHERE l_linestatus = 'O') AS fan_in, count(*) AS n,
  count(*) FILTER (WHERE l_returnflag = 'R') AS unused, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS dead, max(l_linenumber) * 6 AS top, min(l_returnflag) AS top_name, count(*) FILTER (WHERE l_tax > 0.055) AS risky FROM lineitem GROUP BY 1),
s AS (SELECT *, cc / greatest(lines, 1) AS density FROM u)"""
_MI = "least(100.0, greatest(0.0, 100.0 - density * 30.0 * least(lines / 50.0::DOUBLE, 1.0) - dead * 20.0 - least(ln(fan_out + 1.0) * 4.0, 15.0)))"


#: Line items that a task gets at most, if no order has more: the first number while that makes no more than MANY tasks and
#: one, up to which Spark's writers hold no rows in memory, and the second beyond.
ROWS_A_TASK = (250_000, 2_000_000)
MANY = 199


def _units(spark, d):
    """Orders with counts of their items. Items go to their order as they are: nearly every supplier of an order is another, so adding
    up before that would keep a row an item in memory. Suppliers are counted in order, by their ranks."""
    l = read(spark, d, "lineitem")
    rows, (low, high) = l.count(), ROWS_A_TASK
    l = l.repartition(max(min(rows // low, MANY), rows // high) + 1, "l_orderkey")
    rank = F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy(F.col("l_suppkey").asc_nulls_last()))
    l = l.withColumn("supplier", F.when(F.col("l_suppkey").isNotNull(), rank).otherwise(0))
    u = l.groupBy(F.col("l_orderkey").alias("path")).agg(
        F.sum("l_linenumber").alias("cc"), F.floor(F.sum("l_quantity") / 8).alias("lines"), F.max("supplier").cast("bigint").alias("fan_out"), F.count_if(F.col("l_linestatus") == "O").alias("fan_in"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("unused"), (F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1))).alias("dead"),
        (F.max("l_linenumber") * 6).alias("top"), F.min("l_returnflag").alias("top_name"), F.count_if(F.col("l_tax") > 0.055).alias("risky"),
    )
    return u.withColumn("density", F.col("cc") / F.greatest(F.col("lines"), F.lit(1)))


@query(f"WITH {_UNITS} SELECT path, {_R(_MI, 2)} AS maintainability, {_R('density', 4)} AS density FROM s")
def maintainability(spark, d):
    """Orders as files, items as functions."""
    mi = S.maintainability(F.col("density"), F.col("dead"), F.col("fan_out"), F.col("lines"))
    return _units(spark, d).select("path", S.rounded(mi, 2).alias("maintainability"), S.rounded(F.col("density"), 4).alias("density"))


@query("""SELECT l_orderkey AS path, l_linenumber AS seq, round((cc * cc * b * b * b + cc) * 100.0) / 100.0 AS crap FROM (
SELECT *, l_linenumber::DOUBLE AS cc, 1.0::DOUBLE - (CASE l_returnflag WHEN 'R' THEN 85.0 WHEN 'A' THEN 40.0 ELSE 0.0 END)::DOUBLE / 100.0::DOUBLE AS b FROM lineitem)""")
def crap(spark, d):
    cov = F.when(F.col("l_returnflag") == "R", 85.0).when(F.col("l_returnflag") == "A", 40.0).otherwise(0.0)
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("seq"), S.rounded(S.crap(F.col("l_linenumber"), cov), 2).alias("crap"))


_BIN = "CASE WHEN {0} <= {1} THEN 'low' WHEN {0} <= {2} THEN 'medium' WHEN {0} <= {3} THEN 'high' ELSE 'very_high' END"


@query(f"""WITH b AS (SELECT 'unit_size' AS profile, {_BIN.format("l_quantity * 2", 15, 30, 60)} AS bin FROM lineitem UNION ALL
SELECT 'unit_interfacing', {_BIN.format("l_linenumber", 2, 4, 6)} FROM lineitem)
SELECT profile, bin, count(*) AS n, {_R("count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem)", 2)} AS percent FROM b GROUP BY 1, 2""")
def risk_profile(spark, d):
    """A7, P5, P6, P15 in one pass: both bins of a row are exploded after the scan."""
    l = read(spark, d, "lineitem").select(F.explode(F.create_map(F.lit("unit_size"), S.size_bin(F.col("l_quantity") * 2), F.lit("unit_interfacing"), S.parameter_bin(F.col("l_linenumber")))).alias("profile", "bin"))
    c = l.groupBy("profile", "bin").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("percent", S.rounded(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("profile")), 2))


# Orders as files, with a hotspot score and a trend from the order, in the columns that targets and score read.
_FILES = f"""{_UNITS}, f AS (SELECT s.*, {_R("density", 4)} AS d, {_R(_MI, 2)} AS mi, floor(o_totalprice) % 101.0 AS hotspot, CASE o_orderstatus WHEN 'O' THEN 'accelerating' ELSE 'stable' END AS trend,
  o_orderkey % 11 = 0 AS in_cycle, o_orderkey % 13 = 0 AS is_entry FROM s JOIN orders ON o_orderkey = path)"""


def _files(spark, d):
    o, c = read(spark, d, "orders"), F.col
    o = o.select(
        c("o_orderkey").alias("path"), (F.floor("o_totalprice") % 101.0).alias("hotspot"), F.when(c("o_orderstatus") == "O", "accelerating").otherwise("stable").alias("trend"),
        (c("o_orderkey") % 11 == 0).alias("in_cycle"), (c("o_orderkey") % 13 == 0).alias("is_entry"),
    )
    mi = S.maintainability(c("density"), c("dead"), c("fan_out"), F.greatest(c("lines"), F.lit(1)))
    return _units(spark, d).join(o, "path").select(
        "path", "lines", c("n").alias("function_count"), S.rounded(c("density"), 4).alias("complexity_density"), "fan_in", "fan_out", c("dead").alias("dead_code_ratio"), c("n").alias("exports"),
        S.rounded(mi, 2).alias("maintainability_index"), c("risky").alias("crap_above_threshold"), "top_name", c("top").alias("top_cognitive"), "hotspot", "trend", "in_cycle", "is_entry", "unused",
    )


_PENALTIES = {
    "circular_deps": "least(loops * 1000.0 / greatest(files, 1) * 0.5, 25.0)", "complexity": "least(critical * 100.0 / greatest(functions, 1) * 4.0, 20.0)", "coupling": "least(high_fan * 100.0 / greatest(files, 1) * 0.5, 5.0)",
    "dead_exports": "least(dead_exports * 100.0 / greatest(functions, 1) * 0.2, 15.0)", "dead_files": "least(dead_files * 100.0 / greatest(files, 1) * 0.2, 15.0)", "duplication": "least(greatest(duplication - 5.0, 0.0), 10.0)",
    "hotspots": "least(hot / greatest(ceil(files * 0.01), 1) * 10.0, 10.0)", "maintainability": "least(low_mi * 100.0 / greatest(files, 1) * 1.5, 15.0)", "unit_size": "least(over60 * 1000.0 / greatest(functions, 1) * 0.5, 10.0)",
}


@query(f"""WITH {_FILES}, l AS (SELECT count(*) FILTER (WHERE l_linenumber >= 7) AS critical, count(*) FILTER (WHERE l_quantity > 49) AS over60, {_R("count(*) FILTER (WHERE l_discount < 0.005) * 100.0::DOUBLE / count(*)", 2)} AS duplication FROM lineitem),
a AS (SELECT count(*) AS files, count(*) FILTER (WHERE dead = 1) AS dead_files, sum(n) AS functions, sum(unused) AS dead_exports, count(*) FILTER (WHERE mi < 70) AS low_mi, count(*) FILTER (WHERE hotspot >= 100) AS hot,
  count(*) FILTER (WHERE in_cycle AND is_entry) AS loops, count(*) FILTER (WHERE fan_in > 6) AS high_fan FROM f),
p AS (SELECT {", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in _PENALTIES.items())} FROM a, l), b AS (SELECT *, least(100.0, greatest(0.0, 100.0 - ({" + ".join(_PENALTIES)}))) AS raw FROM p)
SELECT {", ".join(f"{_R(name, 4)} AS {name}" for name in _PENALTIES)}, {_R("raw", 1)} AS score,
CASE WHEN raw >= 85 THEN 'A' WHEN raw >= 70 THEN 'B' WHEN raw >= 55 THEN 'C' WHEN raw >= 40 THEN 'D' ELSE 'F' END AS grade FROM b""")
def health_score(spark, d):
    """All nine penalties of one pass over files and one over functions."""
    c, l = F.col, read(spark, d, "lineitem")
    a = _files(spark, d).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(c("dead_code_ratio") == 1).alias("dead_files"), F.sum("function_count").alias("functions"), F.sum("exports").alias("exports"), F.sum("unused").alias("dead_exports"),
        F.count(F.lit(1)).alias("scored"), F.count_if(c("maintainability_index") < 70).alias("low_mi"), F.count_if(c("hotspot") >= 100).alias("hot"), F.count_if(c("in_cycle") & c("is_entry")).alias("loops"), F.count_if(c("fan_in") > 6).alias("high_fan"),
    )
    b = l.agg(F.count_if(c("l_linenumber") >= 7).alias("critical"), F.count_if(c("l_quantity") > 49).alias("over60"), S.rounded(F.count_if(c("l_discount") < 0.005) * 100.0 / F.count(F.lit(1)), 2).alias("duplication"))
    s = health.score(a.crossJoin(b))  # of one row each
    return s.select("score", "grade", *[S.rounded(F.element_at("penalties", F.lit(k)), 4).alias(k) for k in _PENALTIES])


_TARGET = f"""WITH {_FILES}, v AS (SELECT list_sort(list(fan_in)) AS i, list_sort(list(fan_out)) AS o FROM f),
q AS (SELECT {", ".join(f"greatest({c}[round((len({c}) - 1) * {p}::DOUBLE)::INT + 1], {low}) AS {name}" for c, p, low, name in (("i", 0.25, 2, "p25"), ("i", 0.75, 3, "p75"), ("i", 0.95, 5, "p95"), ("o", 0.90, 5, "out90"), ("o", 0.95, 8, "out95")))} FROM v),
p AS (SELECT *, least(d, 1.0) * 30.0 + hotspot / 100.0 * 25.0 + dead * 20.0 + least(fan_in / p95::DOUBLE, 1.0) * 15.0 + least(fan_out / out95::DOUBLE, 1.0) * 10.0 AS x,
CASE WHEN lines < 100 AND n <= 3 AND fan_in < p25 THEN 'low' WHEN lines >= 500 OR fan_in >= p95 OR (n >= 15 AND d > 0.5) THEN 'high' ELSE 'medium' END AS effort,
CASE WHEN hotspot >= 50 AND trend = 'accelerating' AND d > 0.5 THEN 'urgent_churn_complexity' WHEN in_cycle AND fan_in >= 5 THEN 'circular_dep' WHEN d > 0.3 AND (fan_in >= p95 OR (fan_in >= p75 AND n >= 5)) THEN 'high_impact'
WHEN dead >= 0.5 AND n >= 3 THEN 'remove_dead_code' WHEN top >= 30 THEN 'complexity' WHEN fan_out >= out90 AND {_R(_MI, 2)} < 60 AND NOT is_entry THEN 'coupling' WHEN risky >= 2 AND d > 0.3 THEN 'add_test_coverage'
WHEN in_cycle THEN 'circular_dep' END AS category FROM f, q)
SELECT path, category, effort, {_R("x", 2)} AS priority, {_R("x / CASE effort WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END", 2)} AS efficiency,
CASE WHEN category = 'urgent_churn_complexity' THEN 'low' WHEN category IN ('high_impact', 'coupling') THEN 'medium' ELSE 'high' END AS confidence, path || ':' || replace(category, '_', '') AS key FROM p WHERE category IS NOT NULL"""


def _targets(spark, d):
    f = materialize(_files(spark, d), "files")
    return health.targets(f.select(*health.TARGET_COLUMNS), health.target_limits(f))


@query(_TARGET)
def target_category(spark, d):
    """Eight rules in order in one expression, with limits from the percentiles of all files."""
    return _targets(spark, d).select("path", "category", "effort", "priority", "efficiency", "confidence", "key")


@query(f"SELECT path, efficiency, category, row_number() OVER (PARTITION BY category ORDER BY efficiency DESC, path) AS place FROM ({_TARGET})")
def target_order(spark, d):
    """O5 within each category. A category may hold a large share of all files: places are counted by ranges of the order, not in one task a category."""
    return health.places(_targets(spark, d).select("path", "efficiency", "category"), "category")


@query("""WITH r AS (SELECT p_brand AS path, CASE WHEN l_quantity = 50 AND l_discount > 0.095 AND l_tax > 0.075 THEN NULL ELSE p_partkey END AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48)
SELECT p_partkey AS name, p_brand AS path FROM part p WHERE p_brand <> 'Brand#11' AND p_brand NOT IN (SELECT path FROM r WHERE name IS NULL) AND NOT EXISTS (SELECT 1 FROM r WHERE r.path = p.p_brand AND r.name = p.p_partkey)""")
def unused_keys(spark, d):
    """Brands as modules, parts as keys, large items as references; some use a module as a whole, one module is an entry."""
    p, c = read(spark, d, "part").select(F.col("p_partkey").alias("name"), F.col("p_brand").alias("path")), F.col
    l = read(spark, d, "lineitem").where("l_quantity > 48").join(p, c("l_partkey") == c("name"))
    refs = l.select("path", F.when((c("l_quantity") == 50) & (c("l_discount") > 0.095) & (c("l_tax") > 0.075), F.lit(None)).otherwise(c("name")).alias("name"))
    return scope.unused_keys(p, refs, spark.createDataFrame([("Brand#11",)], "path string")).select("name", "path")


@query("""WITH f AS (SELECT o_custkey AS path, o_orderkey AS line, CASE o_orderstatus WHEN 'O' THEN 'high-crap' WHEN 'F' THEN 'high-cognitive-complexity' ELSE 'unused-export' END AS kind FROM orders),
m AS (SELECT c_custkey AS path, 0 AS line, 'file' AS level, CASE c_custkey % 5 WHEN 0 THEN 'complexity' ELSE 'coverage-gaps' END AS k FROM customer WHERE c_custkey % 10 IN (0, 1)
UNION ALL SELECT o_custkey, o_orderkey - 1, 'next-line', 'all' FROM orders WHERE o_orderkey % 9 = 0)
SELECT path, line, kind FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND (m.level = 'file' OR m.line + 1 = f.line)
AND (m.k = 'all' OR (m.k = 'complexity' AND contains(f.kind, 'complexity')) OR (m.k = 'coverage-gaps' AND f.kind = 'high-crap')))""")
def suppressed_findings(spark, d):
    """Orders as findings, markers by rule."""
    o = read(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "high_crap").when(F.col("o_orderstatus") == "F", "high_cognitive_complexity").otherwise("unused_export")
    f = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("line"), kind.alias("kind"))
    c = read(spark, d, "customer").where("c_custkey % 10 IN (0, 1)")
    files = c.select(F.col("c_custkey").alias("path"), F.lit(0).cast("long").alias("line"), F.lit("file").alias("level"), F.when(F.col("c_custkey") % 5 == 0, "complexity").otherwise("coverage-gaps").alias("kind"))
    lines = o.where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("path"), (F.col("o_orderkey") - 1).alias("line"), F.lit("next-line").alias("level"), F.lit("all").alias("kind"))
    return scope.suppressed(f, files.unionByName(lines)).select("path", "line", F.translate("kind", "_", "-").alias("kind"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 50)""")
def changed_scope(spark, d):
    """Line items as issues of an order and a part, some of which have changed."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    changed = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(name("o", "o_orderkey").alias("path")).unionByName(read(spark, d, "part").where("p_size = 50").select(name("p", "p_partkey").alias("path")))
    issues = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.array(name("o", "l_orderkey"), name("p", "l_partkey")).alias("paths"))
    return scope.touching(issues, changed, ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber")


@query(f"""WITH i AS (SELECT event_id, event_type AS kind, user_id AS path, {_EPOCH_SQL} AS t FROM events),
b AS (SELECT kind, path, count(*) AS n FROM i WHERE t < 1705363200 GROUP BY ALL)
SELECT event_id, i.kind, i.path, row_number() OVER (PARTITION BY i.kind, i.path ORDER BY event_id) > coalesce(b.n, 0) AS introduced FROM i LEFT JOIN b ON b.kind = i.kind AND b.path = i.path""")
def new_only_attribution(spark, d):
    """The first n of a key are inherited."""
    i = _events(spark, d).select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("path"), "t")
    return scope.introduced(i.drop("t"), i.where("t < 1705363200"), ["kind", "path"], ["event_id"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey || ':' || replace(lower(replace(o_orderpriority, '-', '_')), '_', '') AS key FROM orders)
SELECT o_orderkey, key FROM o WHERE key NOT IN (SELECT c_custkey || ':1urgent' FROM customer)""")
def baseline_exclusion(spark, d):
    """Keys of path and category that no baseline lists."""
    o = read(spark, d, "orders").select("o_orderkey", S.baseline_key(F.col("o_custkey"), F.lower(F.translate("o_orderpriority", "-", "_"))).alias("key"))
    known = read(spark, d, "customer").select(S.baseline_key(F.col("c_custkey"), F.lit("1_urgent")).alias("key"))
    return scope.not_listed(o, known).select("o_orderkey", "key")


@query("""WITH c AS (SELECT p_partkey, r, (p_partkey * (r + 3)) % 300 AS s_suppkey FROM part, (VALUES (0), (1), (2), (3)) v(r))
SELECT p_partkey, min(r)::INT AS r, arg_min(s_suppkey, r) AS s_suppkey FROM c WHERE s_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def first_candidate(spark, d):
    """The first of ordered candidates that exists."""
    p = read(spark, d, "part").select("p_partkey", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("r"))
    c = p.withColumn("s_suppkey", F.col("p_partkey") * (F.col("r") + 3) % 300)
    return scope.first_candidate(c, read(spark, d, "supplier"), ["p_partkey"], "r", "s_suppkey").select("p_partkey", "r", "s_suppkey")


_FLAGS = "replace(replace(replace(text, 'that', 'isEnabled(\"x y\")'), 'with', 'UserSettings'), 'this', 'getenv(''HOME'')')"


@query(f"""WITH t AS (SELECT conv_id * 1000 + turn AS path, {_FLAGS} AS text FROM conversations), l AS (SELECT path, i AS line, string_split(text, chr(10))[i] AS s FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM t)),
n AS (SELECT *, lower(s) AS low, coalesce(nullif(regexp_extract(s, '"([^"]+)"', 1), ''), nullif(regexp_extract(s, '''([^'']+)''', 1), '')) AS quoted FROM l),
h AS (SELECT path, line, 0 AS seq, 'identifier' AS kind, coalesce(quoted, 'feature') AS name, s FROM n WHERE contains(low, 'featureflag') OR contains(low, 'feature_flag') OR contains(low, 'isfeatureenabled') OR contains(low, 'isenabled(')
  UNION ALL SELECT path, line, 1, 'get_attribute', coalesce(quoted, 'attribute'), s FROM n WHERE contains(low, 'getattribute')
  UNION ALL SELECT path, line, 2, 'settings_gate', coalesce(quoted, 'settings'), s FROM n WHERE contains(low, 'settings.') OR contains(low, 'usersettings')
  UNION ALL SELECT path, line, 3, 'env_lookup', coalesce(quoted, 'env'), s FROM n WHERE contains(low, 'getenv') OR contains(low, 'process.env'))
SELECT path, line::BIGINT AS line, kind, name, md5(trim(s)) AS detail_md5 FROM h QUALIFY row_number() OVER (PARTITION BY path, line, name ORDER BY seq) = 1""")
def flag_lines(spark, d):
    """Turns as files, with words put in that the rules look for."""
    c = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("path"), F.expr(_FLAGS.replace("''HOME''", "\\'HOME\\'")).alias("source"))
    out = flags.first_of_each(flags.text_flags(c))
    return out.select("path", F.col("line").cast("long").alias("line"), "kind", "name", F.md5("detail").alias("detail_md5"))


@query("SELECT o_orderstatus AS kind, count(*) AS markers, count(DISTINCT o_custkey) AS files FROM orders GROUP BY 1")
def suppression_inventory(spark, d):
    """Orders as markers."""
    return scope.marker_totals(read(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderstatus").alias("kind")), ["kind"]).select("kind", "markers", "files")


@query("""SELECT p_name AS token, lpad(lower(to_hex(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT)), 8, '0') AS fingerprint
FROM (SELECT DISTINCT p_name FROM part)""")
def fnv_fingerprint(spark, d):
    """P23."""
    return read(spark, d, "part").select(F.col("p_name").alias("token")).distinct().withColumn("fingerprint", S.fnv1a(F.col("token")))


@query("""WITH t AS (SELECT s_suppkey AS path, greatest(1, s_suppkey % 7) AS k FROM supplier)
SELECT path, 1 + k AS cyclomatic, (k * (k + 1) // 2)::BIGINT AS cognitive, 2 AS parameters, (2 * k + 2)::BIGINT AS lines FROM t""")
def extracted_functions(spark, d):
    """Modules generated from suppliers go through the parser; the oracle knows their measures."""
    from ..luau.extract import extract

    k = F.greatest(F.lit(1), F.col("s_suppkey") % 7).cast("int")
    body = F.array_join(F.concat(F.array(F.lit("local function f(a, b)")), F.array_repeat(F.lit("if a then"), k), F.array_repeat(F.lit("end"), k), F.array(F.lit("end"))), "\n")
    files = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), body.alias("source"))
    f = extract(files).select("path", F.inline("functions"))
    return f.select(F.col("path").cast("long").alias("path"), F.col("cyclomatic").cast("long").alias("cyclomatic"), F.col("cognitive").cast("long").alias("cognitive"), "parameters", F.col("lines").cast("long").alias("lines"))


@query("""WITH s AS (SELECT s_suppkey AS path, s_nationkey FROM supplier)
SELECT a.path AS src, b.path AS dst, 'string_literal' AS kind FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND b.path = (SELECT min(path) FROM s c WHERE c.s_nationkey = a.s_nationkey AND c.path > a.path)""")
def extracted_requires(spark, d):
    """Each generated module requires the next supplier of its nation; edges are resolved against the files."""
    from ..luau.extract import extract
    from ..operators import resolve

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = read(spark, d, "supplier").select("s_suppkey", F.lead("s_suppkey").over(w).alias("nxt"))
    source = F.when(F.col("nxt").isNotNull(), F.concat(F.lit('local m = require("./m'), F.col("nxt").cast("string"), F.lit('")\nreturn { run = m.run }'))).otherwise(F.lit("return { run = function() end }"))
    files = s.select(F.concat(F.lit("lib/m"), F.col("s_suppkey").cast("string"), F.lit(".luau")).alias("path"), source.alias("source"))
    edges = resolve.edges(extract(files), files.select("path"))
    number = lambda c: F.regexp_extract(c, r"m(\d+)", 1).cast("long")
    return edges.where("`to` IS NOT NULL").select(number(F.col("from")).alias("src"), number(F.col("to")).alias("dst"), "kind")
