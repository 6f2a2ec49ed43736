"""Graphs as edge tables: fan counts, reachability, coverage labels, components of cycles, traces.

Loops join a frontier with the edges; every round is written to the shared folder, so that the lineage
stays short and a lost executor costs one round. Graphs whose counted edges are few (``SMALL_EDGES``, a
fixed bound) are closed on the driver instead, where a round of jobs would cost more than the answer.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SMALL_EDGES = 100_000
#: Rounds after which the nodes reached so far are written as one table.
COMPACT = 8


def distinct_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Resolved edges (src, dst), each once."""
    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))


def fan_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, fan_in, fan_out of every known node over distinct edges; loops count in both."""
    return nodes.select("node").join(fan_in(edges), "node", "left").join(fan_out(edges), "node", "left").fillna(0, ["fan_in", "fan_out"])


def _small(edges: DataFrame, limit: int | None) -> list | None:
    rows = edges.select("src", "dst").limit((SMALL_EDGES if limit is None else limit) + 1).collect()
    return None if len(rows) > (SMALL_EDGES if limit is None else limit) else [(r[0], r[1]) for r in rows]


def _table(like: DataFrame, column: str, name: str, values) -> DataFrame:
    kind = like.schema[column].dataType.simpleString()
    return like.sparkSession.createDataFrame([(v,) for v in values], f"{name} {kind}")


def reachable(edges: DataFrame, entries: DataFrame, small_edges: int | None = None) -> DataFrame:
    """Every node that a path of edges joins to an entry (column ``node``), entries included."""
    start = entries.select("node").distinct()
    rows = _small(edges, small_edges)
    if rows is not None and start.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        onward = defaultdict(list)
        for a, b in rows:
            onward[a].append(b)
        seen = {r[0] for r in start.collect()}
        queue = deque(seen)
        while queue:
            for b in onward[queue.popleft()]:
                if b not in seen:
                    seen.add(b)
                    queue.append(b)
        return _table(edges, "src", "node", sorted(seen))
    seen = frontier = materialize(start, "reached")
    rounds = 0
    while not frontier.isEmpty():
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti"), "frontier")
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % COMPACT == 0:  # else every round would add a branch to the plan
            seen = materialize(seen, "reached")
    return seen


def coverage_labels(nodes: DataFrame, edges: DataFrame, small_edges: int | None = None) -> DataFrame:
    """nodes(node, is_test): 85 for what a test uses, 40 for what that reaches through other code, else 0."""
    tests = nodes.where("is_test").select("node")
    code = edges.join(tests.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    direct = code.join(tests.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    within = code.join(tests.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst")
    reached = reachable(within, direct, small_edges)
    return (
        nodes.select("node")
        .join(direct.withColumn("d", F.lit(True)), "node", "left").join(reached.withColumn("r", F.lit(True)), "node", "left")
        .select("node", F.when(F.col("d"), 85.0).when(F.col("r"), 40.0).otherwise(0.0).alias("coverage"))
    )


def tarjan(pairs: list[tuple]) -> list[list]:
    """Strongly connected components of two or more nodes, or of one with a loop; iterative."""
    onward, loops, nodes = defaultdict(list), set(), set()
    for a, b in sorted(pairs):
        onward[a].append(b)
        nodes |= {a, b}
        if a == b:
            loops.add(a)
    number, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(nodes):
        if root in number:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                number[v] = low[v] = len(number)
                stack.append(v)
                on.add(v)
            following = onward[v]
            while i < len(following):
                w = following[i]
                i += 1
                if w not in number:
                    work += [(v, i), (w, 0)]
                    break
                if w in on:
                    low[v] = min(low[v], number[w])
            else:
                if low[v] == number[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in loops:
                        out.append(sorted(part))
                if work:
                    u = work[-1][0]
                    low[u] = min(low[u], low[v])
    return sorted(out)


def scc(edges: DataFrame, small_edges: int | None = None) -> DataFrame:
    """(node, scc): nodes on a cycle and the smallest node of their component."""
    kind = edges.schema["src"].dataType.simpleString()
    rows = _small(edges, small_edges)
    if rows is not None:
        return edges.sparkSession.createDataFrame([(v, part[0]) for part in tarjan(rows) for v in part], f"node {kind}, scc {kind}")
    # Colouring: the smallest node that reaches each node; a colour's component is what reaches its root.
    done = None
    left = materialize(edges.select("src", "dst").distinct(), "scc-edges")
    while not left.isEmpty():
        inner = left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        inner = materialize(inner.select("src", "dst"), "scc-edges")
        if inner.count() < left.count():  # nodes without a way in or out are on no cycle
            left = inner
            continue
        colour = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node"))
        while True:
            offer = left.join(colour, left["src"] == colour["node"]).select(F.col("dst").alias("node"), "c")
            grown = materialize(colour.unionByName(offer).groupBy("node").agg(F.min("c").alias("c")), "scc-colours")
            changed = grown.join(colour.withColumnRenamed("c", "was"), "node").where("c <> was").isEmpty()
            colour = grown
            if changed:
                break
        same = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst").where("a = b")
        same = materialize(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-edges")
        found = reachable(same, colour.where("node = c").select("node"), 0).join(colour, "node")
        sizes = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        loops = left.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
        part = found.join(sizes, "c").join(loops, "node", "left").where("n > 1 OR loop").select("node", F.col("c").alias("scc"))
        done = part if done is None else done.unionByName(part)
        gone = materialize(found.select("node"), "scc-found")
        left = materialize(left.join(gone, left["src"] == gone["node"], "left_anti").join(gone, F.col("dst") == gone["node"], "left_anti").select("src", "dst"), "scc-edges")
    return done if done is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)


def cycle_walk(members: list, pairs: list[tuple]) -> list:
    """A closed walk through all members in order, each hop the shortest way inside the component."""
    inside = set(members)
    onward = defaultdict(list)
    for a, b in sorted(set(pairs)):
        if a in inside and b in inside:
            onward[a].append(b)
    if len(members) == 1:
        return [members[0], members[0]]
    walk = [members[0]]
    for goal in [*members[1:], members[0]]:
        if goal in walk and goal != members[0]:
            continue
        back, queue = {walk[-1]: None}, deque([walk[-1]])
        while queue and (goal not in back or goal == walk[-1]):
            v = queue.popleft()
            for w in onward[v]:
                if w not in back:
                    back[w] = v
                    queue.append(w)
        hop, v = [], goal
        while v is not None and v != walk[-1]:
            hop.append(v)
            v = back[v]
        walk += hop[::-1]
    return walk


def trace(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(src, dst, depth): every edge that leaves a node first reached at a depth below the limit."""
    seen = frontier = start.select("node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)), "trace")
        seen = seen.unionByName(frontier)
    if depth <= 0:
        seen = seen.limit(0)
    return edges.join(seen, edges["src"] == seen["node"]).select("src", "dst", (F.col("depth") + 1).alias("depth"))
