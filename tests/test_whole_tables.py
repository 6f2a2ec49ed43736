"""Queries over whole tables against brute force on small tables of their own."""

import datetime
import random

import pytest

from loomlens.operators import graph
from loomlens.plans.catalogue import QUERIES

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Values all far below 300; equal times, empty hours, and no time in order of the ids."""
    r, d = random.Random(39), str(tmp_path_factory.mktemp("events"))
    made = [(i, START + datetime.timedelta(minutes=r.choice((0, 20, 59)), hours=r.randrange(0, 40, 4)), r.randrange(1, 31)) for i in range(45)]
    df = spark.createDataFrame([(i, t, u, "view", 1.0, "{}") for i, t, u in made], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").write.parquet(f"{d}/events.parquet")
    order = [u for _, _, u in sorted((t, i, u) for i, t, u in made)]
    return d, set(zip(order, order[1:]))


def reached(edges, start):
    seen, queue = set(start), list(start)
    while queue:
        v = queue.pop()
        new = {b for a, b in edges if a == v} - seen
        seen |= new
        queue += new
    return seen


@pytest.mark.parametrize("small", [100_000, 0])
def test_graph_of_all_events(spark, events, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    d, edges = events
    nodes = {v for e in edges for v in e}
    entry = {min(nodes)}
    seen = reached(edges, entry)
    assert len(edges) > 30 and len(nodes - seen) == 4
    run = lambda name: rows(QUERIES[name](spark, d))
    assert run("reach_from_entries") == run("reach_by_joins") == [(v,) for v in sorted(seen)]
    assert run("unused_nodes") == [(v,) for v in sorted(nodes - seen)]
    code = {(a, b) for a, b in edges if b % 7}
    direct = {b for a, b in code if a % 7 == 0}
    onward = reached({(a, b) for a, b in code if a % 7}, direct)
    assert run("coverage_labels") == [(v, 85.0 if v in direct else 40.0 if v in onward else 0.0) for v in sorted(nodes)]
    after = {v: reached(edges, {b for a, b in edges if a == v}) for v in nodes}
    assert run("scc_members") == run("scc_by_joins") == sorted((v, min(w for w in after[v] if v in after[w])) for v in nodes if v in after[v])
    depth, front = {v: 0 for v in entry}, entry
    for k in (1, 2):
        front = {b for a, b in edges if a in front} - depth.keys()
        depth |= dict.fromkeys(front, k)
    assert run("trace_depth3") == sorted((a, b, depth[a] + 1) for a, b in edges if a in depth)


def test_line_union_of_all_line_items(spark, tmp_path):
    r = random.Random(4)
    items = [(r.randrange(1, 160), r.randrange(1, 900), k, float(r.randrange(1, 12))) for k in (1, 2, 3, 4, 7) for _ in range(25)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    union = lambda top: {(o % 50, p % 400 + i) for o, p, k, q in items if k <= top for i in range(int(q))}
    count = lambda lines: sorted((p, sum(x == p for x, _ in lines)) for p in {x for x, _ in lines})
    assert rows(QUERIES["dup_line_union"](spark, str(tmp_path))) == count(union(7)) != count(union(2))


def test_inventory_of_all_orders(spark, tmp_path):
    orders = [(k, k % 5, "FOP"[k % 3]) for k in range(1, 40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    want = sorted((s, sum(x[2] == s for x in orders), len({c for _, c, x in orders if x == s})) for s in "FOP")
    assert rows(QUERIES["suppression_inventory"](spark, str(tmp_path))) == want
