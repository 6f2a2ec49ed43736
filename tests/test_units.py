"""Orders as files: items are shuffled once and as they are, and a task's share does not grow with the table."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loomlens.plans import catalogue


def shuffled(spark):
    """Rows that all stages have shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """Orders of one to forty items, suppliers that repeat, some of them unknown, and orders of unknown suppliers alone."""
    r, d = random.Random(8), str(tmp_path_factory.mktemp("items"))
    lines = [
        (o, r.randrange(9), None if o % 10 == 3 or r.random() < 0.2 else r.randrange(o % 6 + 1), k, float(r.randrange(1, 51)), 100.0, r.choice((0.0, 0.1)), r.choice((0.05, 0.06)), r.choice("RAN"), r.choice("OF"))
        for o in range(60) for k in range(1, (40 if o == 6 else r.randrange(1, 8)) + 1)
    ]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, schema).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    orders = [(o, r.choice((99.5, 100.25, 7.0)), r.choice("FO")) for o in range(70)]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double, o_orderstatus string").coalesce(1).write.parquet(f"{d}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    return d, con, len(lines)


@pytest.mark.parametrize("share", [(250_000, 2_000_000), (40, 60), (3, 10**6)])
@pytest.mark.parametrize("name", ["maintainability", "health_score", "target_category"])
def test_units_equal_sql(spark, items, monkeypatch, name, share):
    monkeypatch.setattr(catalogue, "ROWS_A_TASK", share, raising=False)
    d, con, _ = items
    df = catalogue.QUERIES[name](spark, d)
    cur = con.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(x)) for x in cur.fetchall())


def test_items_are_shuffled_once(spark, items, tmp_path):
    """With another supplier for every item, adding up by supplier first would hold every item and send on more rows than items."""
    l = spark.read.parquet(f"{items[0]}/lineitem.parquet").withColumn("l_suppkey", F.monotonically_increasing_id())
    l.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df, before = catalogue.QUERIES["maintainability"](spark, str(tmp_path)), shuffled(spark)
    df.collect()
    assert shuffled(spark) - before == items[2]


def test_a_tasks_items_are_bounded(spark, items, monkeypatch):
    monkeypatch.setattr(catalogue, "ROWS_A_TASK", (40, 1000), raising=False)
    d, _, n = items
    df = catalogue.QUERIES["maintainability"](spark, d)
    assert df.rdd.getNumPartitions() == n // 40 + 1 > 4
    assert df.where(F.col("path") == 6).count() == 1
