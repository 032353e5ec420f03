"""Claims against the loop over invoices in upload order; components against union-find; nothing stays behind."""

import random

from pyspark.sql import functions as F

from ledgerweave.operators.batch import claim
from ledgerweave.operators.tables import Stored, components, numbered

EDGE = "batch_id string, inv int, po int, rung int, ref int"


def loop(edges):
    out = set()
    for batch in {e[0] for e in edges}:
        taken = set()
        for inv in sorted({e[1] for e in edges if e[0] == batch}):
            own = [e for e in edges if e[:2] == (batch, inv)]
            for rung in sorted({e[3] for e in own}):
                got = [e for e in own if e[3] == rung and (rung == 1 or e[2] not in taken)]
                if got and (rung == 1 or len(got) == 1):
                    taken |= {e[2] for e in got}
                    out |= set(got)
                    break
    return out


def random_batch(rng, name):
    """Invoices with cited orders, or with candidates of the other rungs; some share none, some all."""
    many, orders = rng.randint(1, 12), rng.randint(1, 10)
    edges = set()
    for inv in range(many):
        if rng.random() < 0.3:
            edges |= {(name, inv, po, 1, k) for k, po in enumerate(rng.sample(range(orders), min(orders, rng.randint(1, 2))))}
        else:
            edges |= {(name, inv, rng.randrange(orders), rng.choice([2, 3, 4, 4]), 0) for _ in range(rng.randint(0, 3))}
    return sorted(edges)


def test_two_hundred_batches(spark):
    rng = random.Random(9)
    edges = [e for k in range(200) for e in random_batch(rng, f"b{k}")]
    with Stored(spark) as tables:
        got = {tuple(r) for r in claim(spark.createDataFrame(edges, EDGE).repartition(5), tables).collect()}
    assert got == loop(edges)
    assert claim(spark.createDataFrame([], EDGE), Stored(spark)).collect() == []


def test_one_large_batch_is_many_groups(spark):
    """50,000 invoices of one batch, pairs of which want the same order: 25,000 components, dealt over the tasks."""
    inv = spark.range(50000).selectExpr("'b' AS batch_id", "CAST(id AS INT) AS inv", "explode(array(id - id % 2, 100000 + id)) AS o")
    edges = inv.selectExpr("batch_id", "inv", "CAST(o AS INT) AS po", "CASE WHEN o < 100000 THEN 2 ELSE 4 END AS rung", "0 AS ref")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # else so few rows are put together in one task
    with Stored(spark) as tables:
        rows = claim(edges, tables).withColumn("task", F.spark_partition_id()).groupBy("rung").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).collect()
    spark.conf.unset(key)
    assert {r["rung"]: r["n"] for r in rows} == {2: 25000, 4: 25000} and min(r["tasks"] for r in rows) > 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{a:04d}", f"n{a + 1:04d}") for a in range(200)] + [(f"m{rng.randrange(300):04d}", f"m{rng.randrange(300):04d}") for _ in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    with Stored(spark) as tables:
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a string, b string"), tables).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_numbers_in_order_without_a_single_task(spark, capsys):
    rows = spark.range(5000).selectExpr("pmod(xxhash64(id), 100000) AS k", "id AS other").repartition(6)
    with Stored(spark) as tables:
        out = numbered(rows, ["k", "other"], tables, "seq", 11)
        got = [(r["k"], r["other"], r["seq"]) for r in out.orderBy("seq").collect()]
        out.explain("formatted")
        assert got == [(k, o, 11 + i) for i, (k, o) in enumerate(sorted((k, o) for k, o, _ in got))] and len(got) == 5000
        assert "SinglePartition" not in capsys.readouterr().out
        assert numbered(rows.limit(0), ["k"], tables).collect() == []
