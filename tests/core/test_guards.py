"""Guards, gates and views on rows built here."""

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators import guards

LINES = "array<struct<description:string>>"


def test_gates(spark):
    rows = spark.createDataFrame([("P1", "R1", None, "27A", [("Pipe",)]), ("P1", None, "Acme", None, [("Pipe",)]), ("P1", "R1", "Acme", None, [(" ",)]), ("P1", "R1", "", "", [("Pipe",)]), ("P1", "R1", "Acme", None, None)], f"n string, r string, v string, g string, lines {LINES}")
    cols = [F.col(c) for c in ("n", "r", "v", "g", "lines")]
    assert [r[0] for r in rows.select(guards.order_gate(*cols)).collect()] == [True, False, False, False, False]
    assert [r[0] for r in rows.select(guards.receipt_gate(*cols)).collect()] == [True, False, False, False, False]


def test_load_diagnostics(spark):
    one, none = spark.range(3), spark.range(0)
    assert [(r["kind"], r["problem"]) for r in guards.zero_load(POs=(one, none), GRNs=(none, none), invoices=(one, one)).collect()] == [("POs", "0 POs loaded from 3 files — extract key mismatch?")]
    invoices = spark.createDataFrame([([],), (None,)], f"lines {LINES}")
    assert [r["n"] for r in guards.no_line_items(invoices).collect()] == [2] and guards.no_line_items(invoices.limit(0)).collect() == []


def test_tripwires(spark):
    rows = spark.createDataFrame([(1, "i1", ([("a",)],), [("a",)]), (2, "i2", ([("a",)],), []), (3, None, None, None), (4, "i4", ([],), [])], f"register_row int, inv_id string, invoice struct<lines:{LINES}>, lines {LINES}")
    assert [r["problem"] for r in guards.empty_lines(rows).collect()] == ["EMPTY_LINES_ON_MATCH: row 2"]
    whole = {k: "x" for k in guards.LINE_CONTRACT["invoice"]}
    cases = [(1, "bill_only", whole, None, []), (2, "pair", {**whole, "qty": None}, None, []), (3, "grn_only", None, None, [{k: "x" for k in guards.LINE_CONTRACT["grn"] if k != "line_no"}])]
    df = spark.createDataFrame(cases, "register_row int, row_type string, invoice map<string,string>, po map<string,string>, grns array<map<string,string>>")
    assert sorted(r["problem"] for r in guards.incomplete_rows(df).collect()) == ["SCHEMA_INCOMPLETE: grn_only row 3 missing grn.line_no", "SCHEMA_INCOMPLETE: pair row 2 missing invoice.qty", "SCHEMA_INCOMPLETE: pair row 2 missing po part"]


def test_one_more_run(spark):
    postings = spark.createDataFrame([(1,), (2,)], "register_row int")
    times = []

    def run(rows, heals=True):
        times.append(1)
        good = F.lit(heals and len(times) > 1) | (F.col("register_row") == 1)
        return rows.withColumn("ok", good)

    broken = lambda found: found.where("not ok")
    assert sorted(tuple(r) for r in guards.once_more(run, postings, broken).collect()) == [(1, True), (2, True)]
    with pytest.raises(Exception, match="still incomplete after a second run: row 2"):
        guards.once_more(lambda r: run(r, False), postings, broken).collect()


def test_views_and_lanes(spark):
    a, b = spark.createDataFrame([("r", 0, "x")], "id string, k int, left string"), spark.createDataFrame([("r", 0, "y"), ("r", 1, "z")], "id string, k int, right string")
    assert sorted(map(tuple, guards.combine(a, b, "id", "k").collect())) == [("r", 0, "x", "y"), ("r", 1, None, "z")]
    assert guards.lanes(a, b).columns == ["id", "k", "left", "right"] and guards.lanes(a, b).count() == 3
    mixed = spark.createDataFrame([((5, "p. 1", "agrees"), 7, [(1,), (2,)])], "s struct<value:int,cite:string,state:string>, n int, a array<struct<value:int>>")
    assert tuple(mixed.select(guards.value_of(mixed, "s"), guards.value_of(mixed, "n"), guards.value_of(mixed, "a"), guards.state_of(mixed, "s")).first()) == (5, 7, [1, 2], "agrees")
