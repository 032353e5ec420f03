"""What keeps queries in proportion to their input: partitions, passes over a row, rows sent between tasks."""

from pyspark.sql import functions as F

from ledgerweave.operators.text_layer import parse_invoices
from ledgerweave.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_pairs_of_parts_are_dealt_over_tasks(spark):
    """The parts are few bytes and their pairs many rows: adaptive merging of partitions would leave them to one task."""
    assert QUERIES["token_jaccard"](spark, SMALL).rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_invoice_texts_are_read_once(spark):
    """However many parts of the invoice a select takes, its table is looked for once."""
    rows = parse_invoices(spark.createDataFrame([(1, "Invoice No: A-1")], "k int, text string"))
    lines = F.get("invoice.lines", F.lit(0))
    looks = lambda picked: picked._jdf.queryExecution().optimizedPlan().toString().count("description|item|particular")
    one, many = rows.select(F.size("invoice.lines").alias("n")), rows.select(*(lines[c].alias(c) for c in ("description", "gst_rate", "quantity")), F.size("invoice.lines").alias("n"))
    assert looks(many) == looks(one)
    assert many.first().n == 0


def test_pairs_of_a_group_are_not_counted_one_by_one(spark):
    """The last rung's pairs are not dealt out once more: no window lies above the join with the groups' orders."""
    for name in ("match_ladder_first_rung", "unique_candidate_inference"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Union") < plan.index("Window")


def test_chains_read_what_they_are_made_of_once(spark):
    """The hops of the four-way match start from written rows and keys, not each from the lines of all orders."""
    for name in ("four_way_findings", "four_way_coverage", "consolidated_bookings"):
        assert not [f for f in QUERIES[name](spark, SMALL).inputFiles() if "lineitem" in f or "orders" in f]


def test_postings_without_an_invoice_do_not_meet_in_one_task(spark):
    """A posting that has no invoice joins by a key of its own, not by null."""
    plan = QUERIES["four_way_findings"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(inv_id" in plan and "row " in plan


def test_receipts_of_one_product_add_up(spark):
    """Quantities of one product add up over receipts and their lines; unknown ones count for nothing, all unknown stay unknown."""
    from ledgerweave.operators.fourway import receipts_by_order

    line = "array<struct<description:string,material_code:string,qty_received:double,qty_ordered:double,unit:string>>"
    rows = [("G1", [("Sand", 2.0), ("Cement", None)]), ("G2", [("sand", None), ("Gravel", 1.0), ("SAND", 3.0)]), ("G3", [])]
    grns = spark.createDataFrame([(g, "PO-1", "Acme", None, "2025-08-05", [(d, None, q, None, None) for d, q in x]) for g, x in rows], f"grn_number string, po_number string, vendor_name string, vendor_gstin string, receipt_date string, lines {line}")
    orders = spark.sql("SELECT 'p1' AS po_id, named_struct('po_number', 'PO-1', 'vendor_name', 'Acme', 'vendor_gstin', CAST(NULL AS STRING), 'requisition_date', '2025-08-01') AS `order`")
    one = receipts_by_order(grns, orders).first()
    assert one["received"] == {"sand": 5.0, "cement": None, "gravel": 1.0} and [g["grn_number"] for g in one["grns"]] == ["G1", "G2", "G3"]


def test_more_lines_are_dealt_over_more_tasks(spark, monkeypatch):
    """A task's share of the lines does not grow with the tables: beyond it there are more partitions, and the same rows."""
    from ledgerweave.plans import queries

    few = QUERIES["coverage_invoice_without_open_po"](spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    monkeypatch.setattr(queries, "TASK_ROWS", n // 20)
    many = QUERIES["coverage_invoice_without_open_po"](spark, SMALL)
    assert many.rdd.getNumPartitions() >= 20 and many.exceptAll(few).count() == few.exceptAll(many).count() == 0


def test_decisions_read_texts_and_names_once(spark):
    """Texts and resolved names are written once, and an empty ledger costs no joins: the plan has two of names and cited orders, and what fits."""
    rows = QUERIES["invoice_decisions_from_text"](spark, SMALL)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in rows.inputFiles() if "lineitem" in f] and "Invoice Number" not in plan and plan.count("Join ") <= 5


def test_keys_of_the_four_way_match_are_worked_out_once(spark, monkeypatch):
    """Postings and orders are keyed once, as invoices are: no hop and no part of the result works keys out again from documents (F13, F14, F15)."""
    from ledgerweave.operators.tables import Stored

    plans = []
    write = Stored.write
    monkeypatch.setattr(Stored, "write", lambda self, rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(self, rows))
    plans.append(QUERIES["four_way_findings"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString())
    assert sum("private|pvt" in p and "Other " in p for p in plans) == 1  # the postings' names
    assert "[^a-z0-9 ]+,  , 1), \\s+" not in plans[-1]  # names of receipts' products are of no use to the findings


def test_receipts_of_an_order_that_stands_twice(spark):
    """Two documents of one order number are both of the chain, their receipts and quantities count once; an order without receipts adds none."""
    from ledgerweave.operators.fourway import INVOICE, ORDER, RECEIPT_LINE, REGISTER, four_way

    tax = "27AAAAA1111A1Z1"
    bill = spark.range(1).select(F.lit("i1").alias("inv_id"), F.lit(None).cast("string").alias("bundle_id"), F.lit(None).cast("string").alias("site"), F.from_json(F.lit(f'{{"invoice_number": "A-1", "invoice_date": "2025-08-20", "vendor_gstin": "{tax}", "total": 30.0, "references": [{{"value": "PO-1", "kind": "buyer_pr_po"}}, {{"value": "PO-2", "kind": "buyer_pr_po"}}], "lines": [{{"line_no": 1, "description": "Sand", "quantity": 5.0}}]}}'), INVOICE).alias("invoice"))
    made = [("p1", "PO-1"), ("p2", "PO 1"), ("p3", "PO-2")]
    orders = spark.createDataFrame(made, "po_id string, n string").select("po_id", F.lit(None).cast("string").alias("bundle_id"), F.lit(None).cast("string").alias("site"), F.from_json(F.concat(F.lit('{"po_number": "'), "n", F.lit(f'", "vendor_gstin": "{tax}", "requisition_date": "2025-08-01", "total": 10.0, "po_itemized": true, "lines": [{{"line_no": 1, "description": "Sand", "quantity": 9.0}}]}}')), ORDER).alias("order"))
    grns = spark.createDataFrame([(f"G{k}", "PO-1", "Acme", tax, "2025-08-05", [("sand", None, q, None, None)]) for k, q in ((1, 2.0), (2, 3.0))], f"grn_number string, po_number string, vendor_name string, vendor_gstin string, receipt_date string, lines array<{RECEIPT_LINE}>")
    register = spark.createDataFrame([(1, "Acme", tax, "A-1", "2025-08-25", None, None, 30.0, 0.0, 30.0)], REGISTER)
    one = four_way(register, bill, orders, grns).first()
    assert len(one["ladder"]["matched"]) == 3 and [g["grn_number"] for g in one["grns"]] == ["G1", "G2"] and one["total_match"] is True
    assert sum(one["received"].values()) == 5.0 and one["receipt_after_order"] is True


def _against_sql(spark, folder, tables: dict[str, str], *names: str) -> None:
    """Queries on tables (name: DuckDB select) against their SQL."""
    import duckdb

    from ledgerweave.plans.registry import ORACLE_SQL

    db = duckdb.connect()
    for name, select in tables.items():
        db.sql(f"create table {name} as {select}")
        db.sql(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    for name in names:
        rows = QUERIES[name](spark, str(folder))
        assert sorted(map(tuple, rows.collect())) == sorted(db.sql(f"select {', '.join(rows.columns)} from ({ORACLE_SQL[name]})").fetchall()), name


ORDER_ROW = "select k as o_orderkey, k % 3 * 97 + 7 as o_custkey, 'O' as o_orderstatus, {price}::double as o_totalprice, timestamp '1995-01-01' as o_orderdate, '1-URGENT' as o_orderpriority"
LINE_ROW = "select k as l_orderkey, 1::bigint as l_partkey, {vendor}::bigint as l_suppkey, 1 as l_linenumber, 1::double as l_quantity, {price}::double as l_extendedprice, 0::double as l_discount, 0::double as l_tax, 'N' as l_returnflag, 'O' as l_linestatus, timestamp '1995-01-01' as l_shipdate"


def test_candidates_are_counted_without_their_pairs(spark, tmp_path):
    """Bills that tie with all orders of a day are counted where they meet them; no later step of the unique ones sees a pair (F1, F2)."""
    assert "po_cents" not in QUERIES["unique_candidate_inference"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    made = {"orders": f"{ORDER_ROW.format(price='case when k < 30 then 1000 + k else 9000 * k end')} from range(1, 40) r(k)", "lineitem": f"{LINE_ROW.format(vendor='k + 4', price='case when k < 36 then 1001 + k else 1 end')} from range(1, 40) r(k)"}
    _against_sql(spark, tmp_path, made, "match_ladder_first_rung", "unique_candidate_inference")


def test_bills_of_one_number_count_as_one(spark, tmp_path):
    """Order 1 of vendor 100007 and order 2 of vendor 7 give one bill number: their candidates add up, the first rung of either is that of both (F1, F2)."""
    vendors = "[100007, 7, 100104, 104, 100009, 9, 100010, 10][k]"
    made = {"orders": f"{ORDER_ROW.format(price='5000 * k')} from range(1, 9) r(k)", "lineitem": f"{LINE_ROW.format(vendor=vendors, price='case k when 5 then 5000 else 1 end')} from range(1, 9) r(k)"}
    _against_sql(spark, tmp_path, made, "match_ladder_first_rung", "unique_candidate_inference")


def test_bookings_of_vendors_with_large_numbers(spark, tmp_path):
    """Numbers of postings pass 32 bits from vendor 214,748 on: the same pairs come, and their row numbers are longs (F6)."""
    spark.read.parquet(f"{SMALL}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{SMALL}/lineitem.parquet").withColumn("l_suppkey", F.col("l_suppkey") + 300_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    few, many = (QUERIES["consolidated_bookings"](spark, d) for d in (SMALL, str(tmp_path)))
    assert [few.dtypes[0][1], many.dtypes[0][1]] == ["int", "bigint"]
    assert sorted(map(tuple, many.collect())) == sorted((r + 3_000_000_000, a, b) for r, a, b in few.collect()) != []


def test_the_end_of_a_table_is_looked_for_once(spark):
    """Where the table of an invoice starts and ends is worked out once a text (F5)."""
    plan = parse_invoices(spark.createDataFrame([(1, "Invoice No: A-1")], "k int, text string")).select("invoice.lines")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("amount\\s*in\\s*words") == 1 and plan.count("(?i)(amount|qty|quantity|rate|value)") == 1
