"""Two-way match cases built here, one per outcome."""

import json

import pytest

from ledgerweave.operators.twoway import INVOICE, ORDER, PRIOR, csv_report, two_way

A, B = "27AAAAA1111A1Z1", "29BBBBB2222B1Z2"


def line(no, text, qty=1.0, rate=100.0, **more):
    return {"line_no": no, "description": text, "quantity": qty, "rate": rate, "unit_price": rate, "amount": qty * rate, **more}


def invoice(**more):
    return {"invoice_number": "INV-1", "invoice_date": "2025-08-10", "vendor_name": "Acme Tools Pvt Ltd", "vendor_gstin": A, "references": [{"value": "PR 2390", "kind": "buyer_pr_po", "handwritten": False}], "total": 1000.0, "lines": [line(1, "PVC elbow 20 mm", 10.0)], **more}


def order(**more):
    return {"po_number": "PO-1", "pr_number": "PR2390", "vendor_name": "Acme Tools", "vendor_gstin": A, "requisition_date": "2025-08-01", "total": 1000.0, "po_itemized": True, "lines": [line(1, "PVC bend 20mm", 10.0)], **more}


CASES = {
    "match": (invoice(), [order()], None),
    "vendor": (invoice(), [order(vendor_gstin=B)], None),
    "total": (invoice(), [order(total=900.0)], None),
    "no_po": (invoice(references=[], vendor_gstin=None), [order()], None),
    "over": (invoice(lines=[line(1, "PVC elbow", 12.0)]), [order(lines=[line(1, "PVC elbow", 10.0)])], None),
    "spans": (invoice(references=[{"value": "PO-1", "kind": "buyer_pr_po"}, {"value": "PO-2", "kind": "buyer_pr_po"}]), [order(total=400.0), order(po_number="PO-2", pr_number=None, total=600.0)], None),
    "fy": (invoice(invoice_date="2026-05-01"), [order()], None),
    "lump": (invoice(), [order(po_itemized=False)], None),
    "rate": (invoice(lines=[line(1, "PVC elbow", 10.0, 110.0)]), [order(lines=[line(1, "PVC elbow", 10.0, 100.0)])], None),
    "codes": (invoice(lines=[line(1, "PVC elbow", hsn_sac="39171", gst_rate=0.18), line(2, "Cloth", hsn_sac="5208", gst_rate=0.18)]), [order(lines=[line(1, "PVC elbow"), line(2, "Cloth")])], None),
    "dates": (invoice(invoice_date="2025-07-01"), [order()], None),
    "repeat": (invoice(), [order()], [{"invoice_number": "inv 1", "vendor_gstin": A, "total": 5.0, "invoice_date": "2025-01-01"}]),
    "fingerprint": (invoice(references=[]), [order()], None),
    "possible": (invoice(references=[], total=2000.0), [order()], None),
    "blank": ({"references": []}, [], None),
    "leftover": (invoice(lines=[line(1, "alpha"), line(2, "beta")]), [order(lines=[line(1, "gamma"), line(2, "alpha")])], None),
    "stray": (invoice(references=[{"value": "PO-1", "kind": "buyer_pr_po"}, {"value": "PO-9", "kind": "buyer_pr_po"}]), [order()], None),
}


@pytest.fixture(scope="module")
def matched(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, json.dumps(i), json.dumps(p), json.dumps(x)) for k, (i, p, x) in CASES.items()], "name string, i string, p string, l string")
    rows = rows.select("name", F.from_json("i", INVOICE).alias("invoice"), F.from_json("p", f"array<{ORDER}>").alias("pos"), F.from_json("l", PRIOR).alias("ledger"))
    return {r["name"]: r for r in csv_report(two_way(rows)).collect()}


@pytest.mark.parametrize(
    "name, result, flag, reason",
    [
        ("match", "Match", None, ""),
        ("vendor", "No match", None, "vendor"),
        ("total", "No match", None, "(diff 100)"),
        ("no_po", "Match", "No PO matched", ""),
        ("over", "Match", "Over-billed 1", ""),
        ("spans", "Match", "spans 2 POs", ""),
        ("fy", "No match", None, "outside FY"),
        ("lump", "Match", "lump-sum", ""),
        ("rate", "Match", "Rate variance on 1", ""),
        ("codes", "Match", "Invalid HSN/SAC on 1", ""),
        ("codes", "Match", "GST% mismatch on 1", ""),
        ("dates", "Match", "BEFORE PO 2025-08-01", ""),
        ("repeat", "Match", "EXACT DUPLICATE", ""),
        ("fingerprint", "Match", None, ""),
        ("possible", "No match", "Possible match only", "(diff 1000)"),
        ("blank", "", "No PO matched", ""),
        ("stray", "Match", "PO-9 that matches no PO", ""),
    ],
)
def test_results(matched, name, result, flag, reason):
    row = matched[name]
    assert row["result"] == result
    assert reason in row["reason"] and (reason or not row["reason"])
    assert (not row["flags"]) if flag is None and name in ("match", "fingerprint") else True
    if flag:
        assert any(flag in f for f in row["flags"]), row["flags"]


def test_ladder_and_lines(matched):
    assert matched["fingerprint"]["ladder"]["basis"] == "GSTIN + total"
    assert matched["possible"]["ladder"]["confidence"] == "low"
    assert matched["match"]["lines"][0]["paired_po_line"] == "PO-1#1" and matched["match"]["lines"][0]["line_match"]
    assert [x["paired_po_line"] for x in matched["leftover"]["lines"]] == ["PO-1#2", "PO-1#1"]
    assert matched["lump"]["lines"][0]["line_match"] is None
    assert matched["no_po"]["vendor_match"] is None and matched["no_po"]["total_match"] is None


def test_csv(matched):
    head, body, blank, line_head, first = matched["match"]["csv"].split("\n")
    assert head.startswith("invoice_number,invoice_date,vendor_name") and blank == "" and len(line_head.split(",")) == 17
    assert body.startswith("INV-1,2025-08-10,Acme Tools Pvt Ltd,27AAAAA1111A1Z1,1000,PO-1,1000,Match,agrees,agrees,agrees,agrees,agrees,PR/PO number,high,,")
    assert first.startswith("INV-1,1,PVC elbow 20 mm,,10,") and matched["match"]["csv_filename"] == "match_INV-1.csv"
