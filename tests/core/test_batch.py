"""Batch reconciliation on documents built here; expected classes follow the semantics, one batch per case."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import fuzzy
from ledgerweave.operators.batch import LEDGER, READER_DOC, canonical, cross_run_duplicates, reconcile
from ledgerweave.operators.tables import Stored

SURE = {"doc_number": 0.95, "vendor": 0.95, "total": 0.95}
G1, G2 = "27AAAAA1111A1Z1", "29BBBBB2222B1Z2"


def inv(no, total, ref=None, vendor="Acme Corp", **more):
    refs = {"po_references": ref} if isinstance(ref, list) else {"po_reference": ref}
    return {"doc_type": "invoice", "doc_number": no, "vendor_name": vendor, "total": total, "date": "2026-01-10", "field_confidence": SURE, **refs, **more}


def po(no, total, vendor="Acme Corp", **more):
    return {"doc_type": "purchase_order", "doc_number": no, "vendor_name": vendor, "total": total, "field_confidence": SURE, **more}


def li(text, price=None, qty="2", **more):
    return {"description": text, "unit_price": price, "quantity": qty, **more}


BATCHES = {
    "demo": [inv("I-1", "$1,000.00", "PO-1001"), inv("I-2", "$8,540.00", "PO 1002"), inv("I-2", "$8,540.00", "PO-1002"), inv("I-4", "$50.00", "PO-1003"), po("PO-1001", "$1,000.00"), po("PO-1002", "$8,000.00"), po("PO-1004", "$75.00"), {"doc_type": "other", "field_confidence": SURE}],
    "fingerprint": [inv("F-1", "500", None, "Solo Ltd"), po("PO-7", "500.00", "Solo Ltd")],
    "gst": [inv("G-1", "1000", None, "X", seller_gstin=G1), inv("G-2", "1500", None, "Y", seller_gstin=G2), po("PO-1", "1000", "Other", seller_gstin=G1), po("PO-2", "9000", "Else", seller_gstin=G2)],
    "multi": [inv("M-1", "1000", ["PO-11", "PO-12"]), po("PO-11", "400"), po("PO-12", "600")],
    "split": [inv("S-1", "5000", "PO-5"), inv("S-2", "7000", "PO-5"), po("PO-5", "12000")],
    "split_over": [inv("S-1", "9000", "PO-5"), inv("S-2", "11000", "PO-5"), po("PO-5", "12000")],
    "line": [inv("L-1", "300", "PO-9", line_items=[li("Blue widget", "100"), li("Red gadget", "60")]), po("PO-9", "300", line_items=[li("Red gadget", "50"), li("Blue widget large", "100")])],
    "gst_check": [inv("T-1", "1180", "PO-1", taxable_total="1000", tax_total="180", line_items=[li("Pipe", "100", hsn_sac="3917", gst_rate="18%")]), inv("T-2", "1300", "PO-2", taxable_total="1000", tax_total="180", line_items=[li("Pipe", "100", hsn_sac="39171", gst_rate="18"), li("Cloth", "1", hsn_sac="5208", gst_rate="18")]), po("PO-1", "1180"), po("PO-2", "1300")],
    "memory": [inv("I-1", "$1,000.00", "PO-1001"), inv("I-9", "30000", "PO-50"), po("PO-50", "40000")],
    "contest": [inv("C-1", "100", None, "Twin", seller_gstin=G1), inv("C-2", "100", None, "Twin", seller_gstin=G1, date="2026-02-02"), po("PO-31", "100", "Twin", seller_gstin=G1), po("PO-32", "900", "Twin", seller_gstin=G1)],
}
PRIOR = [(0, "ACME Corp", "i-1", "2025-12-01", 100000, "USD", "PO-1001", 100000, None, "a.pdf", "old", None), (1, "Acme Corp", "I-8", "2025-12-01", 2000000, "USD", "PO50", 4000000, None, "b.pdf", "old", None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(b, k, f"{b}-{k}.pdf", json.dumps(d)) for b, ds in BATCHES.items() for k, d in enumerate(ds)]
    files = spark.createDataFrame(rows, "batch_id string, index int, filename string, j string").withColumn("doc", F.from_json("j", READER_DOC))
    return Stored(spark).write(canonical(files))


def collected(docs, ledger=None):
    with reconcile(docs, ledger, keep=True) as report:
        return {k: [r.asDict(True) for r in v.collect()] for k, v in report.items()}


@pytest.fixture(scope="module")
def plain(docs):
    return collected(docs)


@pytest.fixture(scope="module")
def remembered(spark, docs):
    return collected(docs, spark.createDataFrame(PRIOR, "seq long, " + LEDGER))


def of(report, table, batch):
    return [r for r in report[table] if r["batch_id"] == batch]


def test_demo(plain):
    (s,) = of(plain, "summary", "demo")
    assert (s["documents"], s["invoices"], s["pos"], s["matched"], s["po_missing"], s["invoice_missing"], s["unreadable"], s["duplicates"]) == (8, 4, 3, 3, 1, 1, 1, 1)
    by = {r["inv"]: r for r in of(plain, "matched", "demo")}
    assert by[0]["status"] == "MATCHED" and by[1]["status"] == "VARIANCE" and by[1]["delta_cents"] == 54000
    assert by[1]["duplicate"] and not by[0]["duplicate"]
    assert of(plain, "duplicates", "demo")[0]["kind"] == "EXACT" and of(plain, "po_missing", "demo")[0]["cited_po"] == "PO-1003"
    assert of(plain, "invoice_missing", "demo")[0]["po_number"] == "PO-1004"


def test_fingerprints(plain):
    (r,) = of(plain, "matched", "fingerprint")
    assert "fingerprint (name" in r["basis"] and not of(plain, "invoice_missing", "fingerprint")
    a, b = sorted(of(plain, "matched", "gst"), key=lambda r: r["inv"])
    assert (a["basis"], a["status"]) == ("fingerprint (GSTIN + total)", "MATCHED")
    assert b["basis"].startswith("possible") and b["status"] == "MISMATCH"


def test_many_to_many(plain):
    (r,) = of(plain, "matched", "multi")
    assert (r["relationship"], r["status"], len(r["po_numbers"])) == ("invoice-spans-POs", "MATCHED", 2)
    for r in of(plain, "matched", "split"):
        assert (r["relationship"], r["status"], r["split_cumulative"]) == ("split-billing", "PARTIAL", 1200000)
    for r in of(plain, "matched", "split_over"):
        assert (r["status"], r["split_over"]) == ("MISMATCH", 800000)


def test_lines_and_taxes(plain):
    (r,) = of(plain, "matched", "line")
    assert r["status"] == "MATCHED" and r["line_check"]["summary"] == "All 2 lines matched" and len(r["line_check"]["flags"]) == 1
    clean, bad = sorted(of(plain, "matched", "gst_check"), key=lambda r: r["inv"])
    assert clean["gst_check"]["tax_reconciles"] and not clean["gst_check"]["hsn_flags"] and not clean["gst_check"]["rate_flags"]
    assert (len(bad["gst_check"]["hsn_flags"]), len(bad["gst_check"]["rate_flags"]), bad["gst_check"]["tax_reconciles"]) == (1, 1, False)
    assert clean["status"] == bad["status"] == "MATCHED"


def test_claims_in_upload_order(plain):
    a, b = sorted(of(plain, "matched", "contest"), key=lambda r: r["inv"])
    assert (a["po_number"], b["po_number"]) == ("PO-31", "PO-32") and b["basis"].startswith("possible")


def test_memory(plain, remembered):
    assert [r["kind"] for r in of(remembered, "cross_run_duplicates", "memory")] == ["EXACT"]
    (f,) = of(remembered, "cumulative_flags", "memory")
    assert f["over"] == 1000000 and f["prior_count"] == 1
    assert [r["status"] for r in of(remembered, "matched", "memory")] == [r["status"] for r in of(plain, "matched", "memory")]
    assert len(of(plain, "ledger_additions", "memory")) == 2 and not plain["cumulative_flags"]


def test_tables_are_made_when_asked_for(docs):
    with reconcile(docs) as report:
        report["unreadable"]
        assert report.stored.many == 0  # made of the documents as they are
        report["duplicates"]
        report["cross_run_duplicates"]
        assert report.stored.many == 1  # the documents; nothing is matched for them
        assert set(report) == {"matched", "po_missing", "invoice_missing", "unreadable", "duplicates", "cross_run_duplicates", "cumulative_flags", "ledger_additions", "summary"}


def test_vendor_keys_are_columns_of_the_joins_sides(spark, docs):
    """A join whose keys are expressions works them out for each comparison of its sorts."""
    with reconcile(docs, spark.createDataFrame(PRIOR, "seq long, " + LEDGER)) as report:
        for name in ("duplicates", "cross_run_duplicates"):
            plan = report[name]._jdf.queryExecution().optimizedPlan().toString()
            assert not [line for line in plan.splitlines() if "Join" in line and "regexp_replace" in line]


def test_equal_names_are_alike_without_a_comparison(monkeypatch):
    monkeypatch.setattr(fuzzy, "SequenceMatcher", None)
    assert fuzzy.ratio_plain.func(pd.Series(["x", None, ""]), pd.Series(["x", "x", ""])).fillna(-1).tolist() == [1.0, -1.0, 1.0]


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_tables_work_out_what_they_need(docs):
    """Vendors' keys are written with the documents; a table that shows no verdict or duplicate makes none for its join."""
    with reconcile(docs) as report:
        for name in ("matched", "duplicates"):
            assert "incorporated" not in plan_of(report[name])
        assert "ratio_plain" in plan_of(report["matched"])
        for rows in (report["ledger_additions"], report["po_missing"].select("batch_id", "invoice_number", "cited_po", "reason"), report["invoice_missing"]):
            assert not [w for w in ("ratio_plain", "Window", "total_cents_2") if w in plan_of(rows)]


def test_split_billing_reads_the_matches_once(docs):
    """Sums of an order's invoices lie beside them: the joins of invoices and orders are not made a second time for the sums."""
    with reconcile(docs) as report:
        assert plan_of(report["matched"].select("inv", "status")).count("collect_list") == 1


def test_one_number_twice_is_no_split_billing(spark):
    """An order billed twice under one number, or under none, is not billed in parts, whatever lies beside it."""
    batches = {"twice": [inv("R-1", "60", "PO-5"), inv("r-1", "60", "PO-5"), po("PO-5", "60")], "none": [inv(None, "60", "PO-5"), inv(None, "60", "PO-5"), po("PO-5", "60")], "many": [inv("A", "60", ["PO-1", "PO-2"]), inv("B", "60", ["PO-1", "PO-2"]), po("PO-1", "30"), po("PO-2", "30")]}
    rows = [(b, k, f"{b}-{k}", json.dumps(d)) for b, ds in batches.items() for k, d in enumerate(ds)]
    files = spark.createDataFrame(rows, "batch_id string, index int, filename string, j string").withColumn("doc", F.from_json("j", READER_DOC))
    with reconcile(canonical(files)) as report:
        got = {(r["batch_id"], r["inv"]): (r["relationship"], r["split_invoices"], r["split_cumulative"]) for r in report["matched"].collect()}
    assert got == {(b, k): ("invoice-spans-POs" if b == "many" else "one-to-one", None, None) for b in batches for k in (0, 1)}


def test_an_invoice_meets_each_vendor_of_its_number_once(spark):
    """Records that repeat one number are brought down to the first of each vendor before the join; the first alike one is found."""
    old = [(k, ("Other House", "Acme Corp")[k % 2], "I-1", "2025-12-01", 100, "USD", None, None, None, "f", "old", None) for k in range(100)]
    ledger = spark.createDataFrame(old, "seq long, " + LEDGER)
    bills = spark.createDataFrame([("b", 0, "ACME corp", "i-1", 100, None), ("b", 1, "Nobody", "I-1", 100, None)], "batch_id string, index int, vendor string, invoice_number string, total_cents long, date string")
    found = cross_run_duplicates(bills, ledger)
    assert [tuple(r) for r in found.collect()] == [("b", 0, "EXACT", 1)]
    assert "Aggregate [_n" in plan_of(found)


def test_names_travel_only_where_they_are_asked_for(spark, docs):
    """Possible duplicates meet by number, date and amount, and names are looked up for them once; where all sides have tax ids no pair carries names (F3, F4)."""
    from ledgerweave.plans.registry import QUERIES

    with reconcile(docs) as report:
        assert plan_of(report["duplicates"]).count("coalesce(_key") == 1
    plan = plan_of(QUERIES["batch_matched"](spark, "/root/testdata/sf0.001"))
    assert plan.count("coalesce(_key") == 1


def test_a_stored_table_leaves_nothing_on_tasks_disks(spark):
    """What tasks sent each other for a table goes when the table is written, not when the driver collects garbage (F3, F4)."""
    import time

    from ledgerweave.operators.tables import CLEANUP, Stored

    files = lambda: {str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if "shuffle_" in str(f)}
    before, was = files(), spark.conf.get(CLEANUP)
    with Stored(spark) as tables:
        assert tables.write(spark.range(1000).repartition(3, "id")).count() == 1000
        # the count sends a row a task, which stays; the write sent 1,000
        for _ in range(20):
            left = files() - before
            if len(left) <= 16:
                break
            time.sleep(0.5)
        ids = {f.split("shuffle_")[1].split("_")[0] for f in left}
    assert len(ids) <= 1 and spark.conf.get(CLEANUP) == was
