"""Single-invoice decisions on documents and master data built here."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.extraction import extract, ingest
from ledgerweave.operators.invoices import decide_invoices
from ledgerweave.sources.readers import ledger_defaults, order_defaults, vendor_defaults

VENDORS = [
    (0, "V001", "Northwind Traders Inc", ["Northwind"], True, "NET30"),
    (1, "V002", "Globex Corporation", ["Globex Corp"], True, "NET30"),
    (2, "V003", "Initech LLC", ["Initech"], True, "NET45"),
    (3, "V004", "Umbrella Supplies Ltd", [], True, "NET30"),
]
ORDERS = [
    (0, "PO-1001", "V001", "12500.00", "USD", "open", False, "Chairs"),
    (1, "PO-1002", "V002", "8000.00", "USD", "open", False, "Consulting"),
    (2, "PO-1003", "V003", "50000.00", "USD", "open", True, "Build"),
    (3, "PO-1004", "V004", "6750.00", "USD", "open", False, "Cleaning"),
]
LEDGER = [
    (0, "INI-1", "V003", "PO-1003", "22000.00", "2026-03-01", "22000.00", "AUTO_APPROVE"),
    (1, "INI-2", "V003", "PO-1003", "24000.00", "2026-04-01", "24000.00", "AUTO_APPROVE"),
    (2, "UMB-7", "V004", "PO-1004", "6750.00", "2026-06-15", "6750.00", "AUTO_APPROVE"),
]
DOCS = {
    "01": "Northwind Traders Inc\n1 Main Street\nInvoice Number: NW-5501\nInvoice Date: 2026-06-12\nPO Number: PO-1001\nDescription Qty Unit Price Amount\nOffice chair 10 $1,150.00 $11,500.00\nSubtotal: $11,500.00\nTax: $1,000.00\nTotal Due: $12,500.00\n",
    "02": "Globex Corporation\nBill Number: GBX-77\nDate of Issue: 18 Jun 2026\nPurchase Order: PO-1002\nSubtotal: $7,000.00\nVAT: $1,540.00\nAmount Payable: $8,540.00\n",
    "03": "Initech LLC\nInvoice No: INI-3\nInvoice Date: 2026-06-20\nPO Ref: PO-1003\nProgress milestone three of the build\nGrand Total: $12,000.00\n",
    "04": "Umbrella Supplies Ltd\nInvoice Number: UMB-8\nInvoice Date: 2026-06-15\nPO Number: PO-1004\nSubtotal: $6,750.00\nTax: $0.00\nTotal Due: $6,750.00\n",
    "05": "Globex Corp\nStatement of services rendered\nDate: 2026-06-21\nSubtotal: $3,000.00\nTax: $330.00\nTotal: $3,500.00\n",
    "06": " scan ",
}


@pytest.fixture(scope="module")
def decided(spark):
    docs = spark.createDataFrame([(k, v, "pdf") for k, v in DOCS.items()], "doc_id string, raw_text string, kind string")
    vendors = vendor_defaults(spark.createDataFrame(VENDORS, "seq int, vendor_id string, name string, aliases array<string>, approved boolean, payment_terms string"))
    orders = order_defaults(spark.createDataFrame(ORDERS, "seq int, po_number string, vendor_id string, total_amount string, currency string, status string, allow_partial boolean, description string"))
    ledger = ledger_defaults(spark.createDataFrame(LEDGER, "seq int, invoice_number string, vendor_id string, po_number string, total string, invoice_date string, amount_applied string, decision string"))
    out = decide_invoices(extract(ingest(docs, kind_col="kind")), vendors, orders, ledger)
    rows = out.select("*", F.transform("findings", lambda f: f["code"]).alias("codes")).collect()
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize(
    "doc, outcome, confidence, codes",
    [
        ("01", "AUTO_APPROVE", 0.98, {"AMOUNT_WITHIN_TOLERANCE", "MATH_RECONCILES", "PO_FOUND_EXPLICIT", "NO_DUPLICATE"}),
        ("02", "HOLD_FOR_APPROVAL", 0.75, {"AMOUNT_OVER_TOLERANCE"}),
        ("03", "REJECT", 0.95, {"CUMULATIVE_OVERBILL"}),
        ("04", "NEEDS_REVIEW", 0.60, {"DUPLICATE_NEAR", "SECOND_INVOICE_ON_SINGLE_PO"}),
        ("05", "NEEDS_REVIEW", 0.60, {"TOTAL_DOESNT_RECONCILE", "MISSING_CRITICAL_FIELDS", "PO_UNRESOLVED"}),
        ("06", "NEEDS_REVIEW", 0.60, {"DOCUMENT_UNREADABLE"}),
    ],
)
def test_outcomes(decided, doc, outcome, confidence, codes):
    row = decided[doc]
    assert row["decision"]["outcome"] == outcome, row["codes"]
    assert row["decision"]["confidence"] == pytest.approx(confidence)
    assert codes <= set(row["codes"])


def test_extracted_fields(decided):
    one = decided["01"]
    assert (one["invoice_number"], str(one["invoice_date"]), one["po_reference"]) == ("NW-5501", "2026-06-12", "PO-1001")
    assert one["total"] == Decimal("12500.00") and one["subtotal"] == Decimal("11500.00") and one["tax"] == Decimal("1000.00")
    assert [(i["description"], i["quantity"], i["unit_price"], i["amount"]) for i in one["line_items"]] == [("Office chair", Decimal("10"), Decimal("1150.00"), Decimal("11500.00"))]
    assert one["extraction_confidence"] == pytest.approx(0.98 * (0.95 + 0.95 + 0.95 + 0.62) / 4, abs=1e-3)
    assert decided["02"]["total"] == Decimal("8540.00") and str(decided["02"]["invoice_date"]) == "2026-06-18"
    assert decided["06"]["match_basis"] == "skipped-unreadable" and decided["06"]["codes"] == ["DOCUMENT_UNREADABLE"]
    assert decided["03"]["decision"]["reasons"][0].startswith("[CUMULATIVE_OVERBILL]")
