"""The sheet of all lines: every receipt and order line once, attachment by product, by likeness and by elimination, formulas against states."""

import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.fourway import INVOICE, ORDER, RECEIPT_LINE, REGISTER, four_way
from ledgerweave.operators.linesheet import COLUMNS, full_line_sheet, with_formulas
from ledgerweave.operators.tables import Stored

G = "27AAAAA1111A1Z1"


def line(no, text, qty, rate=100.0, hsn="3917"):
    return {"line_no": no, "description": text, "hsn_sac": hsn, "quantity": qty, "rate": rate, "unit_price": rate, "gst_rate": 0.18, "amount": qty * rate}


@pytest.fixture(scope="module")
def sheet(spark):
    bill = {"invoice_number": "INV-1", "invoice_date": "2025-08-20", "vendor_name": "Acme", "vendor_gstin": G, "total": 3000.0, "taxable_total": 2900.0, "tax_total": 100.0, "references": [{"value": "PO-1", "kind": "buyer_pr_po"}, {"value": "PO-2", "kind": "buyer_pr_po"}]}
    bill["lines"] = [line(1, "PVC elbow 20mm", 10.0), line(2, "Cement", 20.0, 99.0, "2523"), line(3, "Anchor bolts M8", 5.0, hsn="12"), line(4, "Delivery", 1.0, hsn=None)]
    order = lambda no, lines: {"po_number": no, "vendor_name": "Acme", "vendor_gstin": G, "requisition_date": "2025-08-01", "total": 1500.0, "po_itemized": True, "lines": lines}
    orders = [("p1", order("PO-1", [line(1, "PVC elbow 20mm", 8.0), line(2, "Paint", 3.0, hsn="3208"), line(3, "Primer", 1.0, hsn="3209")])), ("p2", order("PO-2", [line(1, "Cement", 20.0, hsn="2523"), line(2, "Anchor bolts M8", 5.0, hsn="7318")]))]
    got = [
        ("G1", "PO-1", "2025-08-05", [("elbow pvc 20mm", None, 4.0, None, None)]),  # alike
        ("G2", "PO-1", "2025-08-06", [("PVC elbow 20mm", None, 6.0, None, None), ("Sand", None, 3.0, None, None)]),  # sand is on no line
        ("G3", "PO-2", "2025-08-12", [("Cement", None, 15.0, None, None)]),
        ("G4", "PO-2", "2025-08-13", [("Fasteners", None, 5.0, None, None)]),
    ]
    make = lambda rows, key, col, kind: spark.createDataFrame([(k, json.dumps(j)) for k, j in rows], f"{key} string, j string").select(key, F.lit(None).cast("string").alias("bundle_id"), F.lit(None).cast("string").alias("site"), F.from_json("j", kind).alias(col))
    reg = spark.createDataFrame([(1, "Acme", G, "INV-1", "2025-08-25", None, None, 2900.0, 100.0, 3000.0), (2, "None", None, "X", "2025-08-25", None, None, 1.0, 0.0, 1.0)], REGISTER)
    grns = spark.createDataFrame([(g, p, "Acme", G, d, x) for g, p, d, x in got], f"grn_number string, po_number string, vendor_name string, vendor_gstin string, receipt_date string, lines array<{RECEIPT_LINE}>")
    with Stored(spark) as tables:
        return tables.write(with_formulas(full_line_sheet(four_way(reg, make([("i1", bill)], "inv_id", "invoice", INVOICE), make(orders, "po_id", "order", ORDER), grns), tables=tables), tables)).orderBy("sheet_row").collect()


def test_every_line_once(sheet):
    rows = sheet
    assert len(COLUMNS) == 26 and set(COLUMNS) <= set(rows[0].asDict())
    assert [(r["part"], r["line_no"], r["po_no"], r["po_line_no"], r["grn_no"], r["qty_received"]) for r in rows] == [
        ("billed", 1, "PO-1", 1, "G1", 4.0), ("billed", None, None, None, "G2", 6.0), ("billed", 2, "PO-2", 1, "G3", 15.0), ("billed", 3, "PO-2", 2, None, None), ("billed", 4, None, None, None, None),
        ("grn_only", None, None, None, "G2", 3.0), ("grn_only", None, None, None, "G4", 5.0), ("po_only", None, "PO-1", 2, None, None), ("po_only", None, "PO-1", 3, None, None),
    ]
    states = [tuple(r[c] for c in ("hsn_valid", "rate_match", "over_receipt", "over_billing", "line_match", "item_match")) for r in rows]
    assert states[:2] == [("✓", "✓", "✗", "✓", "✓", "✓"), (None,) * 6] and states[2] == ("✓", "✗", "✓", "✗", "✓", "✓")
    assert states[3] == ("✗", "✓", "—", "—", "✓", "—") and states[4][4:] == ("✗", "✗") and set(states[5]) == {"—"}
    assert [r["sheet_row"] for r in rows] == list(range(3, 12)) and {r["register_row"] for r in rows} == {1}


def test_elimination_alone(spark):
    """Receipts of one product that is like no line's belong to the only line without receipts; beside a second product they do not."""
    bill = spark.createDataFrame([(1, 0, None, "bolts", None, False), (1, 1, None, "cement", None, False)], "register_row int, k int, key string, own string, ordered string, lump_sum boolean")
    bill = bill.withColumn("x", F.struct(F.col("own").alias("description"), F.col("ordered").alias("po_description")))
    got = spark.createDataFrame([(1, 0, 0, "O", "cement"), (1, 1, 0, "O", "fasteners"), (1, 2, 0, "O", "fasteners")], "register_row int, g int, i int, order string, product string").withColumn("z", F.struct(F.col("product").alias("description")))
    from ledgerweave.operators.linesheet import attached

    assert sorted((r["g"], r["k"]) for r in attached(bill, got).collect()) == [(0, 1), (1, 0), (2, 0)]
    two = got.union(spark.createDataFrame([(1, 3, 0, "O", "sand")], "register_row int, g int, i int, order string, product string").withColumn("z", F.struct(F.col("product").alias("description"))))
    assert sorted((r["g"], r["k"]) for r in attached(bill, two).collect()) == [(0, 1)]


def evaluated(formula, grid):
    """The value of one of the sheet's formulas over cells {name: value}."""
    cell = lambda name: grid.get(name) if grid.get(name) is not None else ""
    added = lambda c, a, b: sum(cell(f"{c}{k}") or 0 for k in range(int(a), int(b) + 1))
    e = re.sub(r"SUM\(([A-Z])(\d+):[A-Z](\d+)\)", lambda m: f"added('{m[1]}',{m[2]},{m[3]})", formula[1:])
    e = re.sub(r"(?<![A-Z'\"])([A-Z]\d+)\b", r"cell('\1')", e)
    e = re.sub(r"(?<![<>])=", "==", e)
    number = lambda v: str(v).isdigit()
    functions = {"IF": lambda c, a, b: a if c else b, "OR": lambda *x: any(x), "AND": lambda *x: all(x), "ISNUMBER": lambda v: v, "VALUE": number, "LEN": lambda v: len(str(v)), "ABS": abs, "cell": cell, "added": added}
    lazy = re.sub(r"IF\((.*)\)$", lambda m: m[0], e)
    return eval(lazy, {"__builtins__": {}}, functions | {"ABS": lambda v: abs(v)}) if '""' not in lazy or all(cell(x) != "" for x in re.findall(r"cell\('([A-Z]\d+)'\)==\"\"", lazy)) else "—"


def test_formulas_equal_the_states(sheet):
    rows = sheet
    grid = {f"{chr(65 + k)}{r['sheet_row']}": r[c] for r in rows for k, c in enumerate(COLUMNS)}
    for r in rows:
        if r["part"] == "billed" and r["place"] == 0:
            for c in ("hsn_valid", "rate_match", "over_receipt", "over_billing"):
                assert evaluated(r[f"{c}_formula"], grid) == r[c], (c, r)
        elif r["place"]:
            assert r["rate_match_formula"] is None
