"""Register sheets: every header word, many sheets at once, money columns that somebody has to choose between."""

from ledgerweave.sources.readers import REGISTER_SYNONYMS, register, register_cells, register_columns, register_questions


def cells(spark, sheets):
    """{sheet: {(row, col): value}} as cells."""
    rows = [("b", s, r, c, v) for s, grid in sheets.items() for (r, c), v in grid.items()]
    return spark.createDataFrame(rows, "workbook string, sheet string, row int, col int, value string")


def test_every_word(spark):
    sheets = {f"{f}-{k}": {(0, 0): w.title().replace("Bill #", "BILL #"), (1, 0): "x"} for f, ws in REGISTER_SYNONYMS.items() for k, w in enumerate(ws)}
    got = {r["sheet"]: r["field"] for r in register_columns(cells(spark, sheets)).collect()}
    assert got == {s: s.split("-")[0] for s in sheets}


def test_a_ledger_with_voucher_words(spark):
    head = ["Voucher No", "Voucher Date", "Party", "Sub Total", "Total Tax", "Grand Total"]
    grid = {(3, k): w for k, w in enumerate(head)} | {(4, k): v for k, v in enumerate(["V-1", "2025-05-01", "Acme", "100", "18", "118"])}
    (r,) = register(cells(spark, {"s": grid})).collect()
    assert (r["sheet"], r["register_row"], r["invoice_no"], r["vendor_name"], float(r["taxable"]), float(r["gst_total"]), float(r["total"]), r["total_derived"]) == ("s", 4, "V-1", "Acme", 100.0, 18.0, 118.0, False)


def test_two_columns_for_one_field(spark):
    """Words that are listed first win; money is asked about, and the answer is taken."""
    head = ["Ref No", "Invoice No", "Supplier", "Amount", "Net Amount", "Date"]
    grid = {(0, k): w for k, w in enumerate(head)} | {(1, k): v for k, v in enumerate(["R", "I-1", "Acme", "7", "5", "2025-05-01"])}
    one = cells(spark, {"s": grid})
    (r,) = register(one).collect()
    assert r["invoice_no"] == "I-1" and r["taxable"] is None
    (q,) = register_questions(one).collect()
    assert (q["field"], [tuple(c) for c in q["candidates"]]) == ("taxable", [("Amount", 3), ("Net Amount", 4)])
    forced = spark.createDataFrame([("b", "s", "taxable", 4)], "workbook string, sheet string, field string, col int")
    (r,) = register(one, forced).collect()
    assert float(r["taxable"]) == 5.0 and register_questions(one, forced).collect() == []


def test_hundreds_of_sheets_at_once(spark):
    """Sheet k: header in row k % 5 at columns moved by k % 3, k % 4 + 1 postings, a blank row, more rows."""
    lines = []
    for k in range(400):
        at, off = k % 5, k % 3
        rows = {at: ["Vendor", "Bill #", "Basic", "GST"]} | {at + 1 + i: [f"F{k}", f"B{i}", str(10 + i), "1"] for i in range(k % 4 + 1)} | {at + k % 4 + 3: ["late", "Z", "1", "1"]}
        lines += [("w", f"s{k}", f"{r} {c + off} {v}") for r, vs in rows.items() for c, v in enumerate(vs)]
    text = spark.createDataFrame(lines, "workbook string, sheet string, value string").repartition(4)
    got = {(r["sheet"], r["register_row"], r["vendor_name"], r["invoice_no"], float(r["total"])) for r in register(register_cells(text)).collect()}
    assert got == {(f"s{k}", k % 5 + 1 + i, f"F{k}", f"B{i}", 11.0 + i) for k in range(400) for i in range(k % 4 + 1)}
    assert register(cells(spark, {"s": {(0, 0): None}})).collect() == []
