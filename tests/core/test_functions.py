"""Scalar functions on literals."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import dates, money, names, text
from ledgerweave.functions.fuzzy import ratio


def values(spark, function, given, kind="string"):
    rows = spark.createDataFrame([(k, g) for k, g in enumerate(given)], f"k int, x {kind}")
    return [r[0] for r in rows.select("k", function(F.col("x")).alias("y")).orderBy("k").select("y").collect()]


@pytest.mark.parametrize(
    "function, given, want",
    [
        (money.parse_money, ["$1,234.56", "USD 900", "(120.00)", "n/a", "1,5", "1,234", "", None, "-7", "€1.234,50"], [Decimal("1234.56"), Decimal("900.00"), Decimal("-120.00"), None, Decimal("1.50"), Decimal("1234.00"), None, None, Decimal("-7.00"), Decimal("1.23")]),
        (money.to_cents, ["$1,234.56", "(120.00)", "Rs 10", "-", "", None, "0.005"], [123456, -12000, 1000, None, None, None, 1]),
        (money.to_number, ["₹1,000", "18%", "(5)", "", "x"], [1000.0, None, 5.0, None, None]),
        (money.first_number, ["11,800.00 (incl. GST)", "none", "-3"], [11800.0, None, -3.0]),
        (money.tax_fraction, ["18%", "0.18", "", None], [0.18, 0.18, None, None]),
        (dates.parse_date, ["2026-06-12", "12 Jun 2026", "12/06/2026", "06/25/2026", "June 3, 2026", "3.6.2026", "sometime", None, "31-Dec-2025"], [dt.date(2026, 6, 12), dt.date(2026, 6, 12), dt.date(2026, 6, 12), dt.date(2026, 6, 25), dt.date(2026, 6, 3), dt.date(2026, 6, 3), None, None, dt.date(2025, 12, 31)]),
        (dates.parse_date_text, ["2026-6-1", "10 June 2026", "Jun 5, 2026", "13/02/2026", "02/13/2026", "31-02-2026", "x"], ["2026-06-01", "2026-06-10", "2026-06-05", "2026-02-13", "2026-02-13", "2026-02-31", None]),
        (dates.to_iso, ["10-06-2025", "1 Jan 2026", "2025-06-10", "soon"], ["2025-06-10", "2026-01-01", "2025-06-10", "soon"]),
        (names.vendor_name, ["Initech, Inc.", "Initech Inc", "x inc llc", " ACME  Corp ", "Globex Corporation"], ["initech inc", "initech", "x inc", "acme", "globex"]),
        (names.company_name, ["The Acme & Co. Pvt Ltd", None], ["acme", ""]),
        (names.order_key, ["po-1001", "PO 1001", "#1001", "1001"], ["1001"] * 4),
        (names.cited_order, ["po 77", "see 1234", "none"], ["PO77", "PO-1234", None]),
        (names.clean_order, ["PO1001", "pr 2390", "1001", "x"], ["PO-1001", "PR-2390", "PO-1001", None]),
        (names.batch_order_key, ["PO-1001", "PR 1001", "1001"], ["1001"] * 3),
        (names.invoice_key, ["000-12/a", "12A"], ["12A", "12A"]),
        (names.tax_id, ["27aaaaa 1111a1z1", "", "--"], ["27AAAAA1111A1Z1", None, None]),
        (text.code_valid, ["3917", "39171", "996609", "9405XX", "", None], [True, False, True, False, None, None]),
        (text.product_name, ["PVC Bend, 20 mm (set of 2)", "Elbow size 20"], ["pvc elbow 20 2", "elbow 20"]),
        (text.page_kind, ["Tax Invoice no 4", "GRN 7", "PURCHASE ORDER", "page two"], ["invoice", "grn", "po", "continuation"]),
        (text.cite_page, ["3", "0", "x", None], [3, 1, 1, 1]),
        (text.csv_cell, ['a "b"', "a,b", "plain", None, "x\ny"], ['"a ""b"""', '"a,b"', "plain", "", '"x\ny"']),
        (text.sheet_safe, ['a "b"|c\nd'], ["a 'b'/c d"]),
        (text.media_type, ["a.PNG", "image/jpeg", "x.pdf", None], ["image/png", "image/jpeg", "application/pdf", "application/pdf"]),
        (text.currency_of, ["12 €", "INR 4", "x", "£ and $"], ["EUR", "INR", None, "USD"]),
    ],
)
def test_values(spark, function, given, want):
    assert values(spark, function, given) == pytest.approx(want) if want and isinstance(want[0], float) and None not in want else values(spark, function, given) == want


def test_formats(spark):
    row = spark.range(1).select(
        money.money_text(F.lit("-5").cast("decimal(18,2)")), money.money_text(F.lit(None).cast("decimal(18,2)")), money.cents_text(F.lit(-500)), money.cents_text(F.lit(123456)), money.percent_text(F.lit(54), F.lit(800)), money.percent_text(F.lit(1), F.lit(0)),
        money.round_to(F.lit(2.675), 2), money.amounts_equal(F.lit(1000.0), F.lit(1005.0)), money.amounts_equal(F.lit(1000.0), F.lit(1006.1)), money.amounts_equal(F.lit(None).cast("double"), F.lit(1.0)),
        text.same_product(F.lit("PVC bend 20mm"), F.lit("PVC elbow 20 mm")), text.same_product(F.lit("bend"), F.lit("coupler")), text.page_range(F.lit(2), F.lit(4)),
    ).first()
    assert list(row) == ["$-5.00", "—", "-$5.00", "$1,234.56", "6.8", "0.0", pytest.approx(2.68), True, False, None, True, False, "2-4"]
    assert [text.column_letters(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_ratio(spark):
    from difflib import SequenceMatcher

    pairs = [("acme", "acme ltd"), ("globex", "globx"), ("", ""), ("abc", None)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() if b is not None else None for a, b in pairs]
