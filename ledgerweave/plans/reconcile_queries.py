"""Whole reconciliations on the driver's tables: batches, chains, vouching, texts, cells and payloads, each with SQL for its result.

The documents are made of orders and their bills; which case an order stands for
follows from its number, so the SQL states the outcome case by case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.batch import LEDGER, READER_DOC, canonical, reconcile
from ..operators.fourway import RECEIPT_LINE, consolidated, coverage_counts, four_way, invoice_keys, item_match, postings, vouch
from ..operators.guards import order_gate, outcome_rows, public_documents, public_ledger, receipt_gate
from ..operators.linesheet import full_line_sheet
from ..operators.matching import covered_once
from ..operators.sinks import augmented_register, chain_bands, line_sheet
from ..operators.tables import Stored
from ..operators.twoway import INVOICE, LINE, ORDER
from ..policy import MatchPolicy
from .queries import _WHOLE, bills, orders, query

# -- batches -------------------------------------------------------------------

#: Cases by order number modulo 10: 0 no order document, 1 no invoice, 2 two invoices of a third and the rest, 3 unreadable,
#: 4 the invoice twice, 5 no citation but tax id and total, 6 no citation, tax id alone, 7 two orders of one half each, else plain.
_CASE = "order_id % 10"
_DOC = "struct<doc_type:string,doc_number:string,po_reference:string,po_references:array<string>,total:string,confidence:double>"


def batch_documents(spark, d) -> DataFrame:
    """batch_id (the customer), index, filename, doc: reader answers."""
    last = bills(spark, d).groupBy("order_id").agg(F.sum("cents").alias("cents"), F.max("bill_date").alias("day"))
    rows = orders(spark, d).join(last, "order_id").withColumn("case", F.expr(_CASE))
    n, case = F.col("order_id").cast("string"), F.col("case")
    money = lambda c: F.concat(F.lit("$"), F.format_number((c.cast("decimal(18,2)") / 100).cast("decimal(18,2)"), 2))
    vendor, tax = F.concat(F.lit("Firm "), F.reverse(n), F.lit(" of "), F.sha2(n, 256)), F.concat(F.lit("27AAAAA"), F.lpad(n, 8, "0"))
    none = F.lit(None)

    def doc(kind, number, ref, refs, total, sure=0.9):
        fields = (F.lit(kind), number, ref, refs, total, F.lit(sure) if isinstance(sure, float) else sure)
        return F.struct(*fields).cast(_DOC)

    number, po, third = F.concat(F.lit("INV-"), n), F.concat(F.lit("PO-"), n), F.floor(F.col("cents") / 3)
    cited = F.when(~case.isin(5, 6, 7), po)
    both = F.when(case == 7, F.array(po, F.concat(po, F.lit("9"))))
    billed = F.when(case == 2, third).when(case == 5, F.col("po_cents")).when(case == 6, F.col("po_cents") * 2).otherwise(F.col("cents"))
    ordered = F.when(case == 7, F.floor(F.col("po_cents") / 2)).otherwise(F.col("po_cents"))
    docs = F.array(
        F.when(case != 1, doc("invoice", number, cited, both, money(billed), F.when(case == 3, 0.2).otherwise(0.9))),
        F.when(case == 2, doc("invoice", F.concat(number, F.lit("B")), cited, both, money(F.col("cents") - third))),
        F.when(case == 4, doc("Tax Invoice", F.lower(number), cited, both, money(F.col("cents")))),
        F.when(case != 0, doc("purchase_order", po, none, none, money(ordered))),
        F.when(case == 7, doc("Purchase Order", F.concat(po, F.lit("9")), none, none, money(F.col("po_cents") - ordered))),
    )
    # what all documents of an order share stays beside them
    shared = rows.withColumns({"vendor": vendor, "tax": tax, "date": F.col("day").cast("string")})
    rows = shared.select("cust", "order_id", "vendor", "tax", "date", F.posexplode(docs).alias("k", "x")).where("x is not null")
    sure = F.struct(*(F.col("x.confidence").alias(c) for c in ("doc_number", "vendor", "total")))
    x = {c: F.col(f"x.{c}") for c in ("doc_type", "doc_number", "po_reference", "po_references", "total")}
    answer = F.struct(
        x["doc_type"].alias("doc_type"), x["doc_number"].alias("doc_number"), x["po_reference"].alias("po_reference"), x["po_references"].alias("po_references"),
        F.col("vendor").alias("vendor_name"), F.col("tax").alias("seller_gstin"), none.cast("string").alias("buyer_gstin"), x["total"].alias("total"),
        none.cast("string").alias("taxable_total"), none.cast("string").alias("tax_total"), none.cast("string").alias("currency"), F.col("date"),
        F.array().cast("array<struct<description:string,hsn_sac:string,quantity:string,unit_price:string,gst_rate:string,amount:string>>").alias("line_items"),
        sure.alias("field_confidence"), F.lit(True).alias("text_layer_present"),
    ).cast(READER_DOC)
    return rows.select(F.col("cust").cast("string").alias("batch_id"), (F.col("order_id") * 5 + F.col("k")).cast("int").alias("index"), none.cast("string").alias("filename"), answer.alias("doc"))


def batch_ledger(spark, d) -> DataFrame:
    """Every seventh order was billed before: one bill of twice its total; every fifth of these under the invoice's own number."""
    last = bills(spark, d).groupBy("order_id").agg(F.sum("cents").alias("cents"))
    rows = orders(spark, d).join(last, "order_id").where("order_id % 7 = 0")
    n = F.col("order_id").cast("string")
    number = F.when(F.col("order_id") % 35 == 0, F.concat(F.lit("inv-"), n)).otherwise(F.concat(F.lit("OLD-"), n))
    vendor = F.concat(F.lit("Firm "), F.reverse(n), F.lit(" of "), F.sha2(n, 256))
    none = F.lit(None)
    types = dict(f.split() for f in LEDGER.split(", "))
    own = {"vendor": vendor, "invoice_number": number, "invoice_date": F.lit("1990-01-01"), "amount_cents": F.col("po_cents") * 2, "currency": F.lit("USD"), "po_number": F.concat(F.lit("PO "), n), "po_total_cents": F.col("po_cents")}
    return rows.select(F.col("order_id").alias("seq"), *(own.get(c, none).cast(t).alias(c) for c, t in types.items()))


def _tables(spark, d, memory: bool = False) -> dict[str, DataFrame]:
    return reconcile(canonical(batch_documents(spark, d)), batch_ledger(spark, d) if memory else None)


_MADE = f"""{_WHOLE}, c AS (SELECT *, order_id % 10 AS k, cents // 3 AS third FROM w),
i AS (SELECT cust, order_id, k, 0 AS place, 'INV-' || order_id AS invoice_number, CASE k WHEN 2 THEN third WHEN 5 THEN po_cents WHEN 6 THEN po_cents * 2 ELSE cents END AS inv_cents, po_cents FROM c WHERE k <> 1
 UNION ALL SELECT cust, order_id, k, 1, 'INV-' || order_id || 'B', cents - third, po_cents FROM c WHERE k = 2 UNION ALL SELECT cust, order_id, k, 2, 'inv-' || order_id, cents, po_cents FROM c WHERE k = 4)"""
_BATCH_BAND, _BATCH_AUTO = "greatest(CAST(floor(po_cents * 0.10 + 0.5) AS BIGINT), 250000)", "greatest(CAST(floor(po_cents * 0.02 + 0.5) AS BIGINT), 10000)"
_PAIR = f"CASE WHEN abs(inv_cents - po_cents) <= {_BATCH_AUTO} THEN 'MATCHED' WHEN abs(inv_cents - po_cents) <= {_BATCH_BAND} THEN 'VARIANCE' ELSE 'MISMATCH' END"
#: Matched invoices: all of the cases but those without an order document and the unreadable ones.
_MATCHED = f"""{_MADE}, m AS (SELECT *, {_PAIR} AS pair_status, CASE WHEN k = 7 THEN 'invoice-spans-POs' WHEN k = 2 THEN 'split-billing' ELSE 'one-to-one' END AS relationship,
CASE WHEN k = 7 THEN 'PR/PO number (×2)' WHEN k = 5 THEN 'fingerprint (GSTIN + total)' WHEN k = 6 THEN 'possible (GSTIN only, total off)' ELSE 'PR/PO number' END AS basis,
sum(inv_cents) OVER (PARTITION BY order_id) AS together FROM i WHERE k NOT IN (0, 3))"""


@query("batch_matched", f"""WITH {_MATCHED} SELECT CAST(cust AS VARCHAR) AS batch_id, invoice_number, 'PO-' || order_id AS po_number, relationship, basis,
CASE WHEN k = 2 AND together - po_cents > {_BATCH_BAND} THEN 'MISMATCH' WHEN k = 2 THEN 'PARTIAL' ELSE pair_status END AS status, pair_status AS pre_split_status,
CASE pair_status WHEN 'MATCHED' THEN 0.98 WHEN 'VARIANCE' THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence, CAST(inv_cents AS BIGINT) AS invoice_cents, CAST(po_cents AS BIGINT) AS po_cents, CAST(abs(inv_cents - po_cents) AS BIGINT) AS delta_cents,
CASE WHEN k = 2 THEN CAST(together AS BIGINT) END AS split_cumulative, k = 4 AS duplicate FROM m""")
def batch_matched(spark, d):
    """Invoices and orders of a batch, many to many, claimed in upload order, with status, split billing and duplicates."""
    cols = ("relationship", "basis", "status", "pre_split_status", "confidence", "invoice_cents", "po_cents", "delta_cents", "split_cumulative", "duplicate")
    return _tables(spark, d)["matched"].select("batch_id", "invoice_number", F.get("po_numbers", F.lit(0)).alias("po_number"), *cols)


@query("batch_po_missing", f"WITH {_MADE} SELECT CAST(cust AS VARCHAR) AS batch_id, invoice_number, 'PO-' || order_id AS cited_po, 'cites an order that is not here: PO-' || order_id AS reason FROM i WHERE k = 0")
def batch_po_missing(spark, d):
    return _tables(spark, d)["po_missing"].select("batch_id", "invoice_number", "cited_po", "reason")


@query("batch_invoice_missing", f"WITH {_MADE} SELECT CAST(cust AS VARCHAR) AS batch_id, 'PO-' || order_id AS po_number, CAST(po_cents AS BIGINT) AS total_cents FROM c WHERE k IN (1, 3)")
def batch_invoice_missing(spark, d):
    return _tables(spark, d)["invoice_missing"].select("batch_id", "po_number", "total_cents")


@query("batch_unreadable", f"WITH {_MADE} SELECT CAST(cust AS VARCHAR) AS batch_id, CAST(order_id * 5 AS INTEGER) AS index, 'low extraction confidence (20%)' AS reason FROM c WHERE k = 3")
def batch_unreadable(spark, d):
    return _tables(spark, d)["unreadable"].select("batch_id", "index", "reason")


@query("batch_duplicates", f"WITH {_MADE} SELECT CAST(cust AS VARCHAR) AS batch_id, CAST(order_id * 5 AS INTEGER) AS a, CAST(order_id * 5 + 2 AS INTEGER) AS b, 'EXACT' AS kind FROM c WHERE k = 4")
def batch_duplicates(spark, d):
    return _tables(spark, d)["duplicates"].select("batch_id", "a", "b", "kind")


_COUNTS = "count(*) FILTER (WHERE k NOT IN (0, 3))"


@query("batch_summary", f"""WITH {_MADE}, one AS (SELECT cust, count(*) AS n, count(*) FILTER (WHERE k = 3) AS unreadable, count(*) FILTER (WHERE k <> 3) AS inv, {_COUNTS} AS matched, count(*) FILTER (WHERE k = 0) AS gone FROM i GROUP BY ALL),
two AS (SELECT cust, sum(CASE k WHEN 0 THEN 0 WHEN 7 THEN 2 ELSE 1 END) AS pos, count(*) FILTER (WHERE k IN (1, 3)) AS lone, count(*) FILTER (WHERE k = 4) AS dup, count(*) FILTER (WHERE k = 7) AS spans FROM c GROUP BY ALL)
SELECT CAST(cust AS VARCHAR) AS batch_id, CAST(coalesce(n, 0) + pos AS BIGINT) AS documents, CAST(coalesce(unreadable, 0) AS BIGINT) AS unreadable, CAST(coalesce(inv, 0) AS BIGINT) AS invoices, CAST(pos AS BIGINT) AS pos, CAST(coalesce(matched, 0) AS BIGINT) AS matched,
CAST(spans AS BIGINT) AS invoice_spans_pos, CAST(coalesce(gone, 0) AS BIGINT) AS po_missing, CAST(lone AS BIGINT) AS invoice_missing, CAST(dup AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS cross_run_duplicates, CAST(0 AS BIGINT) AS cumulative_flags, CAST(0 AS BIGINT) AS line_flags, CAST(0 AS BIGINT) AS gst_flags
FROM two LEFT JOIN one USING (cust)""")
def batch_summary(spark, d):
    return _tables(spark, d)["summary"].drop("partials")


@query("batch_cross_run_duplicates", f"WITH {_MADE} SELECT CAST(cust AS VARCHAR) AS batch_id, CAST(order_id * 5 + place AS INTEGER) AS index, 'EXACT' AS kind, order_id AS prior_seq FROM i WHERE order_id % 35 = 0 AND k <> 3 AND place IN (0, 2)")
def batch_cross_run_duplicates(spark, d):
    return _tables(spark, d, True)["cross_run_duplicates"].select("batch_id", "index", "kind", "prior_seq")


@query("batch_cumulative_flags", f"""WITH {_MADE}, t AS (SELECT cust, order_id, sum(inv_cents) AS this_batch, max(po_cents) AS po_cents FROM i WHERE order_id % 7 = 0 AND k NOT IN (0, 3, 7) GROUP BY ALL)
SELECT CAST(cust AS VARCHAR) AS batch_id, 'PO-' || order_id AS po_number, CAST(po_cents * 2 AS BIGINT) AS prior_billed, CAST(1 AS BIGINT) AS prior_count, CAST(this_batch AS BIGINT) AS this_batch, CAST(po_cents * 2 + this_batch AS BIGINT) AS cumulative, CAST(po_cents + this_batch AS BIGINT) AS over
FROM t WHERE po_cents + this_batch > {_BATCH_BAND}""")
def batch_cumulative_flags(spark, d):
    rows = _tables(spark, d, True)["cumulative_flags"]
    return rows.select("batch_id", "po_number", "prior_billed", "prior_count", "this_batch", "cumulative", "over")


@query("batch_ledger_additions", f"""WITH {_MADE} SELECT CAST(cust AS VARCHAR) AS batch_id, invoice_number, CAST(inv_cents AS BIGINT) AS amount_cents, 'USD' AS currency,
'PO-' || order_id AS po_number FROM i WHERE k <> 3""")
def batch_ledger_additions(spark, d):
    return _tables(spark, d)["ledger_additions"].select("batch_id", "invoice_number", "amount_cents", "currency", "po_number")


# -- chains ----------------------------------------------------------------------

#: Cases by order number modulo 8: 1 the register names another vendor without a tax id, 2 no invoice, 3 the register's total is
#: doubled, 4 no order document, 5 no receipt, 6 one unit more received than ordered, 7 received before ordered, else plain.
_YEARS = ("1994-01-01", "1996-12-31")
_CHAIN_POLICY = MatchPolicy(profile="F", rate_by_heading=True, fy_start=_YEARS[0], fy_end=_YEARS[1])
_CHAIN = f"""{_WHOLE}, l AS (SELECT order_id, max(bill_date) AS day FROM b GROUP BY ALL), q AS (SELECT order_id, CAST(sum(qty) AS BIGINT) AS qty FROM x GROUP BY ALL),
z AS (SELECT w.*, day, qty, order_id % 8 AS k, abs(cents - po_cents) <= greatest(100, 0.005 * po_cents) AS tie, day BETWEEN DATE '{_YEARS[0]}' AND DATE '{_YEARS[1]}' AS bill_in, po_date BETWEEN DATE '{_YEARS[0]}' AND DATE '{_YEARS[1]}' AS po_in FROM w JOIN l USING (order_id) JOIN q USING (order_id)),
s AS (SELECT *, CASE WHEN k NOT IN (2, 4) THEN tie END AS total_match, CASE WHEN k <> 2 THEN bill_in AND (k = 4 OR po_in) END AS dates_fy, CASE WHEN k <> 2 THEN k <> 3 END AS register_total FROM z)"""


def _made(kind: str, *fields) -> Column:
    """A struct of a kind, field by field: a plan sees through it to the few fields that a step uses, through a cast of the whole it does not."""
    named = zip(fields, StructType.fromDDL(kind).fields, strict=True)
    return F.struct(*(c.cast(f.dataType).alias(f.name) for c, f in named))


def chain_tables(spark, d, tables: Stored | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """register, invoices, orders and receipts: one of each an order, but for the cases.

    All are made of the same rows (an order and the sums of its lines), which are written once.
    """
    day = bills(spark, d, qty=F.sum("qty")).groupBy("order_id").agg(F.sum("cents").alias("cents"), F.max("bill_date").cast("string").alias("day"), F.sum("qty").cast("double").alias("qty"))
    rows = orders(spark, d).select("order_id", "po_cents", "po_date").join(day, "order_id").withColumn("k", F.expr("order_id % 8"))
    rows = (tables or Stored(spark)).write(rows)
    n, k, none = F.col("order_id").cast("string"), F.col("k"), F.lit(None).cast("string")
    firm, tax = F.concat(F.lit("Firm "), n), F.concat(F.lit("27AAAAA"), F.lpad(n, 8, "0"))
    amount = lambda c: (c / 100).cast("double")
    cents, item = F.col("cents"), F.concat(F.lit("Item "), n)
    empty = F.lit(None)
    line = lambda q: F.array(F.struct(F.lit(1), item, none, q, none, empty, empty, empty, empty).cast(LINE))
    cited = F.when(k != 4, F.array(F.struct(F.concat(F.lit("po "), n).alias("value"), F.lit("buyer_pr_po").alias("kind"), F.lit(False).alias("handwritten"))))
    register = rows.select(
        F.col("order_id").cast("int").alias("register_row"), F.when(k == 1, F.concat(F.lit("Other "), n)).otherwise(firm).alias("vendor_name"), F.when(k != 1, tax).alias("vendor_gstin"),
        F.concat(F.lit("inv 00"), n).alias("invoice_no"), F.col("day").alias("booking_date"), none.alias("po_no"), none.alias("site_name"),
        amount(cents).alias("taxable"), F.lit(0.0).alias("gst_total"), amount(F.when(k == 3, cents * 2).otherwise(cents)).alias("total"),
    )
    invoice = _made(INVOICE, F.concat(F.lit("INV-00"), n), F.col("day"), firm, tax, none, cited, amount(cents), F.lit(0.0), amount(cents), line(F.col("qty")))
    order = _made(ORDER, F.concat(F.lit("PO"), n), none, firm, tax, none, F.col("po_date").cast("string"), none, amount(F.col("po_cents")), F.lit(True), line(F.col("qty")))
    place = (none.alias("bundle_id"), none.alias("site"))
    got = F.array(F.struct(item, none, F.when(k == 6, F.col("qty") + 1).otherwise(F.col("qty")), empty, none).cast(RECEIPT_LINE))
    when = F.date_add("po_date", F.when(k == 7, -1).otherwise(1)).cast("string")
    grns = rows.where("k <> 5").select(F.concat(F.lit("G"), n).alias("grn_number"), F.concat(F.lit("PO-"), n).alias("po_number"), firm.alias("vendor_name"), tax.alias("vendor_gstin"), when.alias("receipt_date"), got.alias("lines"))
    invoices = rows.where("k <> 2").select(F.concat(F.lit("i"), n).alias("inv_id"), *place, invoice.alias("invoice"))
    return register, invoices, rows.where("k <> 4").select(F.concat(F.lit("p"), n).alias("po_id"), *place, order.alias("order")), grns


def _chains(spark, d) -> DataFrame:
    tables = Stored(spark)
    return four_way(*chain_tables(spark, d, tables), _CHAIN_POLICY, tables)


_HOP1 = "CASE k WHEN 1 THEN 'Inv No only' ELSE 'Inv No + vendor' END"


@query("four_way_findings", f"""WITH {_CHAIN} SELECT CAST(order_id AS INTEGER) AS register_row, CASE WHEN k = 2 THEN '' WHEN total_match IS FALSE OR NOT dates_fy OR NOT register_total THEN 'No match' ELSE 'Match' END AS result,
CASE WHEN k = 2 THEN 'no invoice' ELSE {_HOP1} || ' → ' || CASE k WHEN 4 THEN 'No PO found' ELSE 'PR/PO number' END END AS chain_basis, CASE k WHEN 2 THEN NULL WHEN 4 THEN 'none' WHEN 1 THEN 'medium' ELSE 'high' END AS chain_confidence,
CASE WHEN k NOT IN (2, 4) THEN TRUE END AS vendor_match, total_match, dates_fy, register_total, CASE WHEN k NOT IN (2, 4, 5) THEN k <> 7 END AS receipt_after_order,
CASE WHEN k <> 2 THEN bill_in END AS booked_after_invoice, CASE WHEN k IN (2, 4) THEN NULL ELSE day >= po_date END AS date_order FROM s""")
def four_way_findings(spark, d):
    """A finding per posting of the register: invoice, order and receipts found backwards, and the checks."""
    cols = ("chain_basis", "chain_confidence", "vendor_match", "total_match", "dates_fy", "register_total", "receipt_after_order", "booked_after_invoice", "date_order")
    return _chains(spark, d).select("register_row", "result", *cols)


@query("four_way_quantities", f"""WITH {_CHAIN} SELECT CAST(order_id AS INTEGER) AS register_row, CASE WHEN k IN (2, 4, 5) THEN '—' WHEN k = 6 THEN 'Over-received 1 item(s)' ELSE 'Ordered ' || qty || ' / Received ' || qty || ' / Billed ' || qty || ' — clean' END AS qty_flow_summary,
CASE WHEN k NOT IN (2, 4, 5) THEN CAST(qty + CASE k WHEN 6 THEN 1 ELSE 0 END AS BIGINT) END AS received, CASE WHEN k NOT IN (2, 4, 5) THEN 'G' || order_id END AS grn, CASE WHEN k NOT IN (2, 4, 5) THEN k <> 6 END AS over_receipt_ok, CASE WHEN k NOT IN (2, 4, 5) THEN TRUE END AS item_match FROM s""")
def four_way_quantities(spark, d):
    q = F.get("quantities", F.lit(0))
    rows = item_match(_chains(spark, d))
    item = F.get("items", F.lit(0))["item_match"]
    return rows.select("register_row", "qty_flow_summary", q["received"].cast("bigint").alias("received"), F.get(q["deliveries"], F.lit(0))["grn_number"].alias("grn"), q["over_receipt_ok"].alias("over_receipt_ok"), item.alias("item_match"))


@query("four_way_coverage", f"WITH {_CHAIN} SELECT CASE WHEN k = 2 THEN 'no invoice' ELSE {_HOP1} || ' → ' || CASE k WHEN 4 THEN 'No PO found' ELSE 'PR/PO number' END END AS chain_basis, count(*) AS n, CAST(0 AS BIGINT) AS n_over_billed FROM s GROUP BY 1")
def four_way_coverage(spark, d):
    return coverage_counts(_chains(spark, d))


@query("four_way_line_sheet", f"WITH {_CHAIN} SELECT CAST(order_id AS INTEGER) AS register_row, CASE WHEN k NOT IN (4, 5) THEN 'G' || order_id END AS grn_number, CASE WHEN k NOT IN (4, 5) THEN CAST(qty + CASE k WHEN 6 THEN 1 ELSE 0 END AS BIGINT) END AS delivered, CAST(qty AS BIGINT) AS billed FROM s WHERE k <> 2")
def four_way_line_sheet(spark, d):
    return line_sheet(_chains(spark, d)).select("register_row", "grn_number", F.col("delivered").cast("bigint").alias("delivered"), F.col("billed").cast("bigint").alias("billed"))


@query("augmented_register_bands", f"""WITH {_CHAIN} SELECT CAST(order_id AS INTEGER) AS register_row, CASE WHEN k <> 2 THEN 'INV-00' || order_id END AS inv_no, CASE WHEN k NOT IN (2, 4) THEN 'PO' || order_id WHEN k = 4 THEN '' END AS po_no,
CASE WHEN k = 2 THEN NULL WHEN k IN (4, 5) THEN '—' ELSE 'G' || order_id END AS grn_no, CASE WHEN k = 2 THEN NULL WHEN k = 4 THEN '—' ELSE 'Itemized' END AS po_type, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN '✗' ELSE '✓' END AS register_total FROM s""")
def augmented_register_bands(spark, d):
    tables = Stored(spark)
    made = chain_tables(spark, d, tables)
    wide = augmented_register(made[0], four_way(*made, _CHAIN_POLICY, tables), chain_bands())
    names = {"INVOICE Inv No": "inv_no", "PO No": "po_no", "GRN No": "grn_no", "PO Type": "po_type", "CHECKS register_total": "register_total"}
    return wide.select("register_row", *(F.col(f"`{a}`").alias(b) for a, b in names.items()))


@query("register_coverage", f"WITH {_CHAIN} SELECT CAST(order_id AS VARCHAR) AS k, 'missing' AS problem FROM s WHERE k = 2")
def register_coverage(spark, d):
    """Orders in the register whose invoice is missing among the documents."""
    register, invoices, _, _ = chain_tables(spark, d)
    expected = register.select(F.col("register_row").cast("string").alias("k"))
    return covered_once(expected, invoices.select(F.substring("inv_id", 2, 20).alias("k")), "k")


@query("vouching", f"""WITH {_CHAIN}, v AS (SELECT *, CASE order_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS approved, CASE order_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS stamped, CASE WHEN order_id % 5 > 0 THEN 1 WHEN tie THEN 3 ELSE 5 END AS rung FROM s)
SELECT order_id, CAST(rung AS INTEGER) AS rung, approved AS po_approved, stamped AS buyer_stamp, CASE WHEN rung = 5 OR (rung < 5 AND NOT tie) OR NOT bill_in OR (rung < 5 AND NOT po_in) OR approved IS FALSE OR stamped IS FALSE THEN 'No match' ELSE 'Match' END AS result FROM v""")
def vouching(spark, d):
    """Single invoices with their order, its approval and the buyer's stamp; every fifth cites nothing and has no tax id."""
    w = orders(spark, d)
    day = bills(spark, d).groupBy("order_id").agg(F.sum("cents").alias("cents"), F.max("bill_date").cast("string").alias("day"))
    n, none = F.col("order_id").cast("string"), F.lit(None).cast("string")
    firm, tax = F.concat(F.lit("Firm "), n), F.concat(F.lit("27AAAAA"), F.lpad(n, 8, "0"))
    amount, cites = lambda c: (F.col(c) / 100).cast("double"), F.col("order_id") % 5 > 0
    cited = F.when(cites, F.array(F.struct(F.concat(F.lit("PO "), n).alias("value"), F.lit("buyer_pr_po").alias("kind"), F.lit(False).alias("handwritten"))))
    no_lines = F.lit(None).cast(f"array<{LINE}>")
    invoice = F.struct(F.concat(F.lit("V-"), n), F.col("day"), F.concat(firm, F.lit(" Pvt. Ltd.")), F.when(cites, tax), none, cited, F.lit(None).cast("double"), F.lit(None).cast("double"), amount("cents"), no_lines).cast(INVOICE)
    order = F.struct(F.concat(F.lit("PO"), n), none, firm, tax, none, F.col("po_date").cast("string"), none, amount("po_cents"), F.lit(True), no_lines).cast(ORDER)
    level = lambda s: F.struct(F.lit("L1").alias("level"), F.lit(s).alias("status"))
    levels = F.when(F.col("order_id") % 3 == 0, F.array(level("Approved"), level("Approved"))).when(F.col("order_id") % 3 == 1, F.array(level("Approved"), level("Pending")))
    stamp = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("unclear"), none), (F.col("order_id") % 4 + 1).cast("int"))
    rows = w.join(day, "order_id").select("order_id", invoice.alias("invoice"), F.array(order).alias("pos"), levels.alias("approval_levels"), stamp.alias("stamp"))
    policy = MatchPolicy(profile="V", no_po_forces_no_match=True, approval_drives=True, rate_by_heading=True, fy_start=_YEARS[0], fy_end=_YEARS[1])
    return vouch(rows, policy).select("order_id", "ladder.rung", "po_approved", "buyer_stamp", "result")


# -- line sheet and consolidated bookings ------------------------------------------

#: On top of the chains' cases: an order line that nobody bills if the number divides by 3, sand beside the receipt if it divides
#: by 5, and a receipt in words of its own if it divides by 7 (which the line left alone on either side still gets).
_SHEET = f"""{_CHAIN}, e AS (SELECT *, k NOT IN (4, 5) AS got, order_id % 7 = 0 AS odd, order_id % 5 = 0 AS sand, order_id % 3 = 0 AS unbilled FROM s WHERE k <> 2),
g AS (SELECT *, got AND NOT (odd AND sand) AS attached, qty + CASE k WHEN 6 THEN 1 ELSE 0 END AS received FROM e)"""


@query("four_way_full_sheet", f"""WITH {_SHEET}
SELECT CAST(order_id AS INTEGER) AS register_row, 'billed' AS part, 'Item ' || order_id AS description, CAST(qty AS BIGINT) AS qty, CASE WHEN k <> 4 THEN 'Item ' || order_id END AS po_description, CASE WHEN k <> 4 THEN CAST(qty AS BIGINT) END AS qty_ordered,
CASE WHEN attached THEN CAST(received AS BIGINT) END AS qty_received, CASE WHEN NOT attached THEN '—' WHEN k = 6 THEN '✗' ELSE '✓' END AS over_receipt, CASE WHEN attached THEN '✓' ELSE '—' END AS over_billing, CASE WHEN k = 4 THEN '—' ELSE '✓' END AS line_match, CASE WHEN attached THEN '✓' ELSE '—' END AS item_match FROM g
UNION ALL SELECT CAST(order_id AS INTEGER), 'grn_only', NULL, NULL, NULL, NULL, CAST(received AS BIGINT), '—', '—', '—', '—' FROM g WHERE got AND odd AND sand
UNION ALL SELECT CAST(order_id AS INTEGER), 'grn_only', NULL, NULL, NULL, NULL, CAST(3 AS BIGINT), '—', '—', '—', '—' FROM g WHERE got AND sand
UNION ALL SELECT CAST(order_id AS INTEGER), 'po_only', NULL, NULL, 'Spare of ' || order_id, CAST(1 AS BIGINT), NULL, '—', '—', '—', '—' FROM g WHERE unbilled AND k <> 4""")
def four_way_full_sheet(spark, d):
    """Every line of invoices, orders and receipts once, with what is on one side alone."""
    tables = Stored(spark)
    register, invoices, orders, grns = chain_tables(spark, d, tables)
    n = F.col("n").cast("long")
    empty = F.lit(None)
    spare = F.struct(F.lit(2), F.concat(F.lit("Spare of "), F.col("n")), empty, F.lit(1.0), empty, empty, empty, empty, empty).cast(LINE)
    orders = orders.withColumn("n", F.substring("po_id", 2, 20)).withColumn("order", F.when(n % 3 == 0, F.col("order").withField("lines", F.concat("order.lines", F.array(spare)))).otherwise(F.col("order"))).drop("n")
    sand = F.struct(F.lit("Sand"), empty, F.lit(3.0), empty, empty).cast(RECEIPT_LINE)
    worded = F.transform("lines", lambda x: F.when(n % 7 == 0, x.withField("description", F.lit("Goods as agreed"))).otherwise(x))
    grns = grns.withColumn("n", F.substring("grn_number", 2, 20)).withColumn("lines", F.concat(worded, F.when(n % 5 == 0, F.array(sand)).otherwise(F.array().cast(f"array<{RECEIPT_LINE}>")))).drop("n")
    found = four_way(register, invoices, orders, grns, _CHAIN_POLICY, tables)
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    return full_line_sheet(found, tables=tables).select("register_row", "part", "description", whole("qty"), "po_description", whole("qty_ordered"), whole("qty_received"), "over_receipt", "over_billing", "line_match", "item_match")


@query("consolidated_bookings", f"""WITH {_WHOLE}, i AS (SELECT vendor, strftime(bill_date, '%Y-%m') AS month, order_id, cents / 100.0::DOUBLE AS total, row_number() OVER (PARTITION BY vendor, strftime(bill_date, '%Y-%m') ORDER BY order_id) AS nth FROM b),
r AS (SELECT vendor, month, sum(total) AS total FROM i WHERE nth <= 2 GROUP BY ALL HAVING count(*) = 2),
lone AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.vendor = r.vendor AND abs(i.total - r.total) <= greatest(1.0, 0.01 * abs(r.total))))
SELECT CAST(z.vendor * 10000 + CAST(replace(substr(z.month, 3), '-', '') AS BIGINT) AS INTEGER) AS register_row, a.order_id AS first_order, b.order_id AS second_order
FROM lone z JOIN i a ON a.vendor = z.vendor AND a.month = z.month JOIN i b ON b.vendor = z.vendor AND b.month = z.month AND a.order_id < b.order_id
WHERE a.total < z.total AND abs(a.total + b.total - z.total) <= greatest(1.0, 0.01 * abs(z.total))""")
def consolidated_bookings(spark, d):
    """Postings that two bills of a supplier and month add up to, of postings that no single bill of the supplier explains."""
    month = F.date_format("bill_date", "yyyy-MM")
    tables = Stored(spark)
    rows = tables.write(bills(spark, d).select("vendor", "order_id", month.alias("month"), F.col("bill_date").cast("string").alias("day"), (F.col("cents") / 100).alias("total")))
    tax = F.concat(F.lit("27AAAAA"), F.lpad(F.col("vendor").cast("string"), 8, "0"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vendor", "month").orderBy("order_id"))).where("nth <= 2")
    booked = first.groupBy("vendor", "month").agg(F.sum("total").alias("total"), F.count("*").alias("n")).where("n = 2")
    none = F.lit(None).cast("string")
    row = F.col("vendor") * 10000 + F.replace(F.substring("month", 3, 5), F.lit("-"), F.lit("")).cast("int")
    register = tables.write(booked.select(row.alias("register_row"), none.alias("vendor_name"), tax.alias("vendor_gstin"), none.alias("invoice_no"), F.concat("month", F.lit("-28")).alias("booking_date"), none.alias("po_no"), none.alias("site_name"), F.lit(None).cast("double").alias("taxable"), F.lit(None).cast("double").alias("gst_total"), "total"))
    empty = F.lit(None)
    invoice = _made(INVOICE, none, F.col("day"), none, tax, none, empty, empty, empty, F.col("total"), empty)
    keyed = tables.write(invoice_keys(rows.select(F.lpad(F.col("order_id").cast("string"), 12, "0").alias("inv_id"), invoice.alias("invoice"))))
    wide = MatchPolicy(profile="F", fy_start="1900-01-01", fy_end="2100-01-01")
    pairs = consolidated(register, keyed, tables.write(postings(register, keyed, wide, tables)), wide)
    found = tables.write(pairs.select("register_row", F.col("inv_a").cast("bigint").alias("first_order"), F.col("inv_b").cast("bigint").alias("second_order")))
    # a row number is an integer while all fit; from vendor 214,748 on, where the SQL fails, it stays what it is, a long
    widest = found.agg(F.max(F.abs("register_row"))).first()[0] or 0
    return found.withColumn("register_row", F.col("register_row").cast("int")) if widest < 1 << 31 else found


# -- guards and views ----------------------------------------------------------------


@query("batch_outcome_rows", f"WITH {_MATCHED} SELECT CAST(cust AS VARCHAR) AS batch_id, invoice_number, CASE WHEN k = 0 THEN 'PO_MISSING' WHEN k = 2 AND (SELECT max(together) FROM m WHERE m.order_id = i.order_id) - po_cents > {_BATCH_BAND} THEN 'MISMATCH' WHEN k = 2 THEN 'PARTIAL' ELSE {_PAIR} END AS status FROM i WHERE k <> 3")
def batch_outcome_rows(spark, d):
    return outcome_rows(_tables(spark, d)).select("batch_id", "invoice_number", "status")


@query("batch_public_documents", f"""WITH {_MADE}, every AS (SELECT cust, order_id * 5 + place AS idx, k, invoice_number, CAST(NULL AS VARCHAR) AS po_number, CASE WHEN k IN (5, 6) THEN '' WHEN k = 7 THEN 'PO-' || order_id || ',PO-' || order_id || '9' ELSE 'PO-' || order_id END AS cited, 'invoice' AS doc_type, inv_cents AS cents FROM i
 UNION ALL SELECT cust, order_id * 5 + 3, k, NULL, 'PO-' || order_id, 'PO-' || order_id, 'po', CASE k WHEN 7 THEN po_cents // 2 ELSE po_cents END FROM c WHERE k <> 0 UNION ALL SELECT cust, order_id * 5 + 4, k, NULL, 'PO-' || order_id || '9', 'PO-' || order_id || '9', 'po', po_cents - po_cents // 2 FROM c WHERE k = 7)
SELECT CAST(cust AS VARCHAR) AS batch_id, CAST(idx AS INTEGER) AS index, doc_type, invoice_number, cited AS po_numbers, '$' || trim(format('{{:,.2f}}', cents / 100)) AS total, NOT (k = 3 AND doc_type = 'invoice') AS readable FROM every""")
def batch_public_documents(spark, d):
    rows = public_documents(canonical(batch_documents(spark, d)))
    return rows.select("batch_id", "index", "doc_type", "invoice_number", F.array_join("po_numbers", ",").alias("po_numbers"), "total", "readable")


@query("ledger_public_view", f"WITH {_WHOLE} SELECT CASE WHEN order_id % 35 = 0 THEN 'inv-' ELSE 'OLD-' END || order_id AS invoice_number, 'PO ' || order_id AS po_number, '$' || trim(format('{{:,.2f}}', po_cents * 2 / 100)) AS amount, '1990-01-01' AS date FROM w WHERE order_id % 7 = 0")
def ledger_public_view(spark, d):
    return public_ledger(batch_ledger(spark, d)).select("invoice_number", "po_number", "amount", "date")


@query("extraction_gates", f"WITH {_CHAIN} SELECT order_id, order_id % 3 > 0 AND order_id % 5 > 0 AS order_ok, k <> 5 AND order_id % 5 > 0 AS receipt_ok FROM s")
def extraction_gates(spark, d):
    """Whether orders and receipts carry what the chain needs of them."""
    n, k = F.col("order_id"), F.col("order_id") % 8
    number, vendor = n.cast("string"), F.when(n % 5 > 0, "Firm")
    none = F.lit(None).cast("string")
    described = F.array(F.struct(F.lit("Item").alias("description")))
    rows = bills(spark, d).select("order_id").distinct()
    order = order_gate(number, F.when(n % 3 > 0, number), vendor, none, described)
    return rows.select("order_id", order.alias("order_ok"), receipt_gate(F.when(k != 5, number), number, vendor, none, described).alias("receipt_ok"))
