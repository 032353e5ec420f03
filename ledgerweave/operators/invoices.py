"""Invoice decisions: vendor and order resolution, checks against master data and ledger, one plan over all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import age_days
from ..functions.money import MONEY, at_least, money_text
from ..functions.names import order_key, vendor_name
from ..policy import HOLD, OK, REJECT, REVIEW, WARN, InvoicePolicy
from .bands import band_join
from .findings import NONE, decide, finding, listed
from .similarity import similar_names
from .tables import Stored

P = InvoicePolicy()


def auto_tolerance(total: Column, policy: InvoicePolicy = P) -> Column:
    return at_least(total, policy.auto_pct, policy.auto_abs)


def approver_band(total: Column, policy: InvoicePolicy = P) -> Column:
    return at_least(total, policy.band_pct, policy.band_abs)


def plausible(total: Column, po_total: Column, partial: Column, remaining: Column, policy: InvoicePolicy = P) -> Column:
    """Could this amount belong to this order: any part of what remains, or about the whole of a single bill; false without a total."""
    band = approver_band(po_total, policy)
    return F.coalesce(F.when(partial, (total > 0) & (total <= remaining + band)).otherwise(F.abs(total - po_total) <= band), F.lit(False))


def billed_by_order(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("po_number").isNotNull()).groupBy("po_number").agg(F.sum(F.coalesce("amount_applied", F.lit(0))).cast(MONEY).alias("already_billed"))


def open_balance(orders: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adds already_billed and remaining to the orders."""
    out = orders.join(billed_by_order(ledger), "po_number", "left").withColumn("already_billed", F.coalesce("already_billed", F.lit(0).cast(MONEY)))
    return out.withColumn("remaining", (F.col("total_amount") - F.col("already_billed")).cast(MONEY))


def resolve_vendors(invoices: DataFrame, vendors: DataFrame, policy: InvoicePolicy = P) -> DataFrame:
    """(vendor_raw, vendor_id, vendor_name, vendor_ratio) of each distinct name that resolves; the first vendor and alias win ties."""
    known = vendors.where(F.coalesce("approved", F.lit(True))) if policy.enforce_approved else vendors
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    candidates = known.select("vendor_id", F.col("name").alias("vendor_name"), F.col("seq").alias("vendor_seq"), F.posexplode(every).alias("alias_seq", "candidate"))
    pairs = similar_names(invoices.select(F.col("vendor_raw").alias("name")).where("vendor_raw <> ''"), candidates, policy.vendor_ratio, vendor_name, best_only=True)
    best = F.min_by(F.struct("vendor_id", "vendor_name", "ratio"), F.struct(-F.col("ratio"), F.col("vendor_seq"), F.col("alias_seq")))
    return pairs.groupBy("name").agg(best.alias("b")).select(F.col("name").alias("vendor_raw"), "b.vendor_id", "b.vendor_name", F.col("b.ratio").alias("vendor_ratio"))


def match_orders(invoices: DataFrame, orders: DataFrame, policy: InvoicePolicy = P) -> DataFrame:
    """Adds the matched order (struct ``po`` or null), match_basis and n_plausible: by the cited number, else the one open order that fits.

    orders: po_number, vendor_id, total_amount, currency, status, allow_partial, description, already_billed, remaining, seq.
    """
    fields = [c for c in orders.columns if c != "seq"]
    first = orders.withColumn("_key", order_key(F.col("po_number"))).groupBy("_key").agg(F.min_by(F.struct(*fields), "seq").alias("cited"))
    out = invoices.withColumn("_key", order_key(F.col("po_reference"))).join(first, "_key", "left").drop("_key")
    open_ones = orders.where("status = 'open'").select(F.col("vendor_id").alias("_v"), F.struct(*fields).alias("_po"), F.col("seq").alias("_seq"))
    # from the invoices themselves: those that cite nothing need not meet the cited orders first
    free = invoices.where("po_reference is null and vendor_id is not null").select("doc_id", "vendor_id", "total").join(open_ones, F.col("vendor_id") == F.col("_v"))
    fits = free.where(plausible(F.col("total"), F.col("_po.total_amount"), F.col("_po.allow_partial"), F.col("_po.remaining"), policy))
    fits = fits.groupBy("doc_id").agg(F.count("*").alias("n_plausible"), F.min_by("_po", "_seq").alias("_fit"))
    out = out.join(fits, "doc_id", "left").withColumn("n_plausible", F.coalesce("n_plausible", F.lit(0)))
    known = F.col("vendor_id").isNotNull()
    inferred = known & F.col("cited").isNull() & F.col("po_reference").isNull() & (F.col("n_plausible") == 1)
    return out.withColumns(
        {
            "po": F.when(known & F.col("cited").isNotNull(), F.col("cited")).when(inferred, F.col("_fit")),
            "match_basis": F.when(known & F.col("cited").isNotNull(), "explicit-reference").when(inferred, "inferred-unique").otherwise("none"),
        }
    ).drop("cited", "_fit")


def ledger_duplicates(invoices: DataFrame, ledger: DataFrame, policy: InvoicePolicy = P) -> DataFrame:
    """(doc_id, hits array of (seq, kind, prior number, total, decision) in ledger order); an unresolved vendor is compared with every vendor's entries."""
    inv = invoices.select("doc_id", F.col("vendor_id").alias("v"), F.upper("invoice_number").alias("n"), F.col("total").alias("t"), F.col("invoice_date").alias("d"))
    led = ledger.select("seq", F.col("vendor_id").alias("lv"), F.upper("invoice_number").alias("ln"), F.col("invoice_number").alias("prior"), F.col("total").alias("lt"), F.col("invoice_date").alias("ld"), "decision")
    same = F.coalesce(F.col("n") == F.col("ln"), F.lit(False)) & (F.col("n") != "")
    near = (F.abs(F.col("t") - F.col("lt")) <= policy.near_amount) & ~same
    hit = F.struct("seq", F.when(same, "EXACT").otherwise("NEAR").alias("kind"), "prior", F.col("lt").alias("total"), "decision")
    known, unknown = inv.where("v is not null"), inv.where("v is null")
    about = lambda rows, *equal: band_join(rows, led, [*equal, ("d", "ld")], ("t", "lt"), floor=policy.near_amount).where(near)
    parts = [
        known.join(led, (F.col("v") == F.col("lv")) & (F.col("n") == F.col("ln"))).where(same),
        about(known, ("v", "lv")),
        unknown.join(led, F.col("n") == F.col("ln")).where(same),
        about(unknown),
    ]
    hits = parts[0].select("doc_id", hit.alias("h"))
    for p in parts[1:]:
        hits = hits.union(p.select("doc_id", hit.alias("h")))
    return hits.groupBy("doc_id").agg(F.array_sort(F.collect_list("h")).alias("hits"))


def validation_findings(policy: InvoicePolicy = P) -> Column:
    gone = F.array_compact(
        F.array(
            F.when(F.coalesce("invoice_number", F.lit("")) == "", "invoice number"),
            F.when(F.col("total").isNull(), "total amount"),
            F.when(F.col("invoice_date").isNull(), "invoice date"),
            F.when(F.coalesce("vendor_raw", F.lit("")) == "", "vendor name"),
        )
    )
    lines = F.aggregate("line_items", F.lit(0).cast(MONEY), lambda a, i: (a + i["amount"]).cast(MONEY))
    off_lines = F.abs(lines - F.col("subtotal"))
    expected = F.col("subtotal") + F.coalesce("tax", F.lit(0).cast(MONEY))
    off = F.abs(expected - F.col("total"))
    age = age_days(F.col("invoice_date"), policy.processing_date)
    return listed(
        F.when(F.size(gone) > 0, finding("MISSING_CRITICAL_FIELDS", REVIEW, F.concat(F.lit("Missing: "), F.array_join(gone, ", ")), missing=F.array_join(gone, ","))).otherwise(finding("REQUIRED_FIELDS_PRESENT", OK, "Number, date, total and vendor were read.")),
        F.when((F.size("line_items") > 0) & (off_lines > policy.rounding), finding("LINE_ITEMS_DONT_SUM", WARN, F.concat(F.lit("Lines sum to "), money_text(lines), F.lit(", the subtotal is "), money_text(F.col("subtotal"))), line_item_sum=lines, subtotal=F.col("subtotal"), delta=off_lines)),
        F.when(off > policy.rounding, finding("TOTAL_DOESNT_RECONCILE", REVIEW, F.concat(F.lit("Subtotal and tax make "), money_text(expected), F.lit(", the total says "), money_text(F.col("total"))), expected_total=expected, stated_total=F.col("total"), delta=off)).when(off <= policy.rounding, finding("MATH_RECONCILES", OK, "Subtotal and tax make the total.")),
        F.when(age < -policy.future_grace_days, finding("FUTURE_DATED", REVIEW, F.concat(F.lit("Dated in the future: "), F.col("invoice_date").cast("string")), invoice_date=F.col("invoice_date"))).when(age > policy.stale_days, finding("STALE_INVOICE", WARN, F.format_string("%d days old.", age), age_days=age)),
    )


def match_findings(policy: InvoicePolicy = P) -> Column:
    known, po = F.col("vendor_id").isNotNull(), F.col("po")
    return listed(
        F.when(known, finding("VENDOR_APPROVED", OK, F.concat(F.lit("Vendor: "), F.col("vendor_name")), vendor_id=F.col("vendor_id"), match_ratio=F.round("vendor_ratio", 3))).otherwise(finding("VENDOR_NOT_APPROVED", REJECT, F.concat(F.lit("No approved vendor is named like: "), F.coalesce("vendor_raw", F.lit("(none)"))), raw_vendor=F.col("vendor_raw"))),
        F.when(known & (F.col("match_basis") == "explicit-reference"), finding("PO_FOUND_EXPLICIT", OK, F.concat(F.lit("Cited order: "), po["po_number"]), po_number=po["po_number"])),
        F.when(known & po.isNull() & F.col("po_reference").isNotNull(), finding("PO_REFERENCE_UNKNOWN", REVIEW, F.concat(F.lit("No such order: "), F.col("po_reference")), cited_po=F.col("po_reference"))),
        F.when(known & (F.col("match_basis") == "inferred-unique"), finding("PO_INFERRED", WARN, F.concat(F.lit("The one open order that fits: "), po["po_number"]), po_number=po["po_number"])),
        F.when(known & po.isNull() & F.col("po_reference").isNull(), finding("PO_UNRESOLVED", REVIEW, F.format_string("No order cited; %d open order(s) fit.", F.col("n_plausible")), plausible=F.col("n_plausible"))),
        F.when(known & (po["vendor_id"] != F.col("vendor_id")), finding("PO_VENDOR_MISMATCH", REJECT, "The order is another vendor's.", po_vendor=po["vendor_id"], invoice_vendor=F.col("vendor_id"))),
        F.when(known & (po["status"] != "open"), finding("PO_CLOSED", REJECT, F.concat(F.lit("The order is "), po["status"]), po_status=po["status"])),
    )


def amount_finding(total: Column, po_total: Column, policy: InvoicePolicy = P) -> Column:
    """A single bill against the whole order; null for a missing amount."""
    off, auto, band = F.abs(total - po_total), auto_tolerance(po_total, policy), approver_band(po_total, policy)
    said = F.concat(money_text(total), F.lit(" against "), money_text(po_total))
    facts = {"invoice_total": total, "po_total": po_total, "delta": off}
    return F.when(off <= auto, finding("AMOUNT_WITHIN_TOLERANCE", OK, said, **facts)).when(off <= band, finding("AMOUNT_OVER_TOLERANCE", HOLD, said, **facts, approver_band=band)).when(off > band, finding("AMOUNT_EXCEEDS_BAND", REJECT, said, **facts, approver_band=band))


def cumulative_finding(total: Column, billed: Column, po_total: Column, policy: InvoicePolicy = P, prior: Column | None = None) -> Column:
    """Bills so far and this one against the ceiling of an order in parts."""
    over, band = billed + total - po_total, approver_band(po_total, policy)
    said = F.concat(money_text((billed + total).cast(MONEY)), F.lit(" billed of "), money_text(po_total))
    facts = {"already_billed": billed, "this_invoice": total, "cumulative": billed + total, "po_total": po_total} | ({"prior_invoices": prior} if prior is not None else {})
    return F.when(over <= policy.rounding, finding("PARTIAL_BILLING_OK", OK, said, **facts)).when(over <= band, finding("CUMULATIVE_OVERBILL_APPROVABLE", HOLD, said, **facts, overage=over)).when(over > band, finding("CUMULATIVE_OVERBILL", REJECT, said, **facts, overage=over, approver_band=band))


def rule_findings(policy: InvoicePolicy = P) -> Column:
    po, total = F.col("po"), F.col("total")
    trusted = F.col("extraction_confidence") >= policy.min_confidence
    number = F.coalesce("invoice_number", F.lit("(none)"))

    def duplicate(h):
        exact = finding("DUPLICATE_EXACT", REJECT, F.concat(F.lit("Already processed: "), number), prior_invoice=h["prior"], prior_amount=h["total"], prior_decision=h["decision"])
        near = finding("DUPLICATE_NEAR", REVIEW, F.concat(F.lit("Same vendor, amount and date as "), F.coalesce(h["prior"], F.lit("(none)"))), matched_prior=h["prior"], this_invoice=F.col("invoice_number"))
        return F.when(h["kind"] == "EXACT", exact).otherwise(near)

    repeats = F.when(F.size("hits") > 0, F.transform("hits", duplicate).cast(NONE)).otherwise(listed(finding("NO_DUPLICATE", OK, "Nothing like it in the ledger.")))
    single = listed(
        F.when(po["already_billed"] > 0, finding("SECOND_INVOICE_ON_SINGLE_PO", REVIEW, F.concat(money_text(po["already_billed"]), F.lit(" was billed before on an order for one bill")), already_billed=po["already_billed"])),
        amount_finding(total, po["total_amount"], policy),
    )
    parts = listed(cumulative_finding(total, po["already_billed"], po["total_amount"], policy, F.coalesce("prior_invoices", F.lit("none"))))
    return F.concat(
        listed(F.when(trusted, finding("EXTRACTION_TRUSTED", OK, "The text was read well enough.")).otherwise(finding("LOW_EXTRACTION_CONFIDENCE", REVIEW, "Some fields are uncertain.", extraction_confidence=F.col("extraction_confidence"), source_kind=F.col("source_kind")))),
        repeats,
        listed(F.when(F.col("currency") != po["currency"], finding("CURRENCY_MISMATCH", REJECT, F.concat(F.col("currency"), F.lit(" against "), po["currency"]), invoice_currency=F.col("currency"), po_currency=po["currency"]))),
        F.when(po.isNull() | total.isNull(), listed()).when(po["allow_partial"], parts).otherwise(single),
    )


def decide_invoices(invoices: DataFrame, vendors: DataFrame, orders: DataFrame, ledger: DataFrame, policy: InvoicePolicy = P, tables: Stored | None = None) -> DataFrame:
    """invoices: what extraction gives, with doc_id.  Adds vendor, order, the stages' findings and the decision.

    The rows are read once per join, so invoices that come straight from text should be persisted or written first.
    tables: where to write the resolved names, a row a name, which are otherwise worked out once per join, too.
    """
    resolved = resolve_vendors(invoices, vendors, policy)
    known = invoices.join(tables.write(resolved) if tables else resolved, "vendor_raw", "left")
    rows = match_orders(known, open_balance(orders, ledger), policy)
    prior = ledger.where("po_number is not null").groupBy(F.col("po_number").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("#"), F.coalesce("invoice_number", F.lit("")), F.lit(" "), money_text(F.col("total"))).alias("s")))), lambda x: x["s"]), ", ").alias("prior_invoices"))
    rows = rows.join(prior, F.col("po.po_number") == F.col("_p"), "left").drop("_p").join(ledger_duplicates(known, ledger, policy), "doc_id", "left")
    readable = ~F.col("ocr_needed") & (F.col("total").isNotNull() | F.col("vendor_raw").isNotNull() | F.col("invoice_number").isNotNull())
    unread = listed(finding("DOCUMENT_UNREADABLE", REVIEW, "The document has no usable text.", source_kind=F.col("source_kind"), extraction_confidence=F.col("extraction_confidence")))
    rows = rows.withColumns(
        {
            "validate_findings": F.when(readable, validation_findings(policy)).otherwise(listed()),
            "match_findings": F.when(readable, match_findings(policy)).otherwise(listed()),
            "rule_findings": F.when(readable, rule_findings(policy)).otherwise(unread),
            "match_basis": F.when(readable, F.col("match_basis")).otherwise("skipped-unreadable"),
        }
    )
    return rows.withColumn("findings", F.concat("validate_findings", "match_findings", "rule_findings")).withColumn("decision", decide(F.col("findings")))


def replay_history(bills: DataFrame, key: str, order: list[str], amount: str) -> DataFrame:
    """Adds billed_before: what earlier bills of the same order came to."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return bills.withColumn("billed_before", F.coalesce(F.sum(amount).over(w), F.lit(0).cast(MONEY)).cast(MONEY))
