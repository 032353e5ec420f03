"""Two-way match of one invoice with its orders, in three states (true, false, null for unverified).

A payload row holds the invoice and its orders as structs, so every step is a
column expression: no shuffle, whatever the number of payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.money import amounts_equal, percents_equal, quantity_within, rates_equal, round_to
from ..functions.names import company_name, reference_key, tax_ids_equal
from ..functions.text import code_valid, csv_cell, product_name, same_product
from ..policy import TAX_RATES, TWO_WAY, MatchPolicy

LINE = "struct<line_no:int,description:string,hsn_sac:string,quantity:double,unit:string,rate:double,unit_price:double,gst_rate:double,amount:double>"
INVOICE = f"struct<invoice_number:string,invoice_date:string,vendor_name:string,vendor_gstin:string,buyer_gstin:string,references:array<struct<value:string,kind:string,handwritten:boolean>>,taxable_total:double,tax_total:double,total:double,lines:array<{LINE}>>"
ORDER = f"struct<po_number:string,pr_number:string,vendor_name:string,vendor_gstin:string,buyer_gstin:string,requisition_date:string,scheduled_date:string,total:double,po_itemized:boolean,lines:array<{LINE}>>"
PRIOR = "array<struct<invoice_number:string,vendor_gstin:string,total:double,invoice_date:string>>"


def itemized(lines: Column) -> Column:
    """More than one line, or one with a quantity over 1 and a unit price."""
    one = F.get(lines, F.lit(0))
    return (F.size(lines) > 1) | F.coalesce((F.size(lines) == 1) & (one["quantity"] > 1) & one["unit_price"].isNotNull(), F.lit(False))


def all_agree(states: Column) -> Column:
    """Over an array of states: a false one decides, else a null one; true for none."""
    return F.when(F.exists(states, lambda s: F.coalesce(~s, F.lit(False))), False).when(F.exists(states, lambda s: s.isNull()), None).otherwise(True)


def vendor_agrees(name_a: Column, id_a: Column, name_b: Column, id_b: Column, blank=company_name) -> Column:
    """Tax ids decide when both are there, else normalised names; null when neither can."""
    both = (F.coalesce(name_a, F.lit("")) != "") & (F.coalesce(name_b, F.lit("")) != "")
    return F.coalesce(tax_ids_equal(id_a, id_b), F.when(both, blank(name_a) == blank(name_b)))


def _refs(invoice: Column) -> Column:
    own = F.filter(F.coalesce(invoice["references"], F.array().cast("array<struct<value:string,kind:string,handwritten:boolean>>")), lambda r: r["kind"] == "buyer_pr_po")
    return own


def order_ladder(invoice: Column, orders: Column, policy: MatchPolicy = TWO_WAY) -> Column:
    """struct<rung, basis, confidence, matched>: cited orders, else tax id and total, [name and total,] else tax id alone, else none."""
    refs = _refs(invoice)
    keys = F.transform(refs, lambda r: reference_key(r["value"]))
    by_hand = F.exists(refs, lambda r: F.coalesce(r["handwritten"], F.lit(False)))
    same_id = lambda p: F.coalesce(tax_ids_equal(invoice["vendor_gstin"], p["vendor_gstin"]), F.lit(False))
    ties = lambda p: F.coalesce(amounts_equal(invoice["total"], p["total"], policy.amount_pct, policy.amount_floor), F.lit(False))
    named = lambda p: (company_name(invoice["vendor_name"]) != "") & (company_name(invoice["vendor_name"]) == company_name(p["vendor_name"]))
    cited = lambda p: F.array_contains(keys, reference_key(p["po_number"])) | F.array_contains(keys, reference_key(p["pr_number"]))
    steps = [
        (F.when(by_hand, "PR/PO (handwritten, review)").otherwise("PR/PO number"), F.when(by_hand, "medium").otherwise("high"), cited),
        (F.lit("GSTIN + total"), F.lit("medium"), lambda p: same_id(p) & ties(p)),
    ]
    if policy.profile == "V":
        steps.append((F.lit("name + total"), F.lit("low"), lambda p: named(p) & ties(p)))
    steps.append((F.lit("possible match (GSTIN only)"), F.lit("low"), same_id))

    def kept(k, test):
        """Vouching: of several orders with one fingerprint, the one of the closest period."""
        found = F.filter(orders, test)
        if policy.profile != "V" or k not in (2, 3):
            return found
        far = lambda p: F.abs(F.datediff(p["requisition_date"].try_cast("date"), invoice["invoice_date"].try_cast("date")))
        near = F.transform(found, lambda p, i: F.struct(F.coalesce(far(p), F.lit(1 << 30)).alias("days"), i.alias("i")))
        return F.when(F.size(found) > 1, F.array(F.get(found, F.array_min(near)["i"]))).otherwise(found)

    rungs = F.array(*(F.struct(F.lit(k).alias("rung"), basis.alias("basis"), sure.alias("confidence"), kept(k, test).alias("matched")) for k, (basis, sure, test) in enumerate(steps, 1)))
    none = F.struct(F.lit(len(steps) + 1).alias("rung"), F.lit("No PO found").alias("basis"), F.lit("none").alias("confidence"), F.slice(orders, 1, 0).alias("matched"))
    return F.coalesce(F.get(F.filter(rungs, lambda r: F.size(r["matched"]) > 0), F.lit(0)), none)


def pair_lines(bill: Column, order: Column, policy: MatchPolicy = TWO_WAY) -> Column:
    """For each invoice line the place of its order line, or null.  Three passes take order lines once, in order:
    equal description or code, same product, and, with as many left on both sides (three at most), one to one."""
    n_order = F.size(order)
    places = F.sequence(F.lit(0), F.greatest(n_order, F.lit(1)) - 1)

    def first_free(taken, line, same):
        open_ones = F.filter(places, lambda j: (j < n_order) & ~F.array_contains(taken, j) & same(line, F.get(order, j)))
        return F.get(open_ones, F.lit(0))

    def one_pass(found, same):
        """found: array<int> by invoice line."""
        start = F.struct(F.array().cast("array<int>").alias("out"), F.filter(found, lambda j: j.isNotNull()).alias("taken"))

        def step(acc, x):
            got = F.coalesce(x["found"], first_free(acc["taken"], x["line"], same))
            return let(got, lambda g: F.struct(F.concat(acc["out"], F.array(g)).alias("out"), F.when(g.isNull() | x["found"].isNotNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(g))).alias("taken")))

        rows = F.zip_with(bill, found, lambda line, f: F.struct(line.alias("line"), f.alias("found")))
        return F.aggregate(rows, start, step)["out"]

    code = lambda c: F.coalesce(c, F.lit(""))
    exact = lambda a, b: (product_name(a["description"]) == product_name(b["description"])) | ((code(a["hsn_sac"]) != "") & (code(a["hsn_sac"]) == code(b["hsn_sac"])))
    alike = lambda a, b: same_product(a["description"], b["description"], policy.min_jaccard)
    none = F.transform(bill, lambda _: F.lit(None).cast("int"))

    def leftovers(found):
        open_bill = F.filter(F.transform(found, lambda j, i: F.when(j.isNull(), i)), lambda i: i.isNotNull())
        open_order = F.filter(places, lambda j: (j < n_order) & ~F.coalesce(F.array_contains(F.filter(found, lambda x: x.isNotNull()), j), F.lit(False)))
        even = (F.size(open_bill) == F.size(open_order)) & (F.size(open_bill) <= policy.most_leftovers)
        return F.when(even, F.transform(found, lambda j, i: F.coalesce(j, F.get(open_order, F.array_position(open_bill, i).cast("int") - 1)))).otherwise(found)

    return let(one_pass(none, exact), lambda a: let(one_pass(a, alike), leftovers))


def rate_of(code: Column, rates: dict[str, float], by_heading: bool) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in rates.items() for x in (k, v / 100)))
    own = F.try_element_at(table, code)
    return F.coalesce(own, F.try_element_at(table, F.substring(code, 1, 4))) if by_heading else own


def state_text(state: Column) -> Column:
    return F.when(state, "agrees").when(~state, "fails").otherwise("unverified")


def two_way(payloads: DataFrame, policy: MatchPolicy = TWO_WAY, rates: dict[str, float] | None = None) -> DataFrame:
    """payloads: invoice, pos, and optionally ledger.  Adds the ladder, states, result, reason, flags and checked lines."""
    rates = TAX_RATES if rates is None else rates
    if "ledger" not in payloads.columns:
        payloads = payloads.withColumn("ledger", F.lit(None).cast(PRIOR))
    inv = F.col("invoice")
    df = payloads.withColumn("pos", F.coalesce("pos", F.array().cast(f"array<{ORDER}>")))
    if "ladder" not in payloads.columns:  # else the chain was found by joins
        df = df.withColumn("ladder", order_ladder(inv, F.col("pos"), policy))
    matched, n = F.col("ladder.matched"), F.size("ladder.matched")
    lump = (n == 1) & ~F.coalesce(F.get(matched, F.lit(0))["po_itemized"], F.lit(True))
    df = df.withColumns({"po_sum": F.aggregate(matched, F.lit(0.0), lambda a, p: a + F.coalesce(p["total"], F.lit(0.0))), "lump_sum": lump})
    vendor = F.transform(matched, lambda p: vendor_agrees(inv["vendor_name"], inv["vendor_gstin"], p["vendor_name"], p["vendor_gstin"]))
    dated = F.concat(F.array(F.struct(F.lit("invoice").alias("what"), inv["invoice_date"].alias("d"))), F.transform(matched, lambda p: F.struct(F.concat(F.lit("PO "), p["po_number"]).alias("what"), p["requisition_date"].alias("d"))))
    present = F.filter(dated, lambda x: F.coalesce(x["d"], F.lit("")) != "")
    outside = F.get(F.filter(present, lambda x: ~x["d"].between(policy.fy_start, policy.fy_end)), F.lit(0))
    refs = _refs(inv)
    own_keys = F.flatten(F.transform(matched, lambda p: F.array(reference_key(p["po_number"]), reference_key(p["pr_number"]))))
    stray = F.get(F.filter(refs, lambda r: ~F.array_contains(own_keys, reference_key(r["value"]))), F.lit(0))
    latest = F.array_max(F.filter(F.transform(matched, lambda p: F.nullif(p["requisition_date"], F.lit(""))), lambda d: d.isNotNull()))
    df = df.withColumns(
        {
            "vendor_match": F.when(n > 0, all_agree(vendor)),
            "total_match": F.when(n > 0, amounts_equal(inv["total"], F.col("po_sum"), policy.amount_pct, policy.amount_floor)),
            "outside": outside,
            "dates_fy": F.when(outside.isNotNull(), False).when(F.size(present) < F.size(dated), None).otherwise(True),
            "stray": F.when((n > 0) & (F.size(refs) > 0), stray["value"]),
            "po_num_consistent": F.when((n > 0) & (F.size(refs) > 0), stray.isNull()),
            "latest_po_date": latest,
            "date_order": F.nullif(inv["invoice_date"], F.lit("")) >= latest,
        }
    )
    states = [F.col("vendor_match"), F.col("total_match"), F.col("dates_fy")]
    if policy.approval_drives:
        approved = F.col("po_approved") if "po_approved" in payloads.columns else F.lit(None).cast("boolean")
        stamped = F.col("buyer_stamp") if "buyer_stamp" in payloads.columns else F.lit(None).cast("boolean")
        states += [approved, stamped]
    fails = sum((F.when(s, 0).when(~s, 1).otherwise(0) for s in states), F.lit(0)) > 0
    if policy.no_po_forces_no_match:
        fails = fails | (F.size("ladder.matched") == 0) | F.col("ladder.basis").startswith("possible")
    blank = (F.coalesce(inv["invoice_number"], F.lit("")) == "") & (F.coalesce(inv["total"], F.lit(0.0)) == 0)
    df = df.withColumn("result", F.when(blank, "").when(fails, "No match").otherwise("Match"))
    df = df.withColumn("_po_lines", F.flatten(F.transform(matched, lambda p: F.transform(F.coalesce(p["lines"], F.array().cast(f"array<{LINE}>")), lambda x: F.struct(x["line_no"].alias("line_no"), x["description"].alias("description"), x["hsn_sac"].alias("hsn_sac"), x["quantity"].alias("quantity"), x["unit_price"].alias("unit_price"), p["po_number"].alias("po_number"))))))
    df = df.withColumn("_bill", F.coalesce(inv["lines"], F.array().cast(f"array<{LINE}>")))
    df = df.withColumn("_pairs", F.when(F.col("lump_sum"), F.transform("_bill", lambda _: F.lit(None).cast("int"))).otherwise(pair_lines(F.col("_bill"), F.col("_po_lines"), policy)))

    def checked(line, j):
        po = F.get(F.col("_po_lines"), j)
        hsn = F.regexp_replace(F.coalesce(line["hsn_sac"], F.lit("")), r"\s+", "")
        found = j.isNotNull() & ~F.col("lump_sum")
        return F.struct(
            line["line_no"].alias("line_no"), line["description"].alias("description"), line["hsn_sac"].alias("hsn_sac"), line["quantity"].alias("quantity"), line["unit"].alias("unit"),
            line["rate"].alias("rate"), line["gst_rate"].alias("gst_rate"), line["amount"].alias("amount"),
            F.when(found, F.concat(po["po_number"], F.lit("#"), po["line_no"].cast("string"))).alias("paired_po_line"),
            F.when(found, po["quantity"]).alias("po_qty"), F.when(found, po["unit_price"]).alias("po_unit_price"),
            F.when(found, True).when(~F.col("lump_sum") & (F.size("ladder.matched") > 0), False).alias("line_match"),
            F.when(found, rates_equal(line["rate"], po["unit_price"], policy.rate_abs)).alias("rate_match"),
            F.when(found, quantity_within(line["quantity"], po["quantity"])).alias("qty_ok"),
            code_valid(hsn).alias("hsn_valid"),
            percents_equal(line["gst_rate"], rate_of(hsn, rates, policy.rate_by_heading), policy.pct_abs).alias("gst_correct"),
            F.when(found, po["description"]).alias("po_description"), F.when(found, po["po_number"]).alias("po_number"),
        )

    df = df.withColumn("lines", F.zip_with("_bill", "_pairs", checked))
    failed = lambda field: F.size(F.filter("lines", lambda x: ~x[field]))
    df = df.withColumns({"n_over": failed("qty_ok"), "n_rate": failed("rate_match"), "n_hsn": failed("hsn_valid"), "n_gst": failed("gst_correct"), "n_bill_only": failed("line_match"), "n_po_only": F.size("_po_lines") - F.size(F.filter("_pairs", lambda j: j.isNotNull()))})
    said = lambda cond, text: F.when(cond, text)
    count = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, F.col(c)))

    def repeat(e):
        same = F.coalesce(tax_ids_equal(inv["vendor_gstin"], e["vendor_gstin"]), F.lit(False))
        number = F.coalesce((F.coalesce(e["invoice_number"], F.lit("")) != "") & (F.coalesce(inv["invoice_number"], F.lit("")) != "") & (reference_key(e["invoice_number"]) == reference_key(inv["invoice_number"])), F.lit(False))
        near = F.coalesce(amounts_equal(inv["total"], e["total"], policy.amount_pct, policy.amount_floor) & (e["invoice_date"] == inv["invoice_date"]), F.lit(False))
        return F.when(same & number, F.concat(F.lit("EXACT DUPLICATE of already-processed invoice "), e["invoice_number"])).when(same & near, F.concat(F.lit("Possible duplicate: same vendor/amount/date as "), e["invoice_number"], F.lit(" (diff number)")))

    # fixed values: the report's texts
    flags = F.array(
        said(F.col("ladder.confidence") == "none", "No PO matched (PO checks unverified)"),
        said(F.col("ladder.basis").startswith("possible"), "Possible match only (GSTIN, total off)"),
        said(F.col("ladder.basis").contains("handwritten"), "PR/PO reference is handwritten — review"),
        said(n > 1, F.format_string("Invoice spans %d POs (total vs Σ POs)", n)),
        said(F.col("lump_sum"), "PO is lump-sum — per-line checks N/A"),
        said(F.col("stray").isNotNull(), F.concat(F.lit("Invoice cites PR/PO "), F.col("stray"), F.lit(" that matches no PO"))),
        said(~F.col("date_order"), F.concat(F.lit("Invoice dated "), inv["invoice_date"], F.lit(" is BEFORE PO "), F.col("latest_po_date"))),
        count("n_over", "Over-billed %d line item(s) (billed > ordered)"),
        count("n_rate", "Rate variance on %d line(s)"),
        count("n_hsn", "Invalid HSN/SAC on %d line(s)"),
        count("n_gst", "GST%% mismatch on %d line(s)"),
        count("n_bill_only", "%d billed line(s) not on any PO"),
        said(~F.col("lump_sum") & (F.col("n_po_only") > 0), F.format_string("%d ordered line(s) not billed", F.col("n_po_only"))),
    )
    df = df.withColumn("flags", F.array_compact(F.concat(flags, F.transform(F.coalesce("ledger", F.array().cast(PRIOR)), repeat))))
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    diff = round_to(inv["total"] - F.col("po_sum"), 2)
    parts = F.array_compact(
        F.array(
            said(~F.col("vendor_match"), "Invoice/PO vendor mismatch"),
            said(~F.col("total_match"), F.concat(F.lit("Invoice "), number(inv["total"]), F.lit(" vs PO "), number(round_to(F.col("po_sum"), 2)), F.lit(" (diff "), number(diff), F.lit(")"))),
            said(F.col("outside").isNotNull(), F.concat(F.col("outside.what"), F.lit(" date "), F.col("outside.d"), F.lit(f" outside FY {policy.fy_start}–{policy.fy_end}"))),
        )
    )
    return df.withColumn("reason", F.when(F.col("result") == "No match", F.array_join(parts, "; ")).otherwise("")).drop("_po_lines", "_bill", "_pairs")


HEADER = ("invoice_number", "invoice_date", "vendor_name", "vendor_gstin", "invoice_total", "matched_po_numbers", "po_total_sum", "result", "vendor_match", "total_match", "dates_fy", "po_num_consistent", "date_order", "match_basis", "confidence", "flag_note", "reason")
LINES = ("invoice_number", "line_no", "description", "hsn_sac", "quantity", "unit", "rate", "gst_rate", "amount", "paired_po_line", "po_qty", "po_unit_price", "line_match", "rate_match", "qty_flag", "hsn_valid", "gst_correct")


def csv_report(matched: DataFrame) -> DataFrame:
    """Adds the report as CSV text (a header table, a blank line, a line table), its base64 form and a file name."""
    inv, n = F.col("invoice"), F.size("ladder.matched")
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    numbers = F.concat(F.array_join(F.transform("ladder.matched", lambda p: p["po_number"]), ", "), F.when(n > 1, F.format_string(" (%d)", n)).otherwise(""))
    cells = [inv["invoice_number"], inv["invoice_date"], inv["vendor_name"], inv["vendor_gstin"], number(inv["total"]), numbers, number(round_to(F.col("po_sum"), 2)), F.col("result"), *(state_text(F.col(c)) for c in ("vendor_match", "total_match", "dates_fy", "po_num_consistent", "date_order")), F.col("ladder.basis"), F.col("ladder.confidence"), F.array_join("flags", "; "), F.col("reason")]
    row = lambda values: F.concat_ws(",", *(csv_cell(v) for v in values))
    lump = F.lit("N/A — PO lump-sum")

    def line(x):
        tri = lambda field: state_text(x[field])
        return row([inv["invoice_number"], x["line_no"], x["description"], x["hsn_sac"], number(x["quantity"]), x["unit"], number(x["rate"]), number(x["gst_rate"]), number(x["amount"]), x["paired_po_line"], number(x["po_qty"]), number(x["po_unit_price"]), F.when(F.col("lump_sum"), lump).otherwise(tri("line_match")), tri("rate_match"), F.when(F.col("lump_sum"), lump).otherwise(tri("qty_ok")), tri("hsn_valid"), tri("gst_correct")])

    text = F.concat_ws("\n", F.lit(",".join(HEADER)), row(cells), F.lit(""), F.lit(",".join(LINES)), F.array_join(F.transform("lines", line), "\n"))
    out = matched.withColumn("csv", text)
    name = F.coalesce(F.nullif(inv["invoice_number"], F.lit("")), F.lit("result"))
    return out.withColumns({"csv_base64": F.base64(F.encode("csv", "utf-8")), "csv_filename": F.concat(F.lit("match_"), F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), F.lit(".csv"))})
