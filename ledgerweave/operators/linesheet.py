"""The lines of invoices, orders and receipts on one sheet: every line of every side once, a row per delivery.

Invoice and order lines were paired by the two-way match.  Receipt lines are attached here, in three passes, each on what
the ones before have left: the same product (an equi-join), a like product, and elimination, where the lines that are
left on both sides can only belong together.  A receipt stays with lines of its own order.  What is attached to nothing
is a ``grn_only`` row, an order line that no invoice line took a ``po_only`` row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import DASH
from ..functions.names import order_key
from ..functions.text import product_name, same_product
from ..policy import FOUR_WAY, MatchPolicy
from .matching import fan_out
from .tables import Stored, numbered

#: The sheet's columns, A to Z.
COLUMNS = (
    "inv_no", "line_no", "description", "hsn_sac", "qty", "rate", "gst", "amount",
    "po_no", "po_line_no", "po_description", "qty_ordered", "po_rate", "po_amount",
    "grn_no", "grn_line_no", "grn_description", "qty_received", "receipt_date",
    "hsn_valid", "gst_correct", "rate_match", "over_receipt", "over_billing", "line_match", "item_match",
)
#: Columns that stand on a line's first row alone.
ONCE = COLUMNS[:14] + COLUMNS[19:]
PARTS = ("billed", "grn_only", "po_only")


def glyph(state: Column) -> Column:
    return F.when(state, "✓").when(~state, "✗").otherwise(DASH)


def _bill(findings: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = findings.select("register_row", F.col("invoice.invoice_number").alias("inv_no"), "lump_sum", (F.size("ladder.matched") > 0).alias("has_order"), F.posexplode("lines").alias("k", "x"))
    return rows.withColumns({"own": product_name(x["description"]), "ordered": product_name(x["po_description"]), "key": order_key(x["po_number"])})


def _ordered(findings: DataFrame) -> DataFrame:
    orders = findings.where("NOT lump_sum").select("register_row", F.posexplode("ladder.matched").alias("p", "o"))
    rows = orders.select("register_row", "p", F.col("o.po_number").alias("po_no"), F.posexplode("o.lines").alias("q", "y"))
    return rows.withColumn("place", F.concat(F.col("po_no"), F.lit("#"), F.col("y.line_no").cast("string")))


def _received(findings: DataFrame) -> DataFrame:
    heads = findings.select("register_row", F.posexplode("grns").alias("g", "r"))
    rows = heads.select("register_row", "g", F.col("r.grn_number").alias("grn_no"), F.col("r.receipt_date").alias("receipt_date"), F.col("r.order_key").alias("order"), F.posexplode("r.lines").alias("i", "z"))
    return rows.withColumn("product", product_name(F.col("z.description")))


def attached(bill: DataFrame, received: DataFrame, policy: MatchPolicy = FOUR_WAY) -> DataFrame:
    """(register_row, g, i, k): the invoice line that each receipt line belongs to, where there is one."""
    line, receipt = ["register_row", "k"], ["register_row", "g", "i"]
    same_order = F.col("key").isNull() | (F.col("key") == F.col("order"))
    first = lambda rows: rows.where(same_order).groupBy(*receipt).agg(F.min("k").alias("k"))
    names = bill.select(*line, "key", F.explode(F.array_distinct(F.filter(F.array("own", "ordered"), lambda n: F.coalesce(n, F.lit("")) != ""))).alias("product"))
    exact = first(received.join(names, ["register_row", "product"]))
    left = received.join(exact, receipt, "left_anti")
    like = lambda c: same_product(F.col(c), F.col("z.description"), policy.min_jaccard)
    alike = first(left.join(bill.select(*line, "key", "x"), "register_row").where(like("x.description") | F.coalesce(like("x.po_description"), F.lit(False))))
    found = exact.unionByName(alike)
    # by elimination: receipts of one product, and one line without any, are left
    left = left.join(alike, receipt, "left_anti").withColumn("products", F.size(F.collect_set("product").over(Window.partitionBy("register_row"))))
    bare = bill.join(found.select(*line).distinct(), line, "left_anti").withColumn("lines", F.count("*").over(Window.partitionBy("register_row")))
    last = first(left.where("products = 1").join(bare.where("lines = 1 AND NOT lump_sum").select(*line, "key"), "register_row"))
    return found.unionByName(last)


def lines_of(findings: DataFrame, policy: MatchPolicy = FOUR_WAY) -> DataFrame:
    """(register_row, part, at, COLUMNS but those of receipts, deliveries): one row an invoice line, receipt line or order line."""
    bill, ordered, received = _bill(findings), _ordered(findings), _received(findings)
    place = attached(bill, received, policy)
    delivery = F.struct("receipt_date", "grn_no", (F.col("i") + 1).alias("line_no"), F.col("z.description").alias("description"), F.col("z.qty_received").alias("qty"))
    one = received.join(place, ["register_row", "g", "i"], "left").withColumn("d", delivery)
    got = one.where("k IS NOT NULL").groupBy("register_row", "k").agg(F.array_sort(F.collect_list("d")).alias("deliveries"))
    none, x, y = F.lit(None), F.col("x"), F.col("y")
    taken = ordered.select("register_row", F.col("place").alias("taken"), "po_no", "y").dropDuplicates(["register_row", "taken"])
    rows = bill.withColumn("taken", x["paired_po_line"]).join(got, ["register_row", "k"], "left").join(taken, ["register_row", "taken"], "left")
    total = F.aggregate("deliveries", F.lit(0.0), lambda a, d: a + F.coalesce(d["qty"], F.lit(0.0)))
    known = F.coalesce(total, F.lit(0.0)) != 0
    states = {
        "hsn_valid": x["hsn_valid"], "gst_correct": x["gst_correct"], "rate_match": x["rate_match"],
        "over_receipt": F.when(known, total <= x["po_qty"] + 1e-9), "over_billing": F.when(known, x["quantity"] <= total + 1e-9), "line_match": x["line_match"],
        "item_match": F.when(x["paired_po_line"].isNotNull() & known, True).when(F.col("has_order") & x["paired_po_line"].isNull() & ~F.col("lump_sum"), False),
    }
    order_part = [F.col("po_no"), y["line_no"].alias("po_line_no"), y["description"].alias("po_description"), y["quantity"].alias("qty_ordered"), y["unit_price"].alias("po_rate"), y["amount"].alias("po_amount")]
    blank = lambda *names: [none.cast(kind).alias(n) for n, kind in names]
    own = (("line_no", "int"), ("description", "string"), ("hsn_sac", "string"), ("qty", "double"), ("rate", "double"), ("gst", "double"), ("amount", "double"))
    order = (("po_no", "string"), ("po_line_no", "int"), ("po_description", "string"), ("qty_ordered", "double"), ("po_rate", "double"), ("po_amount", "double"))
    dashes = [F.lit(DASH).alias(c) for c in COLUMNS[19:]]
    numbers = findings.select("register_row", F.col("invoice.invoice_number").alias("inv_no"))
    billed = rows.select("register_row", F.lit(0).alias("part"), F.col("k").alias("at"), "inv_no", x["line_no"].alias("line_no"), x["description"].alias("description"), x["hsn_sac"].alias("hsn_sac"), x["quantity"].alias("qty"), x["rate"].alias("rate"), x["gst_rate"].alias("gst"), x["amount"].alias("amount"), *order_part, *(glyph(s).alias(c) for c, s in states.items()), "deliveries")
    stray = one.where("k IS NULL").join(numbers, "register_row").select("register_row", F.lit(1).alias("part"), (F.col("g") * 100000 + F.col("i")).alias("at"), "inv_no", *blank(*own, *order), *dashes, F.array("d").alias("deliveries"))
    unbilled = ordered.join(bill.select("register_row", x["paired_po_line"].alias("place")).where("place IS NOT NULL"), ["register_row", "place"], "left_anti").join(numbers, "register_row")
    unbilled = unbilled.select("register_row", F.lit(2).alias("part"), (F.col("p") * 100000 + F.col("q")).alias("at"), "inv_no", *blank(*own), *order_part, *dashes, F.array().cast(billed.schema["deliveries"].dataType).alias("deliveries"))
    return reduce(DataFrame.unionByName, (billed, stray, unbilled))


def full_line_sheet(findings: DataFrame, policy: MatchPolicy = FOUR_WAY, tables: Stored | None = None) -> DataFrame:
    """(register_row, part, at, place, COLUMNS): a row per delivery (one for a line without any); the line's own cells and checks stand on its first row.

    The findings are read several times, so what the sheet needs of them is written once.
    """
    needed = findings.where("inv_id IS NOT NULL").select("register_row", "invoice", "lump_sum", "ladder", "lines", "grns")
    rows = fan_out(lines_of((tables or Stored(findings.sparkSession)).write(needed), policy), "deliveries", *ONCE)
    d = F.col("item")
    rows = rows.withColumns({"grn_no": d["grn_no"], "grn_line_no": d["line_no"], "grn_description": d["description"], "qty_received": d["qty"], "receipt_date": d["receipt_date"]})
    kind = F.element_at(F.array(*map(F.lit, PARTS)), F.col("part") + 1)
    return rows.select("register_row", kind.alias("part"), "at", F.coalesce("place", F.lit(0)).alias("place"), *COLUMNS)


def with_formulas(sheet: DataFrame, tables: Stored | None = None, first: int = 3) -> DataFrame:
    """Adds sheet_row (numbered from ``first``) and, on a line's first row, the checks as formulas over its cells; quantities add up all rows of the line."""
    order = [F.col("register_row"), F.array_position(F.array(*map(F.lit, PARTS)), F.col("part")), F.col("at"), F.col("place")]
    rows = numbered(sheet.withColumn("_part", order[1]), ["register_row", "_part", "at", "place"], tables or Stored(sheet.sparkSession), "sheet_row", first).drop("_part")
    line = Window.partitionBy("register_row", "part", "at")
    a, b = F.min("sheet_row").over(line).cast("string"), F.max("sheet_row").over(line).cast("string")
    rows = rows.withColumns({"_a": a, "_b": b})
    text = lambda s: F.replace(F.replace(F.lit(s), F.lit("{a}"), F.col("_a")), F.lit("{b}"), F.col("_b"))
    formulas = {  # fixed values: the sheet's formulas
        "hsn_valid_formula": '=IF(D{a}="","—",IF(AND(ISNUMBER(VALUE(D{a})),OR(LEN(D{a})=4,LEN(D{a})=6,LEN(D{a})=8)),"✓","✗"))',
        "rate_match_formula": '=IF(OR(F{a}="",M{a}=""),"—",IF(ABS(F{a}-M{a})<=0.01,"✓","✗"))',
        "over_receipt_formula": '=IF(OR(SUM(R{a}:R{b})=0,L{a}=""),"—",IF(SUM(R{a}:R{b})<=L{a},"✓","✗"))',
        "over_billing_formula": '=IF(OR(E{a}="",SUM(R{a}:R{b})=0),"—",IF(E{a}<=SUM(R{a}:R{b}),"✓","✗"))',
    }
    return rows.withColumns({c: F.when(F.col("place") == 0, text(s)) for c, s in formulas.items()}).drop("_a", "_b")
