"""Texts, cells, payloads and scalar functions on the driver's tables, each with SQL for what must be read from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, money, names, text
from ..operators.text_layer import RESPONSE, labels_seen, parse_invoices, parse_orders, payloads, recognised
from ..sources.readers import REGISTER_SYNONYMS, pages, register, register_cells, tool_input, two_files, upload_batch
from ..operators.matching import document_segments
from .queries import _ORDERS, _WHOLE, _money, _read, _whole, bills, orders, query

_DAY = "l AS (SELECT order_id, max(bill_date) AS day FROM b GROUP BY ALL), t AS (SELECT w.*, day FROM w JOIN l USING (order_id))"


def _facts(spark, d):
    """Orders with their bills' sum, last day, and the strings that documents are made of."""
    day = bills(spark, d).groupBy("order_id").agg(F.max("bill_date").alias("day"))
    n = F.col("order_id").cast("string")
    made = {"n": n, "tax": F.concat(F.lit("27"), F.lpad(F.translate(n, "0123456789", "ABCDEFGHIJ"), 5, "K"), F.lpad(n, 4, "0"), F.lit("A1Z5"))}
    return _whole(spark, d).join(day, "order_id").withColumns(made | {"plain": F.format_number(_money("cents"), 2), "ordered": F.format_number(_money("po_cents"), 2)})


_TAX = "'27' || lpad(translate(CAST(order_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ'), 5, 'K') || lpad(CAST(order_id AS VARCHAR), 4, '0') || 'A1Z5'"


@query("text_layer_invoices", f"""WITH {_WHOLE}, {_DAY} SELECT order_id, 'INV-' || order_id AS invoice_number, CAST(day AS VARCHAR) AS invoice_date, 'Firm ' || order_id AS vendor_name, {_TAX} AS vendor_gstin, 'PO-' || order_id AS cited,
CAST(round(cents / 100, 2) AS DOUBLE) AS total, CAST(18.5 AS DOUBLE) AS tax_total, CAST(2 AS INTEGER) AS n_lines, 'PVC elbow no ' || order_id AS description, CAST(0.18 AS DOUBLE) AS gst_rate, CAST(order_id % 9 + 1 AS DOUBLE) AS quantity FROM t""")
def text_layer_invoices(spark, d):
    """Invoices as labelled text with a line table, split taxes and tax ids."""
    f = F.col
    qty = (f("order_id") % 9 + 1).cast("string")
    body = F.concat_ws(
        "\n", F.lit("TAX INVOICE"), F.concat(F.lit("Firm "), f("n"), F.lit("     Old Town")), F.concat(F.lit("GSTIN: "), f("tax")), F.lit("Bill To: Big Build GSTIN 29BBBBB2222B1Z2"),
        F.concat(F.lit("Invoice No: INV-"), f("n"), F.lit(" Invoice Date: "), F.date_format("day", "dd-MM-yyyy")), F.concat(F.lit("Buyer PO Ref: PO-"), f("n")),
        F.lit("Sl Description HSN Qty Unit Price GST% Amount"), F.concat(F.lit("1 PVC elbow no "), f("n"), F.lit(" 3917 "), qty, F.lit(" 100.00 18% 1,000.00")), F.lit("2 Cement bag 2523 2 50.00 18% 100.00"),
        F.lit("CGST 9%: 9.25    SGST 9%: 9.25"), F.concat(F.lit("Grand Total: "), f("plain")),
    )
    rows = parse_invoices(_facts(spark, d).select("order_id", body.alias("text")))
    i, one = f("invoice"), F.get("invoice.lines", F.lit(0))
    cols = [i[c].alias(c) for c in ("invoice_number", "invoice_date", "vendor_name", "vendor_gstin", "total", "tax_total")]
    cited = F.get(i["references"], F.lit(0))["value"].alias("cited")
    return rows.select("order_id", *cols, cited, F.size(i["lines"]).alias("n_lines"), *(one[c].alias(c) for c in ("description", "gst_rate", "quantity")))


@query("text_layer_orders", f"WITH {_WHOLE}, {_DAY} SELECT order_id, 'PO-' || order_id AS po_number, 'PR-' || order_id AS pr_number, 'Firm ' || order_id AS vendor_name, CAST(po_date AS VARCHAR) AS requisition_date, CAST(round(po_cents / 100, 2) AS DOUBLE) AS total, TRUE AS po_itemized FROM t")
def text_layer_orders(spark, d):
    f = F.col
    body = F.concat_ws(
        "\n", F.lit("PURCHASE ORDER"), F.concat(F.lit("PO Number: PO-"), f("n"), F.lit("   PR No: PR-"), f("n")), F.concat(F.lit("PO Date: "), F.date_format("po_date", "dd/MM/yyyy")),
        F.concat(F.lit("Vendor: Firm "), f("n"), F.lit("    "), f("tax")), F.lit("Item Qty Rate Amount"), F.lit("PVC bend 10 100.00 1000.00"), F.lit("Cement bag 2 50.00 100.00"), F.concat(F.lit("PO Total: "), f("ordered")),
    )
    p = F.col("po")
    return parse_orders(_facts(spark, d).select("order_id", body.alias("text"))).select("order_id", *(p[c].alias(c) for c in ("po_number", "pr_number", "vendor_name", "requisition_date", "total", "po_itemized")))


@query("recognised_cells", f"""WITH {_WHOLE} SELECT order_id, 'A-' || order_id AS invoice_number, 'PO-' || order_id AS cited, CAST(round(cents / 100, 2) AS DOUBLE) AS total, CAST(18 AS DOUBLE) AS tax_total, CAST(2 AS INTEGER) AS n_lines,
'Pipe ' || order_id AS first_item, CAST(order_id % 7 + 1 AS DOUBLE) AS quantity, CAST(0.18 AS DOUBLE) AS gst_rate, CAST(5 AS INTEGER) AS n_labels FROM w""")
def recognised_cells(spark, d):
    """Answers of a recogniser: labelled header fields (the first of a field wins) and table cells in any order, a title row among them."""
    f = F.col
    none = F.lit(None).cast("string")
    head = lambda label, value: F.struct(F.lit(label), value, none).cast("struct<label:string,ocr_text:string,value:string>")
    cell = lambda row, label, value: F.struct(F.lit(row), F.lit(0), F.lit(label), value, none).cast("struct<row:int,col:int,label:string,ocr_text:string,value:string>")
    heads = F.array(head("Invoice No", F.concat(F.lit("A-"), f("n"))), head("Bill No", F.lit("late")), head("CGST", F.lit("₹9.00")), head("S.G.S.T", F.lit("9")), head("Grand Total", f("plain")), head("PO Number", F.concat(F.lit("PO-"), f("n"))))
    cells = F.array(
        cell(0, "Description", F.lit("Description")), cell(3, "Description", F.lit("Cement")), cell(3, "Amount", F.lit("100")), cell(1, "Item Name", F.concat(F.lit("Pipe "), f("n"))),
        cell(1, "Description", F.concat(F.lit("Pipe "), f("n"))), cell(1, "Amount", F.lit("5")), cell(1, "Amount", F.lit("7")), cell(1, "Qty", (f("order_id") % 7 + 1).cast("string")), cell(1, "GST", F.lit("18%")),
    )
    response = F.struct(F.array(F.struct(heads, cells))).cast(RESPONSE)
    rows = _facts(spark, d).select("order_id", response.alias("response"))
    labels = labels_seen(rows).select("order_id", F.size("labels").alias("n_labels"))
    i, one = f("invoice"), F.get("invoice.lines", F.lit(0))
    out = recognised(rows, "order_id").join(labels, "order_id")
    return out.select("order_id", i["invoice_number"].alias("invoice_number"), F.get(i["references"], F.lit(0))["value"].alias("cited"), i["total"].alias("total"), i["tax_total"].alias("tax_total"), F.size(i["lines"]).alias("n_lines"), one["description"].alias("first_item"), one["quantity"].alias("quantity"), one["gst_rate"].alias("gst_rate"), "n_labels")


@query("payload_aliases", f"""WITH {_WHOLE} SELECT order_id, 'I-' || order_id AS invoice_number, 'Firm ' || order_id AS vendor_name, CAST(round(cents / 100, 2) AS DOUBLE) AS total, CASE order_id % 3 WHEN 0 THEN 'PO-' || order_id WHEN 1 THEN 'PR ' || order_id ELSE 'X' || order_id END AS cited,
CASE order_id % 3 WHEN 2 THEN 'vendor_ref' ELSE 'buyer_pr_po' END AS kind, order_id % 3 = 2 AS handwritten, CAST(2 AS INTEGER) AS line_no, CAST(3.5 AS DOUBLE) AS quantity, 'PO ' || order_id AS po_number, FALSE AS po_itemized FROM w""")
def payload_aliases(spark, d):
    """Loosely named JSON payloads: references as one text, a list of texts or a list of objects; one order or several."""
    n, k = F.col("n"), F.col("order_id") % 3
    say = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    ref = F.when(k == 0, say('"po_reference": "PO-', n, '"')).when(k == 1, say('"references": ["PR ', n, '"]')).otherwise(say('"references": [{"ref": "X', n, '", "kind": "vendor_ref", "handwritten": true}]'))
    invoice = say('{"invoice_no": "I-', n, '", "seller": "Firm ', n, '", "grand_total": "₹', F.col("plain"), '", ', ref, ', "items": [{"desc": "Pipe"}, {"item": "Rod", "qty": "3.5", "price": 7}]}')
    order = say('{"po_no": "PO ', n, '", "supplier": "Firm ', n, '", "po_total": ', F.replace("ordered", F.lit(","), F.lit("")), ', "items": [{"name": "Lot"}]}')
    body = F.when(k == 1, say('{"invoice": ', invoice, ', "pos": [', order, "]}")).otherwise(say('{"invoice": ', invoice, ', "po": ', order, "}"))
    i, r, x, p = F.col("invoice"), F.get("invoice.references", F.lit(0)), F.get("invoice.lines", F.lit(1)), F.get("pos", F.lit(0))
    rows = payloads(_facts(spark, d).select("order_id", body.alias("payload")))
    return rows.select("order_id", i["invoice_number"].alias("invoice_number"), i["vendor_name"].alias("vendor_name"), i["total"].alias("total"), r["value"].alias("cited"), r["kind"].alias("kind"), r["handwritten"].alias("handwritten"), x["line_no"].alias("line_no"), x["quantity"].alias("quantity"), p["po_number"].alias("po_number"), p["po_itemized"].alias("po_itemized"))


@query("register_sheet", """SELECT CAST(s_suppkey + 5 AS INTEGER) AS register_row, 'Firm ' || s_suppkey AS vendor_name, 'B-' || s_suppkey AS invoice_no, CAST(1000 + s_suppkey AS DECIMAL(18, 2)) AS taxable, CAST(90.5 * 2 AS DECIMAL(18, 2)) AS gst_total, CAST(1181 + s_suppkey AS DECIMAL(18, 2)) AS total, TRUE AS total_derived FROM supplier""")
def register_sheet(spark, d):
    """A worksheet as "row col value" lines: titles above the header, split taxes, no total column, a total row, and rows after a blank one."""
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    head = ["Purchase register", "0 0 My company", "4 0 Vendor Name", "4 1 Bill No", "4 2 Taxable Value", "4 3 CGST", "4 4 SGST"]
    row = F.concat((F.col("k") + 5).cast("string"), F.lit(" "))
    say = lambda col, value: F.concat(row, F.lit(f"{col} "), value)
    cells = F.array(say(0, F.concat(F.lit("Firm "), "k")), say(1, F.concat(F.lit("B-"), "k")), say(2, F.concat(F.lit("₹"), F.format_number(F.col("k") + 1000, 2))), say(3, F.lit("90.50")), say(4, F.lit("90.50")))
    last = s.agg((F.max("k") + 6).alias("n"))
    tail = last.select(F.explode(F.array(F.concat("n", F.lit(" 0 Total")), F.concat("n", F.lit(" 2 99")), F.concat(F.col("n") + 2, F.lit(" 0 Late")), F.concat(F.col("n") + 2, F.lit(" 1 Z-1")))).alias("value"))
    lines = s.select(F.explode(cells).alias("value")).union(tail).union(spark.createDataFrame([(x,) for x in head], "value string"))
    return register(register_cells(lines)).select("register_row", "vendor_name", "invoice_no", "taxable", "gst_total", "total", "total_derived")


#: A sheet a nation: above its header stand as many rows as its number modulo 3; a total column only if the number is even, a
#: single tax column only if it divides by 3; headers go through all known words.
@query("register_sheets", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth, CAST(s_suppkey % 900 + 100 AS DECIMAL(18, 2)) AS net FROM supplier)
SELECT 'book ' || s_nationkey % 4 AS workbook, 'sheet ' || s_nationkey AS sheet, CAST(s_nationkey % 3 + nth AS INTEGER) AS register_row, 'Firm ' || s_suppkey AS vendor_name, '27AAAAA' || s_suppkey AS vendor_gstin, 'B-' || s_suppkey AS invoice_no,
'2025-04-01' AS booking_date, 'PO ' || s_suppkey AS po_no, 'Yard ' || s_nationkey AS site_name, net AS taxable, CAST(18 AS DECIMAL(18, 2)) AS gst_total, CAST(net + 18 AS DECIMAL(18, 2)) AS total, s_nationkey % 2 = 1 AS total_derived FROM s""")
def register_sheets(spark, d):
    """Registers of many workbooks at once, each with titles, header words and columns of its own, a total row, and rows after a blank one."""
    n, k = F.col("n"), F.col("k").cast("string")
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    sheets = s.groupBy("n").agg(F.count("*").alias("many"))
    spoken = [(f, c, i, w) for c, (f, ws) in enumerate(REGISTER_SYNONYMS.items()) for i, w in enumerate(ws)]
    words = spark.createDataFrame([(f, c, i, len(REGISTER_SYNONYMS[f]), w.title()) for f, c, i, w in spoken], "field string, col int, i int, of int, word string")
    split = F.col("field").isin("cgst", "sgst") & (n % 3 > 0) | (F.col("field") == "gst_total") & (n % 3 == 0)
    used = split | (F.col("field") == "total") & (n % 2 == 0) | ~F.col("field").isin("cgst", "sgst", "igst", "gst_total", "total")
    header = sheets.join(F.broadcast(words)).where((n % F.col("of") == F.col("i")) & used)
    line = lambda row, col, value: F.concat_ws(" ", row.cast("string"), col.cast("string"), value).alias("value")
    head, net = n % 3, (F.col("k") % 900 + 100).cast("string")
    value = {"vendor_name": F.concat(F.lit("Firm "), k), "vendor_gstin": F.concat(F.lit("27AAAAA"), k), "invoice_no": F.concat(F.lit("B-"), k), "booking_date": F.lit("2025-04-01"), "po_no": F.concat(F.lit("PO "), k), "site_name": F.concat(F.lit("Yard "), n.cast("string")), "taxable": net, "cgst": F.lit("9"), "sgst": F.lit("9.00"), "gst_total": F.lit("₹18.00"), "total": (F.col("k") % 900 + 118).cast("string")}
    chosen = F.coalesce(*(F.when(F.col("field") == f, v) for f, v in value.items()))
    nth = F.row_number().over(Window.partitionBy("n").orderBy("k"))
    body = s.withColumn("nth", nth).join(header.select("n", "field", "col"), "n").select("n", line(head + F.col("nth"), F.col("col"), chosen))
    end = head + F.col("many") + 1
    more = sheets.select("n", F.explode(F.array(F.lit("Purchases"), line(end, F.lit(0), F.lit("Grand Total")), line(end, F.lit(6), F.lit("99")), line(end + 2, F.lit(0), F.lit("Late")), line(end + 2, F.lit(2), F.lit("Z-1")))).alias("value"))
    title = sheets.where(n % 3 > 0).select("n", F.lit("0 0 My company").alias("value"))
    lines = header.select("n", line(head, F.col("col"), F.col("word"))).union(body).union(more).union(title)
    lines = lines.select(F.concat(F.lit("book "), (n % 4).cast("string")).alias("workbook"), F.concat(F.lit("sheet "), n.cast("string")).alias("sheet"), "value")
    return register(register_cells(lines))


@query("page_bundles", f"WITH {_ORDERS} SELECT CAST(order_id AS VARCHAR) AS stem, CAST(k AS INTEGER) AS segment_index, CASE k WHEN 0 THEN 'invoice' WHEN 1 THEN 'grn' ELSE 'po' END AS doc_type, CASE k WHEN 0 THEN '1-2' WHEN 1 THEN '3' ELSE '4' END AS pages, TRUE AS is_bundle FROM o, range(3) r(k)")
def page_bundles(spark, d):
    """Paged texts with four pages: an invoice that goes on, a receipt note and an order."""
    body = F.concat(F.lit("## Page 1\nTAX INVOICE\n"), F.col("order_id").cast("string"), F.lit("\n## Page 2\ncontinued\n## Page 3\nGOODS RECEIPT NOTE\n## Page 4\nPurchase Order\n"))
    texts = orders(spark, d).select(F.col("order_id").cast("string").alias("stem"), body.alias("text"))
    return document_segments(pages(texts)).select("stem", "segment_index", "doc_type", "pages", "is_bundle")


@query("upload_files", "SELECT CAST(s_suppkey AS VARCHAR) AS batch_id, CAST(i AS INTEGER) AS index, CASE i WHEN 0 THEN s_name || '.PNG' ELSE 'doc-1.pdf' END AS filename, CASE i WHEN 0 THEN 'image/png' ELSE 'application/pdf' END AS media, CASE i WHEN 0 THEN s_name ELSE upper(s_name) END AS body FROM supplier, range(2) r(i)")
def upload_files(spark, d):
    """Files of upload requests: data URIs, plain base64, names and types that are absent."""
    s = _read(spark, d, "supplier")
    b64 = lambda c: F.base64(F.encode(c, "utf-8"))
    file = lambda name, body, kind: F.struct(name.alias("filename"), body.alias("content_base64"), kind.alias("content_type"))
    none = F.lit(None).cast("string")
    files = F.array(file(F.concat("s_name", F.lit(".PNG")), F.concat(F.lit("data:image/png;base64,"), b64(F.col("s_name"))), none), file(none, b64(F.upper("s_name")), none))
    rows = upload_batch(s.select(F.col("s_suppkey").cast("string").alias("batch_id"), files.alias("files")))
    return rows.select("batch_id", "index", "filename", "media", F.decode("content", "utf-8").alias("body"))


@query("upload_pairs", "SELECT s_suppkey AS request_id, 'scan ' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ' bill.pdf' ELSE '.pdf' END AS invoice, s_suppkey || ' po.pdf' AS po FROM supplier")
def upload_pairs(spark, d):
    """Two files a request in either order, told apart by their names."""
    s = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("request_id"))
    k = F.col("request_id").cast("string")
    a = F.struct(F.concat(F.lit("scan "), k, F.when(F.col("request_id") % 2 == 0, " bill.pdf").otherwise(".pdf")).alias("filename"))
    b = F.struct(F.concat(k, F.lit(" po.pdf")).alias("filename"))
    both = two_files(s.withColumn("files", F.when(F.col("request_id") % 3 == 0, F.array(b, a)).otherwise(F.array(a, b))))
    return both.select("request_id", F.col("invoice.filename").alias("invoice"), F.col("po.filename").alias("po"))


@query("reader_answers", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '{}' ELSE '{\"n\":' || s_suppkey || '}' END AS answer FROM supplier")
def reader_answers(spark, d):
    """The first tool block of a reading model's answer, else an empty object."""
    k = F.col("s_suppkey")
    tool = F.concat(F.lit('{"content": [{"type": "text", "input": {"n": 0}}, {"type": "tool_use", "input": {"n":'), k.cast("string"), F.lit('}}, {"type": "tool_use", "input": {"n": 9}}]}'))
    return _read(spark, d, "supplier").select(k.alias("k"), tool_input(F.when(k % 3 == 0, '{"content": []}').otherwise(tool)).alias("answer"))


# -- scalar functions -------------------------------------------------------------

_E = "FROM o"


@query("number_texts", f"""WITH {_ORDERS} SELECT order_id, CAST(round(po_cents / 100, 2) AS DOUBLE) AS to_number, CAST(NULL AS DOUBLE) AS percent_is_no_number, CAST(-(order_id % 50 + 1) AS DOUBLE) AS first_number, CAST(order_id % 28 AS DOUBLE) AS clean_number,
CAST(order_id % 50 AS DOUBLE) AS number_or_zero, CAST(0 AS DOUBLE) AS zero, CAST(NULL AS DOUBLE) AS nothing, CASE WHEN order_id % 28 > 1 THEN (order_id % 28) / 100 ELSE CAST(order_id % 28 AS DOUBLE) END AS fraction, CAST(floor(po_cents / 100 * 10 + 0.5) / 10 AS DOUBLE) AS tenths,
printf('%.1f', CAST(order_id % 50 AS DOUBLE) * 100 / 70) AS percent, '—' AS dash, CASE WHEN order_id % 2 = 1 THEN '-$' ELSE '$' END || (order_id % 900) || '.05' AS cents_text {_E}""")
def number_texts(spark, d):
    """The number readers and writers of the profiles, which differ in what they take for a number."""
    k = F.col("order_id")
    plain, small = F.format_number(_money("po_cents"), 2), (k % 50).cast("string")
    none = F.lit(None).cast("string")
    cents = F.when(k % 2 == 1, -((k % 900) * 100 + 5)).otherwise((k % 900) * 100 + 5)
    return orders(spark, d).select(
        "order_id", money.to_number(F.concat(F.lit("₹ "), plain)).alias("to_number"), money.to_number(F.lit("18%")).alias("percent_is_no_number"), money.first_number(F.concat(F.lit("about -"), (k % 50 + 1).cast("string"), F.lit(" of 1,000"))).alias("_first"),
        money.clean_number(F.concat((k % 28).cast("string"), F.lit(" %"))).alias("clean_number"), money.number_or_zero(small).alias("number_or_zero"), money.number_or_zero(F.lit("n/a")).alias("zero"), money.number_or_null(F.lit("")).alias("nothing"),
        money.tax_fraction(F.concat((k % 28).cast("string"), F.lit("%"))).alias("fraction"), money.round_to(F.col("po_cents") / 100, 1).alias("tenths"), money.percent_text(k % 50, F.lit(70)).alias("percent"), money.money_text(none.cast("decimal(18,2)")).alias("dash"), money.cents_text(cents).alias("cents_text"),
    ).withColumnRenamed("_first", "first_number")


@query("date_texts", f"""WITH {_ORDERS} SELECT order_id, CASE WHEN order_id % 4 = 3 THEN NULL ELSE CAST(po_date AS VARCHAR) END AS batch_date, CASE WHEN order_id % 4 = 3 THEN 'soon' ELSE CAST(po_date AS VARCHAR) END AS iso, CAST(date_diff('day', po_date, DATE '2000-01-01') AS INTEGER) AS age {_E}""")
def date_texts(spark, d):
    """ISO texts of the batch and two-way profiles; what cannot be read is null in the one and stays in the other."""
    k, c = F.col("order_id") % 4, F.col("po_date")
    body = F.when(k == 0, F.date_format(c, "dd/MM/yyyy")).when(k == 1, F.date_format(c, "d MMM yyyy")).when(k == 2, F.date_format(c, "yyyy-MM-dd")).otherwise("soon")
    return orders(spark, d).select("order_id", dates.parse_date_text(body).alias("batch_date"), dates.to_iso(body).alias("iso"), dates.age_days(c, "2000-01-01").alias("age"))


@query("name_keys", f"""WITH {_ORDERS} SELECT order_id, 'acme ' || order_id AS company, 'acme ' || order_id || CASE WHEN order_id % 3 = 2 THEN ' gmbh' ELSE '' END AS party, 'INV' || order_id AS invoice, '27AB' || order_id AS tax, CASE WHEN order_id % 2 = 0 THEN TRUE END AS same, 'PO-' || (order_id + 100) AS cited, CAST(order_id AS VARCHAR) AS batch_key {_E}""")
def name_keys(spark, d):
    n, k = F.col("order_id").cast("string"), F.col("order_id") % 3
    forms = F.element_at(F.array(F.lit(" Pvt. Ltd."), F.lit(" (Private) Limited"), F.lit(" GmbH")), (k + 1).cast("int"))
    plain = F.concat(F.lit("The ACME  "), n, F.element_at(F.array(F.lit(" Pvt. Ltd."), F.lit(", LLP"), F.lit(" & Co")), (k + 1).cast("int")))
    corp = F.concat(F.lit("ACME "), n, forms, F.when(k == 1, " Corp").otherwise(""))
    other = F.when(F.col("order_id") % 2 == 0, F.concat(F.lit("27 ab"), n))
    return orders(spark, d).select(
        "order_id", names.company_name(plain).alias("company"), names.party_name(corp).alias("party"), names.invoice_key(F.concat(F.lit("000 inv/"), n)).alias("invoice"), names.tax_id(F.concat(F.lit("27-ab "), n)).alias("tax"),
        names.tax_ids_equal(F.concat(F.lit("27AB"), n), other).alias("same"), names.cited_order(F.concat(F.lit("see order "), (F.col("order_id") + 100).cast("string"))).alias("cited"), names.batch_order_key(F.concat(F.lit("pr-"), n)).alias("batch_key"),
    )


@query("text_helpers", f"""WITH {_ORDERS} SELECT order_id, 'pvc elbow ' || order_id AS product, CASE WHEN order_id >= 100 THEN 'pvc,elbow,' || order_id ELSE 'pvc,elbow' END AS long_words, TRUE AS same, FALSE AS other, CASE WHEN order_id % 3 = 0 THEN 1 ELSE CAST(order_id AS INTEGER) END AS page,
'say ''' || order_id || ''' / now' AS sheet, '"a ""' || order_id || '"", b"' AS cell, CASE WHEN order_id % 2 = 0 THEN 'image/jpeg' ELSE 'application/pdf' END AS media, CASE WHEN order_id % 2 = 0 THEN TRUE END AS site, 0.5::DOUBLE AS jaccard {_E}""")
def text_helpers(spark, d):
    n, k = F.col("order_id").cast("string"), F.col("order_id")
    item = F.concat(F.lit("PVC bend, size no. "), n)
    words = text.long_words(F.lit("alpha beta gamma"))
    return orders(spark, d).select(
        "order_id", text.product_name(item).alias("product"), F.array_join(text.long_words(F.concat(F.lit("PVC elbow / "), n)), ",").alias("long_words"), text.same_product(item, F.concat(F.lit("elbow "), n)).alias("same"), text.same_product(item, F.lit("")).alias("other"),
        text.cite_page(F.when(k % 3 == 0, "p. 7").otherwise(n)).alias("page"), text.sheet_safe(F.concat(F.lit('say "'), n, F.lit('" |\nnow'))).alias("sheet"), text.csv_cell(F.concat(F.lit('a "'), n, F.lit('", b'))).alias("cell"),
        text.media_type(F.concat(n, F.when(k % 2 == 0, ".JPG").otherwise(".bin"))).alias("media"), text.same_site(F.concat(F.lit("Site "), n), F.when(k % 2 == 0, F.concat(n, F.lit(" site MANIPUR"))).otherwise("Elsewhere")).alias("site"),
        text.token_jaccard(words, text.long_words(F.lit("beta gamma delta"))).alias("jaccard"),
    )
