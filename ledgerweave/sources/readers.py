"""Sources: documents, master data, ledgers, rate tables, registers and request payloads as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY
from ..functions.text import media_type
from ..policy import TAX_RATES

VENDOR = "vendor_id string, name string, aliases array<string>, approved boolean, payment_terms string"
ORDER = "po_number string, vendor_id string, total_amount string, currency string, status string, allow_partial boolean, description string"
ENTRY = "invoice_number string, vendor_id string, po_number string, total string, invoice_date string, amount_applied string, decision string"


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per text file: doc_id and source_file (its path), raw_text; kind "text"."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.trim("value").alias("raw_text"))
    return rows.select(F.col("source_file").alias("doc_id"), "source_file", "raw_text", F.lit("text").alias("kind"), F.lit(1).alias("page_count"))


def binary_documents(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """A row per binary file; ``pages`` is the reader of page texts (a PDF library's, say), run where the files are read."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            texts = [pages(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"doc_id": b["path"], "source_file": b["path"], "raw_text": ["\n".join(t).strip() for t in texts], "kind": "pdf", "page_count": [len(t) for t in texts]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "doc_id string, source_file string, raw_text string, kind string, page_count int")


def directory(pdf: DataFrame, text: DataFrame) -> DataFrame:
    """Both kinds; ``seq`` orders PDFs by name, then texts by name."""
    rows = pdf.unionByName(text)
    return rows.withColumn("rank", F.struct((F.col("kind") == "text").cast("int").alias("kind"), "source_file"))


def master(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vendors, orders) of a JSON object with two arrays; places in the arrays are kept as seq."""
    raw = spark.read.schema(f"vendors array<struct<{_fields(VENDOR)}>>, purchase_orders array<struct<{_fields(ORDER)}>>").json(path, multiLine=True)
    vendors = raw.select(F.posexplode("vendors").alias("seq", "v")).select("seq", "v.*")
    orders = raw.select(F.posexplode("purchase_orders").alias("seq", "p")).select("seq", "p.*")
    return vendor_defaults(vendors), order_defaults(orders)


def _fields(ddl: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (f.split(" ", 1) for f in ddl.split(", ")))


def vendor_defaults(vendors: DataFrame) -> DataFrame:
    return vendors.withColumns({"aliases": F.coalesce("aliases", F.array().cast("array<string>")), "approved": F.coalesce("approved", F.lit(True)), "payment_terms": F.coalesce("payment_terms", F.lit("NET30"))})


def order_defaults(orders: DataFrame) -> DataFrame:
    return orders.withColumns(
        {
            "total_amount": F.col("total_amount").cast("string").try_cast(MONEY),
            "currency": F.coalesce("currency", F.lit("USD")),
            "status": F.coalesce("status", F.lit("open")),
            "allow_partial": F.coalesce("allow_partial", F.lit(False)),
            "description": F.coalesce("description", F.lit("")),
        }
    )


def ledger(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"entries array<struct<{_fields(ENTRY)}>>").json(path, multiLine=True)
    return ledger_defaults(raw.select(F.posexplode("entries").alias("seq", "e")).select("seq", "e.*"))


def ledger_defaults(entries: DataFrame) -> DataFrame:
    """An empty total is null; an absent applied amount is 0."""
    return entries.withColumns(
        {
            "total": F.nullif(F.col("total").cast("string"), F.lit("")).try_cast(MONEY),
            "invoice_date": F.col("invoice_date").cast("string").try_cast("date"),
            "amount_applied": F.coalesce(F.col("amount_applied").cast("string").try_cast(MONEY), F.lit(0).cast(MONEY)),
            "decision": F.coalesce("decision", F.lit("")),
        }
    )


def upload_batch(requests: DataFrame) -> DataFrame:
    """A row per file of each request (batch_id, files array of (filename, content_base64, content_type)); a request without files fails."""
    some = F.when(F.size(F.coalesce("files", F.array())) > 0, F.col("files")).otherwise(F.raise_error(F.lit("a batch needs files")))
    rows = requests.select("batch_id", F.posexplode(some).alias("index", "f"))
    body = F.unbase64(F.regexp_replace("f.content_base64", "^data:[^;]+;base64,", ""))
    return rows.select("batch_id", "index", F.coalesce("f.filename", F.format_string("doc-%d.pdf", "index")).alias("filename"), media_type(F.coalesce("f.content_type", "f.filename")).alias("media"), body.alias("content"))


def two_files(requests: DataFrame) -> DataFrame:
    """(request_id, invoice, po): files named like an order or an invoice, else in upload order; two files at least."""
    files = F.col("files")
    is_po = lambda f: F.lower(f["filename"]).rlike(r"(^|[^a-z])p[or]([^a-z]|$)|purchase|order")
    is_inv = lambda f: F.lower(f["filename"]).rlike("inv|bill")
    inv, po = F.get(F.filter(files, is_inv), F.lit(0)), F.get(F.filter(files, lambda f: is_po(f) & ~is_inv(f)), F.lit(0))
    enough = F.when(F.size(files) >= 2, True).otherwise(F.raise_error(F.lit("two files are needed")))
    return requests.where(enough).select("request_id", F.coalesce(inv, F.get(F.filter(files, lambda f: ~is_po(f)), F.lit(0)), F.get(files, F.lit(0))).alias("invoice"), F.coalesce(po, F.get(F.filter(files, lambda f: ~is_inv(f)), F.lit(0)), F.get(files, F.lit(1))).alias("po"))


def external_reader(files: DataFrame, read: Callable[[bytes, str], str], schema: str) -> DataFrame:
    """Runs a reader (a model or service client) where the files are; its JSON answer is parsed to ``schema`` as ``doc``."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            out = b[["batch_id", "index", "filename"]].copy()
            out["answer"] = [read(bytes(c), m) for c, m in zip(b["content"], b["media"])]
            yield out

    rows = files.mapInPandas(run, "batch_id string, index int, filename string, answer string")
    return rows.withColumn("doc", F.from_json("answer", schema)).drop("answer")


TOOL_ANSWER = "content array<struct<type:string,input:string>>"


def tool_input(answer: Column) -> Column:
    """The input of the first tool_use block of a reader's answer, else an empty object."""
    blocks = F.from_json(answer, TOOL_ANSWER)["content"]
    return F.coalesce(F.get(F.filter(blocks, lambda b: b["type"] == "tool_use"), F.lit(0))["input"], F.lit("{}"))


def json_payload(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """The payload, given as JSON text; an absent one fails with a helpful message."""
    value = F.when(F.coalesce(F.col(column), F.lit("")) != "", F.col(column)).otherwise(F.raise_error(F.lit(f"{column}: expected a JSON object")))
    return rows.withColumn(column, F.from_json(value, schema))


def tax_rates(spark: SparkSession, path: str | None = None, override: dict[str, float] | None = None) -> DataFrame:
    """(hsn_sac, rate as a fraction): a CSV with comment lines, or the built-in table; an override wins."""
    if path:
        rows = spark.read.csv(path, header=True, comment="#").select(F.trim("hsn_sac").alias("hsn_sac"), (F.col("gst_percent").try_cast("double") / 100).alias("rate"))
    else:
        rows = spark.createDataFrame([(k, v / 100) for k, v in TAX_RATES.items()], "hsn_sac string, rate double")
    if override:
        own = spark.createDataFrame([(k, float(v)) for k, v in override.items()], "hsn_sac string, own double")
        rows = rows.join(own, "hsn_sac", "full").select("hsn_sac", F.coalesce("own", "rate").alias("rate"))
    return rows


#: What names a sheet; cells without these columns are one sheet.
SHEET = ("workbook", "sheet")


def register_cells(text: DataFrame, column: str = "value") -> DataFrame:
    """Cells of lines "row col value", beside the columns that name their sheet; other lines are passed over."""
    pattern = r"^\s*(\d+)\s+(\d+)\s?(.*)$"
    keys = [c for c in SHEET if c in text.columns]
    return text.where(F.col(column).rlike(pattern)).select(*keys, F.regexp_extract(column, pattern, 1).cast("int").alias("row"), F.regexp_extract(column, pattern, 2).cast("int").alias("col"), F.nullif(F.trim(F.regexp_extract(column, pattern, 3)), F.lit("")).alias("value"))


#: Header words of a register's columns, in their source's order; then words of our own.
REGISTER_SYNONYMS = {
    "vendor_name": ("vendor", "supplier", "party", "party name", "name", "account", "vendor name", "supplier name", "particulars"),
    "vendor_gstin": ("gstin", "gst no", "gst number", "gstin/uin", "vendor gstin", "supplier gstin"),
    "invoice_no": ("invoice no", "inv no", "bill no", "bill #", "voucher no", "document no", "ref no", "invoice number", "bill number", "supplier invoice no"),
    "booking_date": ("date", "invoice date", "bill date", "voucher date", "posting date", "booking date"),
    "po_no": ("po no", "po number", "purchase order", "order no"),
    "site_name": ("site", "site name", "project", "project site", "location"),
    "taxable": ("taxable", "taxable value", "basic", "net", "net amount", "sub total", "amount", "taxable amount", "basic amount"),
    "cgst": ("cgst", "central tax", "cgst amount"),
    "sgst": ("sgst", "state tax", "sgst amount"),
    "igst": ("igst", "integrated tax", "igst amount"),
    "gst_total": ("gst", "tax", "tax amount", "total tax", "gst amount", "gst total", "total gst"),
    "total": ("total", "grand total", "invoice amount", "amount payable", "gross", "net payable", "gross total", "invoice value", "total amount", "gross amount", "bill amount"),
}
#: Fields of which a wrong column would spoil every verdict: two columns that claim one are asked about, not guessed.
REGISTER_MONEY = ("taxable", "cgst", "sgst", "igst", "gst_total", "total")


def header_word(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


def _sheets(cells: DataFrame) -> DataFrame:
    """Cells with both columns of SHEET."""
    return cells.select(*(F.col(c) if c in cells.columns else F.lit("").alias(c) for c in SHEET), "row", "col", "value")


def register_columns(cells: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(workbook, sheet, row of the header, col, field, header, ambiguous), one election a sheet.

    The row with most known words is the header (ties: the first).  Of two columns for one field the word that is listed
    first wins, then the left one; for money both are ambiguous.  forced: (workbook, sheet, field, col) decides instead.
    """
    spark = cells.sparkSession
    words = spark.createDataFrame([(header_word(w), f, k) for f, ws in REGISTER_SYNONYMS.items() for k, w in enumerate(ws)], "word string, field string, place int")
    bare = F.trim(F.regexp_replace(F.lower("value"), "[^a-z0-9]+", " "))
    hits = _sheets(cells).withColumn("word", bare).join(F.broadcast(words), "word")  # a fixed table of a few dozen rows
    head = hits.groupBy(*SHEET, "row").agg(F.countDistinct("field").alias("n")).groupBy(*SHEET).agg(F.min(F.struct(-F.col("n"), "row")).alias("best")).select(*SHEET, F.col("best.row").alias("row"))
    claims = hits.join(head, [*SHEET, "row"]).groupBy(*SHEET, "row", "field").agg(F.array_sort(F.collect_list(F.struct("place", "col", "value"))).alias("every"))
    if forced is not None:
        asked = forced.select(*(F.col(c) if c in forced.columns else F.lit("").alias(c) for c in SHEET), "field", F.col("col").alias("own"))
        heads = _sheets(cells).join(head, [*SHEET, "row"]).select(*SHEET, "row", "col", F.col("value").alias("header"))
        own = asked.join(heads.withColumnRenamed("col", "own"), [*SHEET, "own"]).select(*SHEET, "row", F.col("own").alias("col"), "field", "header", F.lit(False).alias("ambiguous"))
        claims = claims.join(asked.select(*SHEET, "field"), [*SHEET, "field"], "left_anti").select(*claims.columns)
    money = F.col("field").isin(*REGISTER_MONEY) & (F.size("every") > 1)
    picked = F.when(money, F.col("every")).otherwise(F.slice("every", 1, 1))
    out = claims.select(*SHEET, "row", "field", money.alias("ambiguous"), F.explode(picked).alias("e")).select(*SHEET, "row", F.col("e.col").alias("col"), "field", F.col("e.value").alias("header"), "ambiguous")
    return out if forced is None else out.unionByName(own)


def register_questions(cells: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(workbook, sheet, field, candidates array of (header, col)): money columns that somebody has to choose between."""
    unsure = register_columns(cells, forced).where("ambiguous")
    return unsure.groupBy(*SHEET, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "header"))), lambda c: F.struct(c["header"].alias("header"), c["col"].alias("col"))).alias("candidates"))


def register(cells: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Postings of every sheet under its header row up to its first blank row, total rows left out; tax from one column or the
    split ones, total derived if absent.  Names of workbook and sheet come along where the cells have them."""
    keys = [c for c in SHEET if c in cells.columns]
    columns, every = register_columns(cells, forced), _sheets(cells)
    heads = columns.groupBy(*SHEET).agg(F.max("row").alias("head"))
    # the first blank row: the places between the header and a row are all filled
    filled = every.where("value is not null").select(*SHEET, "row").distinct().join(heads, list(SHEET)).where("row > head")
    run = filled.withColumn("gap", F.col("row") - F.col("head") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))).where("gap = 0").select(*SHEET, "row")
    body = every.join(columns.where("not ambiguous").select(*SHEET, F.col("row").alias("head"), "col", "field"), [*SHEET, "col"]).where("row > head")
    rows = body.groupBy(*SHEET, "row").pivot("field", list(REGISTER_SYNONYMS)).agg(F.first("value"))
    amount = lambda c: F.regexp_replace(c, "[,₹$ ]", "").try_cast(MONEY)
    parts = [F.coalesce(amount(c), F.lit(0).cast(MONEY)) for c in ("cgst", "sgst", "igst")]
    split = F.when(F.coalesce("cgst", "sgst", "igst").isNotNull(), (parts[0] + parts[1] + parts[2]).cast(MONEY))
    tax = F.coalesce(amount("gst_total"), split)
    is_total = F.coalesce(F.lower("vendor_name"), F.lower("invoice_no"), F.lit("total")).rlike(r"^\s*(grand |sub ?)?total")
    return (
        rows.join(run, [*SHEET, "row"])
        .where(~(is_total & F.col("invoice_no").isNull()))
        .select(*keys, F.col("row").alias("register_row"), "vendor_name", "vendor_gstin", "invoice_no", "booking_date", "po_no", "site_name", amount("taxable").alias("taxable"), tax.alias("gst_total"), F.coalesce(amount("total"), F.try_add(amount("taxable"), tax).cast(MONEY)).alias("total"), F.col("total").isNull().alias("total_derived"))
    )


def pages(texts: DataFrame, stem: str = "stem", text: str = "text") -> DataFrame:
    """(stem, page, text) of texts with "## Page N" anchors; without anchors, one page."""
    parts = F.filter(F.split(F.col(text), r"(?m)^## Page \d+[^\n]*\n?"), lambda p: F.trim(p) != "")
    return texts.select(stem, F.posexplode(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.col(text)))).alias("p", "text")).select(stem, (F.col("p") + 1).alias("page"), "text")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(filename, bytes): what there is to be covered."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"))


def route(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sample requests, uploads)."""
    sample = F.coalesce(F.col("mode"), F.lit("")) == "sample"
    return requests.where(sample), requests.where(~sample)


def findings(spark: SparkSession, path: str, schema: str, key: str = "findings") -> DataFrame:
    """Rows of a JSON object's array under a fixed top-level key."""
    return spark.read.schema(f"{key} array<{schema}>").json(path, multiLine=True).select(F.explode(key).alias("f")).select("f.*")
