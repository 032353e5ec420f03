"""Guards and projections around a reconciliation: load diagnostics, gates, tripwires, one more try, safe views, lanes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.money import cents_text

#: What a line row of the sheet must carry, by part, and the parts of each row type.
LINE_CONTRACT = {
    "invoice": ("line_no", "description", "hsn", "qty", "rate", "gst", "amount"),
    "po": ("line_no", "po_number", "description", "qty_ordered", "rate", "amount"),
    "grn": ("line_no", "grn_number", "description", "qty_received", "receipt_date"),
}
REQUIRES = {"pair": ("invoice", "po"), "bill_only": ("invoice",), "po_only": ("po",), "grn_only": (), "lump_sum": ("po",)}


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def _described(lines: Column) -> Column:
    return F.coalesce(F.exists(lines, lambda x: present(x["description"])), F.lit(False))


def order_gate(po_number: Column, pr_number: Column, vendor: Column, vendor_id: Column, lines: Column) -> Column:
    """An extracted order is usable: both numbers, a vendor by name or tax id, and a described line."""
    return present(po_number) & present(pr_number) & (present(vendor) | present(vendor_id)) & _described(lines)


def receipt_gate(grn_number: Column, po_number: Column, vendor: Column, vendor_id: Column, lines: Column) -> Column:
    return present(grn_number) & present(po_number) & (present(vendor) | present(vendor_id)) & _described(lines)


def zero_load(**kinds: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(kind, files, records, problem) of kinds whose files are there but gave no record.  kinds: name -> (files, records)."""
    parts = [
        files.agg(F.count("*").alias("files")).crossJoin(records.agg(F.count("*").alias("records"))).select(F.lit(kind).alias("kind"), "files", "records")  # a row on each side
        for kind, (files, records) in kinds.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.where("files > 0 and records = 0")
    return out.withColumn("problem", F.format_string("0 %s loaded from %d files — extract key mismatch?", "kind", "files"))


def no_line_items(invoices: DataFrame, lines: str = "lines") -> DataFrame:
    """(n, problem): a row when there are invoices, but not one line among them."""
    n = F.sum(F.size(F.coalesce(F.col(lines), F.array())))
    out = invoices.agg(F.count("*").alias("n"), n.alias("items")).where("n > 0 and items = 0")
    return out.select("n", F.format_string("0 invoice line items across %d invoices — wrong nested key?", "n").alias("problem"))


def empty_lines(findings: DataFrame) -> DataFrame:
    """(register_row, problem) of postings whose invoice has lines while the finding has none."""
    some = lambda c: F.size(F.coalesce(F.col(c), F.array())) > 0
    rows = findings.where(F.col("inv_id").isNotNull() & some("invoice.lines") & ~some("lines"))
    return rows.select("register_row", F.format_string("EMPTY_LINES_ON_MATCH: row %d", "register_row").alias("problem"))


def incomplete_rows(rows: DataFrame) -> DataFrame:
    """(register_row, problem) for each field of the contract that a line row lacks; rows: register_row, row_type, maps invoice and po, grns array of maps."""

    def lacks(part, keys, value):
        return F.transform(F.filter(F.array(*map(F.lit, keys)), lambda k: F.try_element_at(value, k).isNull()), lambda k: F.concat(F.lit(f"{part}."), k))

    gone = [
        F.when(F.col("row_type").isin(*(t for t, parts in REQUIRES.items() if part in parts)), F.when(F.col(part).isNull(), F.array(F.lit(f"{part} part"))).otherwise(lacks(part, LINE_CONTRACT[part], F.col(part))))
        for part in ("invoice", "po")
    ]
    gone.append(F.flatten(F.transform("grns", lambda g: lacks("grn", LINE_CONTRACT["grn"], g))))
    none = F.array().cast("array<string>")
    every = F.concat(*(F.coalesce(g, none) for g in gone))
    said = F.format_string("SCHEMA_INCOMPLETE: %s row %d missing %s", "row_type", "register_row", "what")
    return rows.select("register_row", "row_type", F.explode(every).alias("what")).select("register_row", said.alias("problem"))


def once_more(run: Callable[[DataFrame], DataFrame], postings: DataFrame, broken: Callable[[DataFrame], DataFrame], key: str = "register_row") -> DataFrame:
    """The findings; those that a tripwire names are made once more, and what is still broken then fails the query."""
    first = run(postings)
    bad = broken(first).select(key).distinct()
    again = run(postings.join(bad, key, "left_semi"))
    still = broken(again).select(key).distinct().withColumn("_still", F.lit(True))
    checked = again.join(still, key, "left")
    message = F.concat(F.lit("still incomplete after a second run: row "), F.col(key).cast("string"))
    checked = checked.where(F.when(F.col("_still"), F.raise_error(message)).otherwise(True)).drop("_still")
    return first.join(bad, key, "left_anti").unionByName(checked)


# -- views and lanes ---------------------------------------------------------------


def public_documents(docs: DataFrame) -> DataFrame:
    """What may be shown of a document."""
    one = F.when(F.col("po_number").isNotNull(), F.array("po_number")).otherwise(F.array().cast("array<string>"))
    many = F.when(F.size("po_numbers") > 0, F.col("po_numbers")).otherwise(one).alias("po_numbers")
    return docs.select("batch_id", "index", "filename", "doc_type", "invoice_number", "po_number", many, "vendor", "seller_gstin", cents_text(F.col("total_cents")).alias("total"), "currency", "date", "confidence", "readable")


def public_duplicates(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of duplicates by file name and number."""
    side = lambda s: docs.select("batch_id", F.col("index").alias(s), F.struct("filename", "invoice_number").alias(f"{s}_doc"))
    return pairs.join(side("a"), ["batch_id", "a"]).join(side("b"), ["batch_id", "b"]).select("batch_id", "kind", "a_doc", "b_doc")


def public_ledger(ledger: DataFrame) -> DataFrame:
    """What may be shown of an earlier run's record."""
    amount = F.when(F.col("amount_cents").isNotNull(), cents_text(F.col("amount_cents"))).alias("amount")
    return ledger.select("invoice_number", "vendor", "po_number", amount, F.col("invoice_date").alias("date"), "run_at", "batch_id")


def lanes(*parts: DataFrame) -> DataFrame:
    """Records of several extraction lanes; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def combine(left: DataFrame, right: DataFrame, key: str, position: str) -> DataFrame:
    """Two branches of one request, item by item; an item without a partner stays."""
    return left.join(right, [key, position], "full")


def outcome_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Every invoice of a batch report once: matched, or without an order."""
    found = tables["matched"].select("batch_id", F.col("inv").alias("index"), "invoice_number", "status")
    return found.unionByName(tables["po_missing"].select("batch_id", "index", "invoice_number", F.lit("PO_MISSING").alias("status")))


def value_of(rows: DataFrame, name: str) -> Column:
    """A field that is either a plain value or a struct (value, cite, state)."""
    kind = rows.schema[name].dataType
    if isinstance(kind, StructType) and "value" in kind.names:
        return F.col(f"{name}.value")
    return F.transform(name, lambda x: x["value"]) if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and "value" in kind.elementType.names else F.col(name)


def state_of(rows: DataFrame, name: str) -> Column:
    """The state of such a field; a plain value is its own state."""
    kind = rows.schema[name].dataType
    return F.col(f"{name}.state") if isinstance(kind, StructType) and "state" in kind.names else F.col(name)
