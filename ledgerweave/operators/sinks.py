"""Sinks: JSON per document, report objects, CSV, augmented registers, line sheets and append-only workpapers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import DASH
from ..functions.text import sheet_safe
from .matching import fan_out
from .tables import Stored, numbered


def json_documents(decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, value): one JSON object a document, pretty-printed."""
    return decided.select(id_col, F.to_json(F.struct(*[c for c in decided.columns if not c.startswith("_")]), {"pretty": "true"}).alias("value"))


def write_json(decided: DataFrame, path: str, id_col: str = "doc_id", a_file: int = 10_000) -> None:
    """Documents as JSON lines, about ``a_file`` of them a file in order of their ids, and beside them an index: the ids that each file reaches from and to.

    The number of files follows the number of documents; a document is found by its file alone (``read_json``).
    """
    rows = decided.select(id_col, F.struct(*[c for c in decided.columns if not c.startswith("_")]).alias("document"))
    files = max(1, -(-rows.count() // a_file))
    rows.repartitionByRange(files, id_col).sortWithinPartitions(id_col).write.mode("overwrite").json(path)
    kind = decided.schema[id_col].dataType.simpleString()
    written = decided.sparkSession.read.schema(f"{id_col} {kind}").json(path).select(F.col(id_col).alias("id"), F.col("_metadata.file_name").alias("file"))
    index = written.groupBy("file").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("documents"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/_index")  # a row a file; readers pass over names like this


def read_json(spark: SparkSession, path: str, schema: str, ids: list, id_col: str = "doc_id") -> DataFrame:
    """The documents of some ids, from those files that the index names."""
    index = spark.read.parquet(f"{path}/_index")
    wanted = spark.createDataFrame([(i,) for i in ids], f"id {index.schema['least'].dataType.simpleString()}")
    files = [r["file"] for r in index.join(F.broadcast(wanted), F.col("id").between(F.col("least"), F.col("most"))).select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], schema)
    kind = index.schema["least"].dataType.simpleString()
    rows = spark.read.schema(f"{id_col} {kind}, document struct<{schema}>").json([f"{path}/{f}" for f in files])
    return rows.where(F.col(id_col).isin(ids)).select("document.*")


def run_summary(decided: DataFrame) -> DataFrame:
    return decided.select("doc_id", "decision.outcome").orderBy("doc_id")


def rendered(decided: DataFrame) -> DataFrame:
    """(doc_id, report): a text report, written where the rows are."""
    stage = lambda name, c: F.concat(F.lit(f"{name}\n"), F.array_join(F.transform(c, lambda f: F.concat(F.lit("  ["), f["code"], F.lit("] "), f["message"])), "\n"))
    return decided.select("doc_id", F.concat_ws("\n", F.concat(F.lit("== "), F.col("doc_id").cast("string")), stage("validate", "validate_findings"), stage("match", "match_findings"), stage("rules", "rule_findings"), F.concat(F.lit("decision: "), F.col("decision.outcome"), F.lit(" — "), F.col("decision.headline"))).alias("report"))


def report_document(tables: dict[str, DataFrame]) -> DataFrame:
    """(batch_id, report): the tables of a batch reconciliation as one JSON object a batch."""
    out = tables["summary"].select("batch_id", F.struct(*[c for c in tables["summary"].columns if c != "batch_id"]).alias("summary"))
    for name, rows in tables.items():
        if name != "summary":
            out = out.join(rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in rows.columns if c != "batch_id"])))).alias(name)), "batch_id", "left")
    return out.select("batch_id", F.to_json(F.struct(*[c for c in out.columns if c != "batch_id"])).alias("report"))


def shown(value: Column, found: Column) -> Column:
    """A dash for what is missing on a row that has a document; nothing otherwise."""
    return F.when(found, F.coalesce(sheet_safe(value.cast("string")), F.lit(DASH)))


def augmented_register(register: DataFrame, findings: DataFrame, bands: dict[str, dict[str, Column]]) -> DataFrame:
    """The register's own columns, then the bands (band -> title -> value); postings without an invoice stay blank.

    Rows are keyed by register_row, so a second run overwrites the first one's.
    """
    found = F.col("result") != ""
    cols = [shown(c, found).alias(f"{band} {title}") for band, titles in bands.items() for title, c in titles.items()]
    return register.join(findings.select("register_row", "result", *cols), "register_row", "left").orderBy("register_row")


def chain_bands() -> dict[str, dict[str, Column]]:
    """Columns of a four-way finding by band: several orders or receipts are listed with their count, totals are sums, dates the earliest."""
    listed = lambda c, f: F.concat(F.array_join(F.transform(c, lambda x: x[f]), ", "), F.when(F.size(c) > 1, F.format_string(" (%d)", F.size(c))).otherwise(""))
    pos = F.col("ladder.matched")
    itemized = F.transform(pos, lambda p: F.coalesce(p["po_itemized"], F.lit(False)))
    kind = F.when(F.size(pos) == 0, None).when(F.forall(itemized, lambda x: x), "Itemized").when(F.forall(itemized, lambda x: ~x), "Lump-sum").otherwise("Mixed")
    state = lambda c: F.when(F.col(c), "✓").when(~F.col(c), "✗")
    checks = ("vendor_match", "total_match", "dates_fy", "register_taxable", "register_gst", "register_total", "po_num_consistent", "date_order", "receipt_after_order", "receipt_before_invoice", "booked_after_invoice", "site_consistent")
    i = F.col("invoice")
    return {
        "INVOICE": {"Inv No": i["invoice_number"], "Date": i["invoice_date"], "Vendor": i["vendor_name"], "Tax id": i["vendor_gstin"], "Taxable": i["taxable_total"], "Tax": i["tax_total"], "Total": i["total"]},
        "PO": {"No": listed(pos, "po_number"), "Date": F.array_min(F.transform(pos, lambda p: p["requisition_date"])), "Total": F.col("po_sum"), "Type": kind, "Basis": F.col("chain_basis"), "Confidence": F.col("chain_confidence")},
        "GRN": {"No": listed(F.col("grns"), "grn_number"), "First": F.col("first_receipt"), "Lines": F.size(F.filter("quantities", lambda q: q["received"].isNotNull())), "Flow": F.array_join(F.array_distinct(F.transform("quantities", lambda q: q["flow"])), "; ")},
        "CHECKS": {"Result": F.col("result"), **{c: state(c) for c in checks}, "Reason": F.col("reason"), "Flags": F.array_join("flags", "; ")},
    }


def line_sheet(findings: DataFrame) -> DataFrame:
    """A row per delivery of a line's own item; the line's own cells stand on its first row alone."""
    rows = findings.select("register_row", F.explode("quantities").alias("q"))
    cells = ("line_no", "billed", "ordered", "received", "flow", "deliveries")
    rows = rows.select("register_row", *(F.col(f"q.{c}").alias(c) for c in cells))
    out = fan_out(rows, "deliveries", "billed", "ordered", "received", "flow")
    delivered = (F.col("item.grn_number").alias("grn_number"), F.col("item.receipt_date").alias("receipt_date"), F.col("item.qty").alias("delivered"))
    return out.select("register_row", "line_no", "place", "billed", "ordered", "received", "flow", *delivered)


def workpaper(existing: DataFrame | None, results: DataFrame, keys: list[str], order: list, tables: Stored | None = None) -> DataFrame:
    """New rows alone, numbered on from the last, in order; a key that stands there already is skipped."""
    fresh, last = results, 0
    if existing is not None:
        fresh = results.join(existing.select(*keys), keys, "left_anti")
        last = existing.agg(F.max("seq")).first()[0] or 0
    return numbered(fresh, order, tables or Stored(results.sparkSession), "seq", last + 1)


def formula(state: str, a: str, b: str, tolerance: float, floor: float = 1.0) -> Column:
    """A check as a sheet formula over two cells, beside its value."""
    return F.lit(f'=IF(OR({a}="",{b}=""),"—",IF(ABS({a}-{b})<=MAX({floor},{tolerance}*ABS({b})),"{state}","✗"))')
