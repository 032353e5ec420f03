"""Relational building blocks: ladders, uniqueness, coverage, duplicates, segments, fan-out and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_kind, page_range
from .bands import band_join


def ladder(anchor: str, *rungs: tuple[str, str, DataFrame]) -> DataFrame:
    """The candidates of each anchor's first rung that has any.  rungs: (basis, confidence, rows); adds rung, basis and n_candidates."""
    tagged = [rows.withColumns({"rung": F.lit(k), "basis": F.lit(basis), "confidence": F.lit(sure)}) for k, (basis, sure, rows) in enumerate(rungs, 1)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    w = Window.partitionBy(anchor)
    return every.withColumn("_first", F.min("rung").over(w)).where("rung = _first").drop("_first").withColumn("n_candidates", F.count("*").over(w))


def only_unique(candidates: DataFrame, anchor: str) -> DataFrame:
    """Those anchors that have exactly one candidate."""
    return candidates.withColumn("_n", F.count("*").over(Window.partitionBy(anchor))).where("_n = 1").drop("_n")


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(left rows without a right one, right rows without a left one)."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti"), right.join(left.select(*keys).distinct(), keys, "left_anti")


def duplicate_pairs(rows: DataFrame, id_col: str, vendor: str, number: str, cents: str, date: str, tolerance: int = 1) -> DataFrame:
    """(a, b, kind), a before b: EXACT for one vendor and number, else NEAR for one vendor, date and about the same amount.

    Each kind is an equi-join, so no vendor's rows are all paired.
    """
    one = rows.select(F.col(id_col).alias("id"), F.col(vendor).alias("v"), F.upper(F.col(number)).alias("n"), F.col(cents).alias("c"), F.col(date).alias("d"))
    other = one.select(*(F.col(c).alias(f"{c}2") for c in one.columns))
    both = (F.col("v") == F.col("v2")) & (F.col("id") < F.col("id2"))
    same = F.coalesce((F.col("n") == F.col("n2")) & (F.col("n") != ""), F.lit(False))
    exact = one.join(other, both & (F.col("n") == F.col("n2"))).where(same).select(F.col("id").alias("a"), F.col("id2").alias("b"), F.lit("EXACT").alias("kind"))
    near = band_join(one, other, [("v", "v2"), ("d", "d2")], ("c", "c2"), floor=tolerance).where(both & (F.abs(F.col("c") - F.col("c2")) <= tolerance) & ~same).select(F.col("id").alias("a"), F.col("id2").alias("b"), F.lit("NEAR").alias("kind"))
    return exact.union(near)


def flagged_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def segments(pages: DataFrame, stem: str, page: str, starts: Column, kind: Column | None = None) -> DataFrame:
    """Runs of pages: a page that starts one, and those that continue it.  (stem, segment_index, first_page, last_page, n_pages, pages[, doc_type])."""
    w = Window.partitionBy(stem).orderBy(page)
    rows = pages.withColumn("_start", starts | (F.row_number().over(w) == 1)).withColumn("segment_index", F.sum(F.col("_start").cast("int")).over(w).cast("int") - 1)
    aggs = [F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("n_pages")]
    if kind is not None:
        aggs.append(F.min_by(kind, page).alias("doc_type"))
    out = rows.groupBy(stem, "segment_index").agg(*aggs)
    return out.withColumn("pages", page_range(F.col("first_page"), F.col("last_page")))


def document_segments(pages: DataFrame, head_lines: int = 15) -> DataFrame:
    """Segments of (stem, page, text): a page whose first lines have a title starts a document."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, head_lines), "\n")
    rows = pages.withColumn("_kind", page_kind(head))
    out = segments(rows, "stem", "page", F.col("_kind") != "continuation", F.col("_kind"))
    return out.withColumn("is_bundle", F.count("*").over(Window.partitionBy("stem")) > 1)


def fan_out(rows: DataFrame, items: str, *once: str) -> DataFrame:
    """A row per item (one without any, too); the columns in ``once`` are null on all but the first."""
    out = rows.select("*", F.posexplode_outer(items).alias("place", "item"))
    first = F.coalesce(F.col("place"), F.lit(0)) == 0
    return out.withColumns({c: F.when(first, F.col(c)) for c in once})


def row_type(invoice: Column, order: Column, receipt: Column, lump_sum: Column) -> Column:
    """What a line row is: pair, bill_only, po_only, grn_only, or lump_sum."""
    return (
        F.when(lump_sum & invoice.isNull(), "lump_sum")
        .when(invoice.isNotNull() & order.isNotNull(), "pair")
        .when(invoice.isNotNull(), "bill_only")
        .when(order.isNotNull(), "po_only")
        .when(receipt.isNotNull(), "grn_only")
    )


def count_phrase(matched: Column, total: Column, lump_sum: Column) -> Column:
    return (
        F.when(lump_sum, "N/A — PO lump-sum")
        .when(total == 0, "—")
        .when(matched == total, F.concat(F.lit("All matched ("), matched.cast("string"), F.lit("/"), total.cast("string"), F.lit(")")))
        .when(matched == 0, "None matched")
        .otherwise(F.concat(matched.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" matched")))
    )


def flow_phrase(ordered: Column, received: Column, billed: Column) -> Column:
    """Ordered, received and billed quantities in words; null while receipts are unknown."""
    return (
        F.when(received.isNull(), None)
        .when(ordered.isNull(), "received, not ordered")
        .when(received > ordered + 1e-9, "over-received")
        .when(billed > received + 1e-9, "billed more than received")
        .when(received < ordered - 1e-9, "part received")
        .otherwise("in full")
    )


def pivot_cells(cells: DataFrame, keys: list[str], label: str, value: str, labels: list[str]) -> DataFrame:
    """Cells to rows: the last value of each label."""
    return cells.groupBy(*keys).pivot(label, labels).agg(F.max_by(value, F.col("pos") if "pos" in cells.columns else F.lit(0)))


def require(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows; one that breaks the condition fails the query with the message."""
    return rows.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message))))


def diagnostics(rows: DataFrame, id_col: str, **rules: Column) -> DataFrame:
    """(id, problem) for each rule that a row breaks; null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return rows.select(id_col, F.explode(broken).alias("problem"))


def covered_once(expected: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, problem): what is missing, repeated, or made up."""
    n = records.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key).distinct().withColumn("_e", F.lit(True)).join(n, key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")
