"""Batches of mixed documents: invoices and orders of one upload, many to many, with memory of earlier runs.

Amounts are whole cents.  Everything is keyed by batch_id and the document's
index (upload order).  Candidate edges of all rungs come from equi-joins; only
the claim of orders in upload order runs as a fold, over edges alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let, worked_out
from ..functions.dates import parse_date_text
from ..functions.fuzzy import ratio_plain
from ..functions.money import cents_band, cents_text, cents_tie, number_or_zero, percent_text, round_to, to_cents
from ..functions.names import batch_order_key, clean_order, tax_id, vendor_name
from ..functions.text import code_valid, long_words, token_jaccard
from ..policy import HOLD, OK, REJECT, REVIEW, TAX_RATES, BatchPolicy
from .bands import band_join, met_once
from .findings import finding, listed, worst
from .tables import Stored, components
from .twoway import rate_of

B = BatchPolicy()
#: Waiting invoices that are folded in one group, about; a component is never split.
FOLD_ROWS = 20_000
READER_DOC = (
    "struct<doc_type:string,doc_number:string,po_reference:string,po_references:array<string>,vendor_name:string,seller_gstin:string,buyer_gstin:string,"
    "total:string,taxable_total:string,tax_total:string,currency:string,date:string,"
    "line_items:array<struct<description:string,hsn_sac:string,quantity:string,unit_price:string,gst_rate:string,amount:string>>,"
    "field_confidence:struct<doc_number:double,vendor:double,total:double>,text_layer_present:boolean>"
)
LEDGER = "vendor string, invoice_number string, invoice_date string, amount_cents bigint, currency string, po_number string, po_total_cents bigint, seller_gstin string, filename string, batch_id string, run_at timestamp"


def canonical(files: DataFrame, policy: BatchPolicy = B) -> DataFrame:
    """Reader answers (batch_id, index, filename, doc) as documents with keys, cents, clean lines and a readable flag."""
    d = F.col("doc")
    kind = F.lower(F.coalesce(d["doc_type"], F.lit("")))
    doc_type = F.when(kind.rlike(r"purchase|order|\bpo\b"), "po").when(kind.rlike("invoice|bill"), "invoice").otherwise("unknown")
    sure = d["field_confidence"]
    confidence = (number_or_zero(sure["doc_number"]) + number_or_zero(sure["vendor"]) + number_or_zero(sure["total"])) / 3
    cited = F.when(F.size(F.coalesce(d["po_references"], F.array())) > 0, d["po_references"]).when(F.coalesce(d["po_reference"], F.lit("")) != "", F.array(d["po_reference"])).otherwise(F.array().cast("array<string>"))
    refs = F.when(doc_type == "po", F.array(d["doc_number"])).otherwise(cited)

    def line(x):
        return F.struct(
            F.coalesce(x["description"], F.lit("")).alias("description"),
            F.nullif(F.regexp_replace(x["hsn_sac"], "[^0-9A-Za-z]", ""), F.lit("")).alias("hsn_sac"),
            F.regexp_replace(F.nullif(x["quantity"], F.lit("")), "[^0-9.]", "").try_cast("double").alias("quantity"),
            to_cents(x["unit_price"]).alias("unit_price_cents"),
            F.when(F.coalesce(x["gst_rate"], F.lit("")) != "", number_or_zero(F.regexp_replace(x["gst_rate"], "[^0-9.]", ""))).alias("gst_rate"),
            to_cents(x["amount"]).alias("amount_cents"),
        )

    none = F.array().cast("array<struct<description:string,hsn_sac:string,quantity:string,unit_price:string,gst_rate:string,amount:string>>")
    out = files.select(
        "batch_id",
        "index",
        F.coalesce("filename", F.format_string("doc-%d.pdf", "index")).alias("filename"),
        doc_type.alias("doc_type"),
        F.nullif(d["doc_number"], F.lit("")).alias("doc_number"),
        F.array_distinct(F.array_compact(F.transform(refs, clean_order))).alias("po_numbers"),
        F.nullif(d["vendor_name"], F.lit("")).alias("vendor"),
        tax_id(d["seller_gstin"]).alias("seller_gstin"),
        tax_id(d["buyer_gstin"]).alias("buyer_gstin"),
        F.coalesce(F.nullif(d["currency"], F.lit("")), F.lit("USD")).alias("currency"),
        parse_date_text(d["date"]).alias("date"),
        to_cents(d["total"]).alias("total_cents"),
        to_cents(d["taxable_total"]).alias("taxable_cents"),
        to_cents(d["tax_total"]).alias("tax_cents"),
        F.transform(F.coalesce(d["line_items"], none), line).alias("line_items"),
        confidence.alias("_sure"),
        F.coalesce(d["text_layer_present"], F.lit(True)).alias("text_layer_present"),
    )
    some = F.col("total_cents").isNotNull() | F.col("vendor").isNotNull() | F.col("doc_number").isNotNull()
    return out.withColumns(
        {
            "invoice_number": F.when(F.col("doc_type") == "invoice", F.col("doc_number")),
            "po_number": F.get("po_numbers", F.lit(0)),
            "confidence": round_to(F.col("_sure"), 3),
            "readable": (F.col("doc_type") != "unknown") & (F.col("_sure") >= policy.min_confidence) & some,
        }
    ).drop("_sure")


def _vendor_key(rows: DataFrame) -> Column:
    """The vendor's key, which ``reconcile`` works out once a document, as it writes the documents."""
    return F.col("vendor_key") if "vendor_key" in rows.columns else vendor_name(F.col("vendor"))


def _alike(pairs: DataFrame, a: str, b: str, policy: BatchPolicy) -> DataFrame:
    """Pairs whose vendors' keys (columns of either side, not expressions: these would be worked out again for each comparison
    of a sort) are equal or reach the threshold; equal keys go to Python as null, which costs no comparison there."""
    ratio = ratio_plain(F.when(F.col(a) != F.col(b), F.col(a)), F.col(b))
    return pairs.where((F.col(a) == F.col(b)) | (ratio >= policy.vendor_ratio))


def batch_duplicates(invoices: DataFrame, policy: BatchPolicy = B) -> DataFrame:
    """(batch_id, a, b, kind): EXACT for alike vendors and one number, else NEAR for one date and amounts within a cent."""
    known = invoices.where("vendor is not null")
    one = known.select("batch_id", "index", F.upper("invoice_number").alias("number"), "total_cents", "date")
    other = one.select(*(F.col(c).alias(f"{c}_2") for c in one.columns))
    later = (F.col("batch_id") == F.col("batch_id_2")) & (F.col("index") < F.col("index_2"))
    same = F.coalesce(F.col("number") == F.col("number_2"), F.lit(False))
    exact = one.join(other, later & (F.col("number") == F.col("number_2"))).withColumn("kind", F.lit("EXACT"))
    about = F.abs(F.col("total_cents") - F.col("total_cents_2")) <= policy.near_amount
    near = met_once(one, other, [("batch_id", "batch_id_2"), ("date", "date_2")], ("total_cents", "total_cents_2"), later & about & ~same, floor=policy.near_amount).withColumn("kind", F.lit("NEAR"))
    # names are long: they are looked up, once, for what has met without them
    pairs = exact.unionByName(near.drop("_slot")).select("batch_id", F.col("index").alias("a"), F.col("index_2").alias("b"), "kind")
    names = known.select("batch_id", "index", _vendor_key(known).alias("key"))
    sides = pairs.withColumn("index", F.explode(F.array("a", "b"))).join(names, ["batch_id", "index"])
    side = lambda c: F.max(F.when(F.col("index") == F.col(c), F.col("key")))
    both = sides.groupBy("batch_id", "a", "b", "kind").agg(side("a").alias("vendor"), side("b").alias("vendor_2"))
    return _alike(both, "vendor", "vendor_2", policy).select("batch_id", "a", "b", "kind")


def candidate_edges(invoices: DataFrame, orders: DataFrame, policy: BatchPolicy = B, tables: Stored | None = None) -> DataFrame:
    """(batch_id, inv, po, rung, ref): rung 1 cited orders (the first upload of a key), 2 tax id and total, 3 name and total, 4 tax id.
    With tables, what several rungs read is written once."""
    once = tables.write if tables else lambda rows: rows
    po = orders.select("batch_id", F.col("index").alias("po"), batch_order_key(F.coalesce("po_number", F.lit(""))).alias("_key"), F.col("seller_gstin").alias("_g"), _vendor_key(orders).alias("_n"), F.col("total_cents").alias("_t"))
    inv = invoices.select("batch_id", F.col("index").alias("inv"), "po_numbers", F.col("seller_gstin").alias("g"), _vendor_key(invoices).alias("n"), F.col("total_cents").alias("t"))
    first = po.where("_key <> ''").groupBy("batch_id", "_key").agg(F.min("po").alias("po"))
    cited = inv.select("batch_id", "inv", F.posexplode("po_numbers").alias("ref", "number")).withColumn("_key", batch_order_key(F.col("number")))
    r1 = once(cited.join(first, ["batch_id", "_key"]).groupBy("batch_id", "inv", "po").agg(F.min("ref").alias("ref")))
    # an invoice that cites an order takes it whatever the other rungs would say
    rest = once(inv.drop("po_numbers").join(r1.select("batch_id", "inv").distinct(), ["batch_id", "inv"], "left_anti"))
    po = po.withColumnRenamed("batch_id", "_b")
    tie = cents_tie(F.col("t"), F.col("_t"), policy.tie_pct, policy.tie_floor)
    edge = lambda rows, rung: rows.select("batch_id", "inv", "po", rung.alias("rung"), F.lit(0).alias("ref"))
    # rung 4 has all pairs of a tax id, and those of rung 2 are among them
    here = rest.join(po, (F.col("batch_id") == F.col("_b")) & (F.col("g") == F.col("_g")))
    named = band_join(rest.where("n <> ''"), po, [("batch_id", "_b"), ("n", "_n")], ("t", "_t"), policy.tie_pct, policy.tie_floor).where(tie)
    return r1.select("batch_id", "inv", "po", F.lit(1).alias("rung"), "ref").union(edge(here, F.explode(F.when(tie, F.array(F.lit(2), F.lit(4))).otherwise(F.array(F.lit(4)))))).union(edge(named, F.lit(3)))


BASIS = {2: "fingerprint (GSTIN + total)", 3: "fingerprint (name + total)", 4: "possible (GSTIN only, total off)"}


def claim(edges: DataFrame, tables: Stored) -> DataFrame:
    """(batch_id, inv, po, rung, ref) of the matches.  Invoices claim in upload order: rung 1 takes all its orders whether
    claimed or not; the other rungs see unclaimed orders only and need exactly one.

    What rung 1 takes depends on nothing else, so it is settled at once, and an order that it takes is struck out for later
    invoices.  Of the rest, only invoices that share an order have to wait for each other: a component of theirs is one
    group of the fold, and an invoice that shares none is settled by counting.
    """
    edges = tables.write(edges)
    cited = edges.where("rung = 1")
    taken = cited.groupBy("batch_id", "po").agg(F.min("inv").alias("first"))
    cites = cited.select("batch_id", "inv").distinct()
    rest = edges.where("rung > 1").join(cites, ["batch_id", "inv"], "left_anti").join(taken, ["batch_id", "po"], "left")
    rest = tables.write(rest.where("first IS NULL OR first > inv").drop("first").select(edges.columns))
    shared = rest.groupBy("batch_id", "po").agg(F.countDistinct("inv").alias("n")).where("n > 1").select("batch_id", "po")
    waits = rest.join(shared, ["batch_id", "po"], "left_semi").select("batch_id", "inv").distinct()
    alone = rest.join(waits, ["batch_id", "inv"], "left_anti")
    by = alone.groupBy("batch_id", "inv", "rung").agg(F.count("*").alias("n")).where("n = 1")
    first = by.groupBy("batch_id", "inv").agg(F.min("rung").alias("rung"))
    settled = cited.unionByName(alone.join(first, ["batch_id", "inv", "rung"]).select(edges.columns))
    if waits.isEmpty():
        return settled
    # invoices that share an order are linked through the first of them
    own = rest.join(shared, ["batch_id", "po"], "left_semi").select("batch_id", "inv", "po").distinct()
    links = own.join(own.groupBy("batch_id", "po").agg(F.min("inv").alias("least")), ["batch_id", "po"]).where("inv <> least")
    group = components(links.select(F.struct("batch_id", "inv").alias("a"), F.struct("batch_id", F.col("least").alias("inv")).alias("b")), tables)
    group = group.select("node.batch_id", "node.inv", F.col("component.inv").alias("part"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """The components that were dealt to one group, in upload order; no two of them have an order in common."""
        taken: set = set()
        kept: list[int] = []
        pdf = pdf.sort_values(["batch_id", "inv", "rung", "ref", "po"], ignore_index=True)
        rows = zip(range(len(pdf)), pdf["batch_id"].tolist(), pdf["inv"].tolist(), pdf["rung"].tolist(), pdf["po"].tolist())
        for (batch, _), own in groupby(rows, key=lambda r: r[1:3]):
            for _, some in groupby(own, key=lambda r: r[3]):
                free = [r for r in some if (batch, r[4]) not in taken]
                if len(free) == 1:
                    taken.add((batch, free[0][4]))
                    kept.append(free[0][0])
                    break
        return pdf.iloc[kept]

    waiting = rest.join(group, ["batch_id", "inv"])
    parts = max(4 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), waits.count() // FOLD_ROWS)
    waiting = waiting.withColumn("deal", F.pmod(F.xxhash64("batch_id", "part"), F.lit(parts)))
    folded = waiting.groupBy("deal").applyInPandas(fold, waiting.schema).select(edges.columns)
    return settled.unionByName(folded)


def pair_findings(inv: Column, po: Column, po_cents: Column, label: Column, similar: Column, policy: BatchPolicy = B) -> Column:
    off, auto, band = F.abs(inv["total_cents"] - po_cents), cents_band(po_cents, policy.auto_pct, policy.auto_abs), cents_band(po_cents, policy.band_pct, policy.band_abs)
    said = F.concat(F.lit("Invoice "), cents_text(inv["total_cents"]), F.lit(" and "), label, F.lit(" "), cents_text(po_cents), F.lit(" ("), percent_text(off, po_cents), F.lit("% apart)"))
    ids = inv["seller_gstin"].isNotNull() & po["seller_gstin"].isNotNull()
    return listed(
        F.when(off.isNull(), finding("AMOUNT_UNVERIFIABLE", REVIEW, "An amount is missing.")).when(off <= auto, finding("AMOUNT_MATCH", OK, said)).when(off <= band, finding("AMOUNT_VARIANCE", HOLD, said)).otherwise(finding("AMOUNT_MISMATCH", REJECT, said)),
        F.when(ids & (inv["seller_gstin"] == po["seller_gstin"]), finding("VENDOR_GSTIN_MATCH", OK, "The tax ids agree."))
        .when(ids, finding("VENDOR_GSTIN_MISMATCH", REVIEW, "The tax ids differ."))
        .when(similar < policy.vendor_ratio, finding("VENDOR_MISMATCH", REVIEW, F.concat(F.lit("Vendors differ: "), inv["vendor"], F.lit(" / "), po["vendor"])))
        .when(similar >= policy.vendor_ratio, finding("VENDOR_OK", OK, "The vendors' names agree.")),
        F.when(inv["currency"] != po["currency"], finding("CURRENCY_MISMATCH", REJECT, F.concat(inv["currency"], F.lit(" against "), po["currency"]))),
    )


def pair_status(findings: Column) -> Column:
    top = F.coalesce(worst(findings), F.lit(0))
    return F.when(top >= REJECT, "MISMATCH").when(top >= REVIEW, "REVIEW").when(top >= HOLD, "VARIANCE").otherwise("MATCHED")


STATUS_CONFIDENCE = {"MATCHED": 0.98, "MISMATCH": 0.9, "REVIEW": 0.6, "VARIANCE": 0.8}


def gst_check(doc: Column, rates: dict[str, float] | None = None, policy: BatchPolicy = B) -> Column:
    """struct<applicable, hsn_flags, rate_flags, tax_reconciles>: flags only."""
    lines = doc["line_items"]
    any_code = F.exists(lines, lambda x: x["hsn_sac"].isNotNull())
    taxes = doc["taxable_cents"].isNotNull() & doc["tax_cents"].isNotNull()
    correct = lambda x: rate_of(x["hsn_sac"], rates or TAX_RATES, True) * 100
    named = lambda x: F.coalesce(F.nullif(x["description"], F.lit("")), F.lit("line"))
    bad_code = F.transform(F.filter(lines, lambda x: ~code_valid(x["hsn_sac"])), lambda x: F.concat(x["hsn_sac"], F.lit(" is malformed: "), named(x)))
    bad_rate = F.transform(F.filter(lines, lambda x: F.abs(x["gst_rate"] - correct(x)) > 0.01), lambda x: F.concat(x["gst_rate"].cast("string"), F.lit("% on "), x["hsn_sac"], F.lit(": "), named(x)))
    return F.struct(
        (any_code | taxes).alias("applicable"),
        bad_code.alias("hsn_flags"),
        bad_rate.alias("rate_flags"),
        F.when(taxes & doc["total_cents"].isNotNull(), cents_tie(doc["taxable_cents"] + doc["tax_cents"], doc["total_cents"], policy.tie_pct, policy.tie_floor)).alias("tax_reconciles"),
    )


def is_itemized(lines: Column) -> Column:
    one = F.get(lines, F.lit(0))
    return (F.size(lines) > 1) | F.coalesce((F.size(lines) == 1) & (one["quantity"] > 1) & one["unit_price_cents"].isNotNull(), F.lit(False))


def line_check(bill: Column, order: Column, policy: BatchPolicy = B) -> Column:
    """struct<applicable, po_itemized, summary, flags, pairs>: each invoice line takes the best free order line."""
    places = F.sequence(F.lit(0), F.greatest(F.size(order), F.lit(1)) - 1)

    def score(a, b):
        words = lambda x: F.array_join(long_words(x["description"]), " ")
        return F.when(a["hsn_sac"] == b["hsn_sac"], 1.0).when((words(a) != "") & (words(a) == words(b)), 0.95).otherwise(token_jaccard(long_words(a["description"]), long_words(b["description"])))

    def best(taken, a):
        scored = F.transform(F.filter(places, lambda j: (j < F.size(order)) & ~F.array_contains(taken, j)), lambda j: F.struct(score(a, F.get(order, j)).alias("s"), (-j).alias("j")))
        return let(F.array_max(scored), lambda m: F.when(m["s"] >= policy.min_line_score, -m["j"]))

    def step(acc, a):
        return let(best(acc["taken"], a), lambda j: F.struct(F.concat(acc["out"], F.array(j)).alias("out"), F.when(j.isNull(), acc["taken"]).otherwise(F.concat(acc["taken"], F.array(j))).alias("taken")))

    empty = F.array().cast("array<int>")
    found = F.aggregate(bill, F.struct(empty.alias("out"), empty.alias("taken")), step)["out"]

    def pair(a, j):
        b = F.get(order, j)
        ok = F.when(j.isNotNull(), F.abs(a["unit_price_cents"] - b["unit_price_cents"]) <= policy.rate_tolerance)
        return F.struct(a["description"].alias("invoice_line"), F.when(j.isNotNull(), b["description"]).alias("po_line"), a["unit_price_cents"].alias("invoice_rate"), F.when(j.isNotNull(), b["unit_price_cents"]).alias("po_rate"), a["quantity"].alias("quantity"), ok.alias("rate_ok"))

    def report(pairs):
        m, n = F.size(F.filter(pairs, lambda p: p["po_line"].isNotNull())), F.size(pairs)
        flags = F.array_compact(F.transform(pairs, lambda p: F.when(p["po_line"].isNull(), F.concat(F.lit("not found on the order: "), p["invoice_line"])).when(~p["rate_ok"], F.concat(F.lit("rate differs: "), p["invoice_line"]))))
        summary = F.when(m == n, F.format_string("All %d lines matched", m)).otherwise(F.format_string("%d of %d lines matched", m, n))
        return F.struct(F.lit(True).alias("applicable"), F.lit(True).alias("po_itemized"), summary.alias("summary"), flags.alias("flags"), pairs.alias("pairs"))

    kind = "array<struct<invoice_line:string,po_line:string,invoice_rate:bigint,po_rate:bigint,quantity:double,rate_ok:boolean>>"
    off = lambda itemized, text: F.struct(F.lit(False).alias("applicable"), F.lit(itemized).alias("po_itemized"), text.alias("summary"), F.array().cast("array<string>").alias("flags"), F.array().cast(kind).alias("pairs"))
    return F.when(~is_itemized(order), off(False, F.when(F.size(order) > 0, "N/A — PO lump-sum").otherwise("PO has no line detail"))).when(F.size(bill) == 0, off(True, F.lit("no invoice line detail"))).otherwise(let(F.zip_with(bill, found, pair).cast(kind), report))


def prior_by_order(ledger: DataFrame) -> DataFrame:
    """What earlier runs billed by order key: sum, count and the first remembered ceiling."""
    keyed = ledger.withColumn("po_key", batch_order_key(F.coalesce("po_number", F.lit("")))).where("po_key <> ''")
    first = F.min_by("po_total_cents", F.when(F.col("po_total_cents").isNotNull(), F.col("seq")))
    return keyed.groupBy("po_key").agg(F.sum(F.coalesce("amount_cents", F.lit(0))).alias("prior_billed"), F.count("*").alias("prior_count"), first.alias("prior_ceiling"))


def cross_run_duplicates(invoices: DataFrame, ledger: DataFrame, policy: BatchPolicy = B) -> DataFrame:
    """(batch_id, index, kind, prior_seq): the first ledger record that an invoice repeats."""
    led = ledger.where("vendor is not null").select(F.col("seq").alias("prior_seq"), _vendor_key(ledger).alias("vendor_2"), F.upper("invoice_number").alias("_n"), F.col("amount_cents").alias("_c"), F.col("invoice_date").alias("_d"))
    inv = invoices.where("vendor is not null").select("batch_id", "index", _vendor_key(invoices).alias("vendor"), F.upper("invoice_number").alias("n"), "total_cents", "date")
    same = F.coalesce(F.col("n") == F.col("_n"), F.lit(False))
    # of a number's records under one vendor key only the first can be the answer, so an invoice does not meet the others
    numbered = led.where("_n is not null").groupBy("_n", "vendor_2").agg(F.min("prior_seq").alias("prior_seq"))
    exact = inv.join(numbered, F.col("n") == F.col("_n")).withColumn("kind", F.lit("EXACT"))
    near = band_join(inv, led, [("date", "_d")], ("total_cents", "_c"), floor=policy.near_amount).where(~same & (F.abs(F.col("total_cents") - F.col("_c")) <= policy.near_amount)).withColumn("kind", F.lit("NEAR"))
    pair = ("batch_id", "index", "vendor", "vendor_2", "prior_seq", "kind")
    hits = _alike(exact.select(*pair).unionByName(near.select(*pair)), "vendor", "vendor_2", policy)
    return hits.groupBy("batch_id", "index").agg(F.min(F.struct("prior_seq", "kind")).alias("h")).select("batch_id", "index", "h.kind", "h.prior_seq")


class Report(Mapping):
    """The tables of a reconciliation by name, each made when it is first asked for (with what it rests on, and nothing else);
    ``release`` (or the end of a ``with`` block) lets go of what they rest on."""

    def __init__(self, tables: Stored):
        self.stored, self.kept, self.makers = tables, [], {}

    def table(self, make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        self.makers[make.__name__] = cache(make)
        return self.makers[make.__name__]

    def __getitem__(self, name: str) -> DataFrame:
        return self.makers[name]()

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)

    def keep(self, rows: DataFrame) -> DataFrame:
        self.kept.append(rows.persist())
        return rows

    def release(self) -> None:
        for rows in self.kept:
            rows.unpersist()
        self.kept = []
        self.stored.release()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.release()


#: ``reconcile`` has a table of this name.
repeats = cross_run_duplicates


def reconcile(docs: DataFrame, ledger: DataFrame | None = None, policy: BatchPolicy = B, keep: bool = False) -> Report:
    """The report of all batches as tables: matched, po_missing, invoice_missing, unreadable, duplicates, cross_run_duplicates,
    cumulative_flags, ledger_additions and summary.  Without a ledger, or with an empty one, the memory tables are empty and nothing else changes.
    keep: what several tables share is persisted (to memory and disk; a lost part is worked out again) until the report is
    released; for readers of several tables.  The documents and the matches are written to the shared folder when a table that
    needs them is first asked for; a table made of the documents alone does not write them.
    """
    spark = docs.sparkSession
    report = Report(Stored(spark))
    kept = report.keep if keep else lambda rows: rows
    # a ledger that is known to be empty leaves nothing to join
    ledger = ledger if ledger is not None else spark.createDataFrame([], "seq long, " + LEDGER).limit(0)

    @cache
    def clean() -> DataFrame:
        """Most steps read the documents, and making them clean is dear.  A key that is the name in small letters is not written beside it."""
        key, small = vendor_name(F.col("vendor")), F.lower("vendor")
        written = report.stored.write(worked_out(docs, _key=key).withColumn("_key", F.when(~F.col("_key").eqNullSafe(small), F.coalesce("_key", F.lit("")))))
        return written.withColumn("vendor_key", F.coalesce("_key", small)).drop("_key")

    invoices = cache(lambda: clean().where("readable and doc_type = 'invoice'"))
    orders = cache(lambda: clean().where("readable and doc_type = 'po'"))
    matches = cache(lambda: report.stored.write(claim(candidate_edges(invoices(), orders(), policy, report.stored), report.stored)))
    # distinct comes last: so the join with it is left out of plans that do not ask for it
    flagged = cache(lambda: kept(duplicates().select("batch_id", F.explode(F.array("a", "b")).alias("index")).distinct()).withColumn("duplicate", F.lit(True)))

    @cache
    def asks() -> bool:
        """Whether names decide anything, that is where a side has no tax id: they are long, and stay behind where all have one."""
        return not clean().where("readable and seller_gstin is null").isEmpty()

    @cache
    def paired() -> DataFrame:
        """A row per matched invoice (inv_doc) with its orders (pos, the first as po_doc): the fields that verdicts look at."""
        both = [*(c if asks() else F.lit(None).cast("string").alias(c) for c in ("vendor", "vendor_key")), "seller_gstin", "currency", "total_cents", "line_items"]
        doc = lambda name, cols: F.struct(*cols, *both).alias(name)
        pairs = matches().join(orders().select("batch_id", F.col("index").alias("po"), doc("po_doc", ["po_number"])), ["batch_id", "po"])
        grouped = pairs.groupBy("batch_id", "inv").agg(F.min("rung").alias("rung"), F.array_sort(F.collect_list(F.struct("ref", "po", "po_doc"))).alias("all"))
        grouped = grouped.select("batch_id", "inv", "rung", F.transform("all", lambda x: x["po_doc"]).alias("pos"))
        bills = invoices().select("batch_id", F.col("index").alias("inv"), doc("inv_doc", ["invoice_number", "taxable_cents", "tax_cents"]))
        return kept(grouped.join(bills, ["batch_id", "inv"]).withColumns({"n_pos": F.size("pos"), "po_doc": F.get("pos", F.lit(0))}))

    @cache
    def verdicts() -> DataFrame:
        """Paired invoices with findings and split billing."""
        total = F.aggregate("pos", F.lit(0).cast("bigint"), lambda a, p: a + F.coalesce(p["total_cents"], F.lit(0)))
        spans = F.col("n_pos") > 1
        basis = F.when(F.col("rung") == 1, F.when(spans, F.format_string("PR/PO number (×%d)", "n_pos")).otherwise("PR/PO number")).otherwise(F.try_element_at(F.create_map(*(F.lit(x) for kv in BASIS.items() for x in kv)), F.col("rung")))
        # names are compared where no tax ids decide and the keys differ; the rest goes to Python as null
        key, other = F.col("inv_doc.vendor_key"), F.col("po_doc.vendor_key")
        asked = (key != other) & (F.col("inv_doc.seller_gstin").isNull() | F.col("po_doc.seller_gstin").isNull())
        rows = paired().withColumns(
            {
                "po_cents": F.when(spans, total).otherwise(F.col("po_doc.total_cents")),
                "label": F.when(spans, F.format_string("%d POs", "n_pos")).otherwise("PO"),
                "relationship": F.when(spans, "invoice-spans-POs").otherwise("one-to-one"),
                "basis": basis,
                "similar": F.when(key == other, 1.0).otherwise(ratio_plain(F.when(asked, key), F.when(asked, other))),
                "line_check": line_check(F.col("inv_doc.line_items"), F.flatten(F.transform("pos", lambda p: p["line_items"])), policy),
                "gst_check": gst_check(F.col("inv_doc"), policy=policy),
            }
        )
        rows = rows.withColumn("findings", pair_findings(F.col("inv_doc"), F.col("po_doc"), F.col("po_cents"), F.col("label"), F.col("similar"), policy))
        rows = rows.withColumn("pre_split_status", pair_status(F.col("findings"))).drop("similar")
        # what is left to say is of numbers and amounts
        slim = lambda d: F.struct(*(d[c].alias(c) for c in ("po_number", "total_cents")))
        rows = rows.withColumns({"inv_doc": F.struct("inv_doc.invoice_number", "inv_doc.total_cents"), "pos": F.transform("pos", slim), "po_doc": slim(F.col("po_doc"))})
        # split billing: one order, several one-to-one invoices with at least two numbers; an invoice of no such order is a group of its own
        first_order = orders().where("po_number is not null").groupBy("batch_id", F.col("po_number").alias("_group")).agg(F.min_by("total_cents", "index").alias("ceiling"))
        rows = rows.withColumn("po_number", F.when(F.col("relationship") == "one-to-one", F.col("po_doc.po_number")))
        rows = rows.withColumn("_group", F.coalesce("po_number", F.concat(F.lit("\n"), F.col("inv").cast("string")))).join(first_order, ["batch_id", "_group"], "left")
        group, number = Window.partitionBy("batch_id", "_group"), F.upper("inv_doc.invoice_number")
        rows = rows.withColumns({"n_split": F.count("*").over(group), "cumulative": F.sum(F.coalesce("inv_doc.total_cents", F.lit(0))).over(group), "_low": F.min(number).over(group), "_high": F.max(number).over(group)})
        parted = F.coalesce(F.col("po_number").isNotNull() & (F.col("n_split") >= 2) & (F.col("_low") < F.col("_high")), F.lit(False))
        rows = rows.withColumn("parted", parted).withColumns({c: F.when(F.col("parted"), F.col(c)) for c in ("n_split", "cumulative", "ceiling")}).withColumn("over", F.col("cumulative") - F.col("ceiling"))
        beyond = F.col("over") > cents_band(F.col("ceiling"), policy.band_pct, policy.band_abs)
        parted = F.col("parted")
        top = worst(F.col("findings"))
        reasons = F.transform(F.filter("findings", lambda f: F.when(top >= HOLD, f["severity"] == top).otherwise(f["severity"] == OK)), lambda f: F.concat(F.lit("["), f["code"], F.lit("] "), f["message"]))
        split_said = F.concat(F.when(beyond, "[CUMULATIVE_OVERBILL] ").otherwise("[PARTIAL_BILLING] "), F.col("n_split").cast("string"), F.lit(" invoices come to "), cents_text(F.col("cumulative")), F.lit(" of "), cents_text(F.col("ceiling")))
        rows = rows.withColumns(
            {
                "status": F.when(parted & F.coalesce(beyond, F.lit(False)), "MISMATCH").when(parted, "PARTIAL").otherwise(F.col("pre_split_status")),
                "reasons": F.when(parted, F.array(split_said)).otherwise(reasons),
                "relationship": F.when(parted, "split-billing").otherwise(F.col("relationship")),
                "pair_confidence": F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS_CONFIDENCE.items() for x in kv)), F.col("pre_split_status")),
            }
        )
        return kept(rows)

    @report.table
    def matched() -> DataFrame:
        rows = verdicts().withColumn("po_key", F.when(F.col("relationship") != "invoice-spans-POs", batch_order_key(F.col("po_doc.po_number"))))
        rows = rows.join(cumulative_flags().select("batch_id", "po_key", F.col("over").alias("cumulative_over")), ["batch_id", "po_key"], "left")
        dup = flagged().withColumnRenamed("index", "inv")
        cross = memory().select("batch_id", F.col("index").alias("inv"), F.col("kind").alias("cross_run"))
        return kept(rows.join(dup, ["batch_id", "inv"], "left").join(cross, ["batch_id", "inv"], "left").select(
            "batch_id", "inv", F.col("inv_doc.invoice_number").alias("invoice_number"), F.col("po_doc.po_number").alias("po_number"), F.transform("pos", lambda p: p["po_number"]).alias("po_numbers"), "relationship", "basis", "status", "pre_split_status",
            F.col("pair_confidence").alias("confidence"), "reasons", F.col("inv_doc.total_cents").alias("invoice_cents"), "po_cents", F.abs(F.col("inv_doc.total_cents") - F.col("po_cents")).alias("delta_cents"), F.col("n_split").alias("split_invoices"), F.col("cumulative").alias("split_cumulative"),
            F.when(F.col("over") > 0, F.col("over")).alias("split_over"), F.coalesce("duplicate", F.lit(False)).alias("duplicate"), "cross_run", "cumulative_over", "line_check", "gst_check", F.col("po_doc.total_cents").alias("po_total_cents"),
        ))

    @report.table
    def po_missing() -> DataFrame:
        found = matches().select("batch_id", F.col("inv").alias("index")).distinct()
        lone = invoices().join(found, ["batch_id", "index"], "left_anti").join(flagged(), ["batch_id", "index"], "left").join(memory().select("batch_id", "index", F.col("kind").alias("cross_run")), ["batch_id", "index"], "left")
        return lone.select("batch_id", "index", "invoice_number", F.col("po_number").alias("cited_po"), F.when(F.col("po_number").isNotNull(), F.concat(F.lit("cites an order that is not here: "), F.col("po_number"))).otherwise("cites no order, and nothing else is unique").alias("reason"), F.coalesce("duplicate", F.lit(False)).alias("duplicate"), "cross_run", gst_check(F.struct("line_items", "taxable_cents", "tax_cents", "total_cents"), policy=policy).alias("gst_check"))

    @report.table
    def invoice_missing() -> DataFrame:
        return orders().join(matches().select("batch_id", F.col("po").alias("index")).distinct(), ["batch_id", "index"], "left_anti").select("batch_id", "index", "po_number", "vendor", "total_cents")

    @report.table
    def unreadable() -> DataFrame:
        return (clean() if keep else docs).where("not readable").select("batch_id", "index", "filename", F.when(F.col("doc_type") == "unknown", "could not classify or read the document").otherwise(F.concat(F.lit("low extraction confidence ("), F.floor(F.col("confidence") * 100 + 0.5).cast("string"), F.lit("%)"))).alias("reason"))

    @report.table
    def duplicates() -> DataFrame:
        return kept(batch_duplicates(invoices(), policy))

    @report.table
    def cross_run_duplicates() -> DataFrame:
        return kept(repeats(invoices(), ledger, policy))

    memory = cross_run_duplicates

    @report.table
    def cumulative_flags() -> DataFrame:
        """Billing of this batch by order beside what earlier runs billed; spanning invoices carry their own verdict."""
        mine = paired().where("n_pos = 1 and po_doc.po_number is not null").withColumn("po_key", batch_order_key(F.col("po_doc.po_number")))
        now = mine.groupBy("batch_id", "po_key").agg(F.min_by(F.col("po_doc.po_number"), "inv").alias("po_number"), F.sum(F.coalesce("inv_doc.total_cents", F.lit(0))).alias("this_batch"), F.max_by(F.col("po_doc.total_cents"), F.when(F.col("po_doc.total_cents").isNotNull(), F.col("inv"))).alias("own_ceiling"))
        cumulative = now.join(prior_by_order(ledger).where("prior_billed <> 0"), "po_key").withColumn("ceiling", F.coalesce("own_ceiling", "prior_ceiling")).withColumn("cumulative", F.col("prior_billed") + F.col("this_batch")).withColumn("over", F.col("cumulative") - F.col("ceiling"))
        return kept(cumulative.where(F.col("over") > cents_band(F.col("ceiling"), policy.band_pct, policy.band_abs)).select("batch_id", "po_key", "po_number", "prior_billed", "prior_count", "this_batch", "cumulative", "ceiling", "over"))

    @report.table
    def ledger_additions() -> DataFrame:
        known = paired().select("batch_id", F.col("inv").alias("index"), F.col("po_doc.po_number").alias("_po"), F.col("po_doc.total_cents").alias("po_total_cents"))
        return invoices().join(known, ["batch_id", "index"], "left").select("vendor", "invoice_number", F.col("date").alias("invoice_date"), F.col("total_cents").alias("amount_cents"), "currency", F.coalesce("_po", "po_number").alias("po_number"), "po_total_cents", "seller_gstin", "filename", "batch_id", "index")

    @report.table
    def summary() -> DataFrame:
        flags = lambda g: F.size(g["hsn_flags"]) + F.size(g["rate_flags"]) + F.when(~g["tax_reconciles"], 1).otherwise(0)
        part = lambda rows, **aggs: rows.groupBy("batch_id").agg(*(v.alias(k) for k, v in aggs.items()))
        one = F.count("*")
        parts = [
            part(clean(), documents=one, unreadable=F.count_if(~F.col("readable")), invoices=F.count_if(F.col("readable") & (F.col("doc_type") == "invoice")), pos=F.count_if(F.col("readable") & (F.col("doc_type") == "po"))),
            part(matched(), matched=one, line_flags=F.sum(F.size("line_check.flags")), gst_m=F.sum(flags(F.col("gst_check"))), partials=F.count_if(F.col("status") == "PARTIAL"), invoice_spans_pos=F.count_if(F.col("relationship") == "invoice-spans-POs")),
            part(po_missing(), po_missing=one, gst_p=F.sum(flags(F.col("gst_check")))),
            part(invoice_missing(), invoice_missing=one),
            part(duplicates(), duplicates=one),
            part(memory(), cross_run_duplicates=one),
            part(cumulative_flags(), cumulative_flags=one),
        ]
        summary = parts[0]
        for p in parts[1:]:
            summary = summary.join(p, "batch_id", "left")
        counters = [c for c in summary.columns if c not in ("batch_id", "gst_m", "gst_p")]
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
        return summary.select("batch_id", *(zero(c).alias(c) for c in counters), (zero("gst_m") + zero("gst_p")).alias("gst_flags"))

    return report
