"""The ledger as keyed state: what a stream of invoices has seen before, without reading the ledger again.

Two stateful operators, each keyed by what it looks up, so a micro-batch touches the state of its own keys alone:

1. by invoice number: the records under it.  An invoice repeats one whose vendor is alike (EXACT); a record is new
   unless vendor and number are known (the first wins), and one without a number is never remembered;
2. by date and cents, and by order: records of one date within a cent (NEAR; an invoice asks at three amounts, so no date
   is a hot key), and what earlier batches billed on an order (sum, count, first ceiling).

Within a micro-batch every look-up comes before any addition, as when the ledger is read at a run's start.  State and
progress are versioned together: a batch that runs again after a failure meets the state that it met before.  Records
never expire, so there is no event time and no watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fuzzy import alike
from ..functions.names import batch_order_key, vendor_name
from ..policy import BatchPolicy

B = BatchPolicy()
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a stream of invoices needs, in cents.
INVOICE = "batch_id string, index int, vendor string, invoice_number string, date string, total_cents long, po_number string, po_total_cents long"
FINDING = "batch_id string, index int, kind string, prior_number string, prior_billed long, prior_count long, prior_ceiling long"
_SEEN = "key string, batch_id string, index int, vendor string, vendor_key string, invoice_number string, date string, total_cents long, po_key string, po_total_cents long, fresh boolean, prior_number string"
_ASKED = "key string, kind string, adds boolean, batch_id string, index int, vendor_key string, invoice_number string, total_cents long, po_total_cents long, prior_number string"


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """A key's rows of one micro-batch, in order of arrival."""
    frame = pd.concat(list(batches), ignore_index=True)
    return frame.astype(object).where(frame.notna(), None).sort_values(order, ignore_index=True).to_dict("records")


class ByNumber(StatefulProcessor):
    def __init__(self, least: float):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "vendor string, vendor_key string, invoice_number string")

    def handleInputRows(self, key, rows, timerValues):
        rows = _rows(rows, ["batch_id", "index"])
        before = list(self.known.get())
        names = {(v or "").strip().lower() for v, _, _ in before}
        new = []
        for r in rows:
            r["prior_number"] = next((n for _, k, n in before if alike(r["vendor_key"], k, self.least)), None)
            name = (r["vendor"] or "").strip().lower()
            r["fresh"] = name not in names
            if r["fresh"]:
                names.add(name)
                new.append((r["vendor"], r["vendor_key"], r["invoice_number"]))
        if new:
            self.known.appendList(new)
        yield pd.DataFrame(rows, columns=[f.split()[0] for f in _SEEN.split(", ")])

    def close(self) -> None:
        pass


class ByPlace(StatefulProcessor):
    """Keys of two kinds: a date with an amount, and an order."""

    def __init__(self, least: float):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.near = handle.getListState("near", "vendor_key string, invoice_number string")
        self.billed = handle.getValueState("billed", "cents long, n long, ceiling long")

    def handleInputRows(self, key, rows, timerValues):
        rows = _rows(rows, ["batch_id", "index", "adds"])
        kind, out = rows[0]["kind"], []
        found = lambda r, **more: dict.fromkeys(("prior_number", "prior_billed", "prior_count", "prior_ceiling")) | {"batch_id": r["batch_id"], "index": r["index"], "kind": kind} | more
        if kind == "EXACT":
            out = [found(r, prior_number=r["prior_number"]) for r in rows]
        elif kind == "NEAR":
            before = list(self.near.get())
            for r in rows:
                other = (n for k, n in before if alike(r["vendor_key"], k, self.least) and (n or "").upper() != (r["invoice_number"] or "").upper())
                hit = next(other, None)
                if hit is not None:
                    out.append(found(r, prior_number=hit))
            new = [(r["vendor_key"], r["invoice_number"]) for r in rows if r["adds"]]
            if new:
                self.near.appendList(new)
        else:
            cents, n, ceiling = self.billed.get() or (0, 0, None)
            if n:
                out = [found(r, prior_billed=cents, prior_count=n, prior_ceiling=ceiling) for r in rows]
            for r in rows:
                if r["adds"]:
                    cents, n = cents + int(r["total_cents"] or 0), n + 1
                    if ceiling is None and r["po_total_cents"] is not None:
                        ceiling = int(r["po_total_cents"])
            self.billed.update((cents, n, ceiling))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in FINDING.split(", ")])

    def close(self) -> None:
        pass


def remembered(invoices: DataFrame, policy: BatchPolicy = B) -> DataFrame:
    """A stream of INVOICE rows -> FINDING rows: kind EXACT or NEAR with the number of the record that it repeats, BILLED with what earlier batches billed on its order."""
    key = F.upper(F.coalesce("invoice_number", F.lit("")))
    rows = invoices.withColumns({"vendor_key": vendor_name(F.col("vendor")), "po_key": batch_order_key(F.coalesce("po_number", F.lit(""))), "key": key})
    columns = [f.split()[0] for f in _SEEN.split(", ")]
    rows = rows.withColumns({"fresh": F.lit(False), "prior_number": F.lit(None).cast("string")}).select(columns)
    seen = rows.where("key <> ''").groupBy("key").transformWithStateInPandas(ByNumber(policy.vendor_ratio), _SEEN, "Append", "None")
    seen = seen.unionByName(rows.where("key = ''"))
    ask = lambda k, kind, adds: F.struct(k.alias("key"), F.lit(kind).alias("kind"), adds.alias("adds"))
    spot = lambda step: F.when(F.col("date").isNotNull() & F.col("total_cents").isNotNull(), F.concat_ws("|", F.lit("day"), "date", (F.col("total_cents") + step).cast("string")))
    steps = range(-policy.near_amount, policy.near_amount + 1)
    asked = [
        ask(F.when(F.col("prior_number").isNotNull(), F.concat_ws("|", F.lit("row"), "batch_id", F.col("index").cast("string"))), "EXACT", F.lit(False)),
        *(ask(spot(k), "NEAR", F.col("fresh") if k == 0 else F.lit(False)) for k in steps),
        ask(F.when(F.col("po_key") != "", F.concat_ws("|", F.lit("order"), "po_key")), "BILLED", F.col("fresh")),
    ]
    asked = seen.select(F.explode(F.filter(F.array(*asked), lambda a: a["key"].isNotNull())).alias("a"), *[c for c in columns if c not in ("key", "fresh")])
    asked = asked.select("a.key", "a.kind", "a.adds", "batch_id", "index", "vendor_key", "invoice_number", "total_cents", "po_total_cents", "prior_number")
    return asked.groupBy("key").transformWithStateInPandas(ByPlace(policy.vendor_ratio), FINDING, "Append", "None")
