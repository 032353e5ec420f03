"""Keyed state against a ledger that is read as a whole; a batch that runs again; what a batch touches."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.batch import LEDGER, cross_run_duplicates, prior_by_order
from ledgerweave.functions.names import batch_order_key
from ledgerweave.streaming import memory

RUNS = [
    [("Acme Corp", "I-1", "2026-01-10", 10000, "PO-1", 50000), ("Acme Corp", "i-1", "2026-01-10", 10000, "PO-1", 50000), ("Bolt", "B-7", "2026-01-10", 777, None, None), ("Bolt", None, "2026-01-11", 5, "PO-2", 10)],
    [("ACME corp.", "i-1", "2026-02-01", 3, None, None), ("Bolts", "X-1", "2026-01-10", 778, "PO 1", 60000), ("Other", "I-1", "2026-01-10", 10000, "PO-2", None), ("Bolt", "N-1", "2026-01-11", 5, "PO-2", 99)],
    [("Acme Corp", "I-9", "2026-01-10", 10001, "po1", None), ("Bolt", None, "2026-01-10", 776, "PO-2", None), (None, "I-1", None, None, None, None), ("Bolt", "N-1", "2026-01-11", 5, "PO-2", 99)],
]


def batch_way(spark, runs):
    """Findings by run from the ledger as a table."""
    out, ledger, known = [], [], set()
    for k, run in enumerate(runs):
        rows = [(f"r{k}", i, *r) for i, r in enumerate(run)]
        inv = spark.createDataFrame(rows, memory.INVOICE)
        led = spark.createDataFrame([(i, v, n, d, c, "USD", p, t, None, None, None, None) for i, (v, n, d, c, p, t) in enumerate(ledger)], "seq long, " + LEDGER)
        numbers = {i: r[1] for i, r in enumerate(ledger)}
        got = {(r["batch_id"], r["index"], r["kind"], numbers[r["prior_seq"]]) for r in cross_run_duplicates(inv, led).collect()}
        key = batch_order_key(F.coalesce("po_number", F.lit("")))
        prior = inv.withColumn("po_key", key).where("po_key <> ''").join(prior_by_order(led), "po_key")
        got |= {(r["batch_id"], r["index"], "BILLED", r["prior_billed"], r["prior_count"], r["prior_ceiling"]) for r in prior.collect()}
        out.append(got)
        for r in run:
            if r[1] and ((r[0] or "").strip().lower(), r[1].upper()) not in known:
                known.add(((r[0] or "").strip().lower(), r[1].upper()))
                ledger.append(r)
    return out


def test_state_equals_the_ledger(spark, tmp_path):
    source, cp, seen = tmp_path / "in", tmp_path / "cp", {}
    source.mkdir()
    conf = {"spark.sql.streaming.stateStore.providerClass": memory.PROVIDER, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)

    def note(rows, epoch):
        seen.setdefault(epoch, []).append({tuple(r) for r in rows.collect()})

    def run():
        stream = spark.readStream.schema(memory.INVOICE).json(str(source))
        memory.remembered(stream).writeStream.foreachBatch(note).option("checkpointLocation", str(cp)).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    try:
        names = [f.split()[0] for f in memory.INVOICE.split(", ")]
        for k, rows in enumerate(RUNS):
            (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, (f"r{k}", i, *r)))) for i, r in enumerate(rows)))
            run()
            if k == 1:  # the batch was not committed: it runs again, and changes nothing
                os.remove(cp / "commits" / "1")
                (cp / "commits" / ".1.crc").unlink(missing_ok=True)
                run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(seen[1]) == 2 and seen[1][0] == seen[1][1]
    for k, want in enumerate(batch_way(spark, RUNS)):
        got = {(b, i, kind, number) if kind != "BILLED" else (b, i, kind, billed, n, ceiling) for b, i, kind, number, billed, n, ceiling in seen[k][0]}
        assert want <= got, (k, want - got)
        # the table names one repeat an invoice, the state one of each kind
        assert {x for x in got if x[2] != "BILLED" and not any(y[:2] == x[:2] for y in want if y[2] != "BILLED")} == set()
        assert {x for x in got if x[2] == "BILLED"} == {x for x in want if x[2] == "BILLED"}


def test_names_alike():
    from ledgerweave.functions.fuzzy import alike

    assert alike("acme", "acme", 1.0) and alike("acme tools", "acme tool", 0.82) and not alike("", "", 0.5) and not alike(None, "a", 0.5)


@pytest.mark.parametrize("schema", [memory._SEEN, memory._ASKED, memory.FINDING])
def test_schemas_are_readable(spark, schema):
    assert spark.createDataFrame([], schema).columns
