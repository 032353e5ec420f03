"""The ledger as state of a stream: repeats and cumulative bills across runs, idempotent appends, reset."""

import json

from pyspark.sql import functions as F

from ledgerweave.operators.batch import READER_DOC
from ledgerweave.streaming.ledger import LedgerStore, reconcile_stream

SURE = {"doc_number": 0.95, "vendor": 0.95, "total": 0.95}


def doc(kind, no, total, ref=None):
    return json.dumps({"doc_type": kind, "doc_number": no, "vendor_name": "Acme Corp", "total": total, "po_reference": ref, "date": "2026-01-10", "field_confidence": SURE})


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", LedgerStore(spark, f"file://{tmp_path}/ledger")
    source.mkdir()
    seen = {}

    def run():
        files = spark.readStream.schema("batch_id string, index int, filename string, j string").json(str(source)).withColumn("doc", F.from_json("j", READER_DOC)).drop("j")
        reconcile_stream(files, store, str(tmp_path / "cp"), lambda t, e: seen.__setitem__(e, [r["kind"] for r in t["cross_run_duplicates"].collect()])).awaitTermination()

    def arrive(name, docs):
        (source / name).write_text("\n".join(json.dumps({"batch_id": name, "index": k, "filename": f"{name}-{k}", "j": d}) for k, d in enumerate(docs)))

    arrive("a", [doc("invoice", "I-1", "100", "PO-1"), doc("invoice", "I-1", "100", "PO-1"), doc("purchase order", "PO-1", "100"), doc("invoice", None, "5")])
    run()
    assert store.size() == 1 and seen == {0: []}
    arrive("b", [doc("invoice", "i-1", "100", "PO-1"), doc("invoice", "I-2", "7", "PO-1")])
    run()
    assert seen[1] == ["EXACT"] and [(r["seq"], r["invoice_number"]) for r in store.tail().collect()] == [(1, "I-2"), (0, "I-1")]
    store.append(store.read().drop("seq").where("invoice_number = 'I-2'"), 1)  # the same batch again
    assert store.size() == 2
    store.reset()
    assert store.size() == 0
