"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.operators.findings import decide, finding, listed, stage_summary
from ledgerweave.operators.sinks import json_documents, read_json, rendered, run_summary, write_json
from ledgerweave.sources import readers


def test_master_and_ledger(spark, tmp_path):
    (tmp_path / "po.json").write_text(json.dumps({"vendors": [{"vendor_id": "V1", "name": "A"}], "purchase_orders": [{"po_number": "PO-1", "vendor_id": "V1", "total_amount": "10.50"}]}))
    (tmp_path / "ledger.json").write_text(json.dumps({"entries": [{"invoice_number": "I1", "total": "", "invoice_date": "2026-01-02"}, {"invoice_number": "I2", "total": "3", "amount_applied": "2"}]}))
    vendors, orders = readers.master(spark, str(tmp_path / "po.json"))
    v, o = vendors.first(), orders.first()
    assert (v["aliases"], v["approved"], v["payment_terms"]) == ([], True, "NET30") and (str(o["total_amount"]), o["status"], o["allow_partial"], o["currency"]) == ("10.50", "open", False, "USD")
    rows = readers.ledger(spark, str(tmp_path / "ledger.json")).orderBy("seq").collect()
    assert [(r["total"], str(r["amount_applied"]), r["decision"]) for r in rows][0] == (None, "0.00", "") and str(rows[0]["invoice_date"]) == "2026-01-02"


def test_documents(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines")
    (tmp_path / "a.pdf").write_bytes(b"p1|p2")
    text = readers.text_documents(spark, str(tmp_path / "*.txt"))
    pdf = readers.binary_documents(spark, str(tmp_path), lambda raw: raw.decode().split("|"))
    rows = readers.directory(pdf, text).orderBy("rank").collect()
    assert [(r["raw_text"], r["kind"], r["page_count"]) for r in rows] == [("p1\np2", "pdf", 2), ("two\nlines", "text", 1)]
    assert {r["filename"] for r in readers.inventory(spark, str(tmp_path)).collect()} == {"a.pdf", "b.txt"}


def test_uploads(spark):
    files = [("inv.png", "data:image/png;base64,aGk=", None), ("po.pdf", "aGk=", None)]
    df = spark.createDataFrame([("r1", files, "sample")], "request_id string, files array<struct<filename:string,content_base64:string,content_type:string>>, mode string").withColumn("batch_id", F.lit("b"))
    rows = readers.upload_batch(df).orderBy("index").collect()
    assert [(r["filename"], r["media"], bytes(r["content"])) for r in rows] == [("inv.png", "image/png", b"hi"), ("po.pdf", "application/pdf", b"hi")]
    one = readers.two_files(df).first()
    assert (one["invoice"]["filename"], one["po"]["filename"]) == ("inv.png", "po.pdf")
    sample, upload = readers.route(df)
    assert (sample.count(), upload.count()) == (1, 0)
    with pytest.raises(Exception, match="needs files"):
        readers.upload_batch(df.withColumn("files", F.slice("files", 1, 0))).collect()
    read = readers.external_reader(readers.upload_batch(df), lambda raw, media: json.dumps({"n": len(raw)}), "struct<n:int>").collect()
    assert {r["doc"]["n"] for r in read} == {2}
    answer = spark.createDataFrame([(json.dumps({"content": [{"type": "text"}, {"type": "tool_use", "input": {"a": 1}}]}),), ("{}",)], "a string").select(readers.tool_input(F.col("a"))).collect()
    assert [json.loads(r[0]) for r in answer] == [{"a": 1}, {}]


def test_rates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# comment\nhsn_sac,gst_percent,category,note\n3917,18,a,b\n9405XX,18,a,b\n")
    assert {r["hsn_sac"]: r["rate"] for r in readers.tax_rates(spark, str(tmp_path / "r.csv")).collect()} == {"3917": 0.18, "9405XX": 0.18}
    assert {r["hsn_sac"]: r["rate"] for r in readers.tax_rates(spark, override={"3917": 0.05, "1": 0.1}).where("hsn_sac in ('3917', '1', '5208')").collect()} == {"3917": 0.05, "1": 0.1, "5208": 0.05}


def test_json_and_summary(spark, tmp_path):
    found = listed(finding("A", 0, "fine"), F.when(F.col("bad"), finding("B", 4, "look")))
    rows = spark.createDataFrame([("d1", False), ("d2", True)], "doc_id string, bad boolean").withColumn("findings", found).withColumn("decision", decide(F.col("findings")))
    assert [tuple(r) for r in run_summary(rows).collect()] == [("d1", "AUTO_APPROVE"), ("d2", "NEEDS_REVIEW")]
    assert [r[0] for r in rows.select(stage_summary(F.col("findings"), "rule")).collect()] == ["All rule checks passed (1 run).", "1 rule issue(s); worst = REVIEW (B)."]
    write_json(rows, str(tmp_path / "out"))
    (back,) = read_json(spark, str(tmp_path / "out"), "doc_id string, decision struct<outcome:string>, findings array<struct<code:string>>", ["d2", "d9"]).collect()
    assert back["decision"]["outcome"] == "NEEDS_REVIEW" and back["findings"][1]["code"] == "B"
    empty = spark.range(1).select(decide(F.array().cast(found_type())).alias("d")).first()["d"]
    assert (empty["outcome"], empty["confidence"]) == ("NEEDS_REVIEW", 0.0)


def test_files_follow_the_number_of_documents(spark, tmp_path):
    out = str(tmp_path / "many")
    rows = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("said")).repartition(7)
    write_json(rows, out, a_file=1000)
    index = spark.read.parquet(f"{out}/_index").orderBy("least").collect()
    assert len(index) == 3 and sum(r["documents"] for r in index) == 2500 and all(a["most"] < b["least"] for a, b in zip(index, index[1:]))
    assert sorted(tuple(r) for r in read_json(spark, out, "doc_id long, said string", [7, 2400, 9999]).collect()) == [(7, "text 7"), (2400, "text 2400")]
    assert read_json(spark, out, "doc_id long, said string", [-1]).collect() == []
    write_json(rows.where("doc_id = 3"), out)  # again: replaced as a whole
    assert spark.read.schema("doc_id long").json(out).count() == 1 and json.loads(json_documents(rows.where("doc_id = 3")).first()["value"]) == {"doc_id": 3, "said": "text 3"}


def test_reports_payloads_and_findings(spark, tmp_path):
    none = F.array().cast(found_type())
    one = spark.createDataFrame([(5,)], "doc_id int").withColumns({"validate_findings": listed(finding("MATH_RECONCILES", 0, "fine")), "match_findings": none, "rule_findings": listed(finding("NO_DUPLICATE", 0, "none"))})
    text = rendered(one.withColumn("decision", decide(F.concat("validate_findings", "match_findings", "rule_findings")))).first()["report"]
    assert text.startswith("== 5\nvalidate\n  [MATH_RECONCILES] fine\nmatch\n") and "decision: AUTO_APPROVE" in text
    (tmp_path / "f.json").write_text(json.dumps({"invoices": [{"n": "I1"}, {"n": "I2"}], "pos": []}))
    assert [r["n"] for r in readers.findings(spark, str(tmp_path / "f.json"), "struct<n:string>", "invoices").collect()] == ["I1", "I2"]
    assert readers.findings(spark, str(tmp_path / "f.json"), "struct<n:string>", "pos").count() == 0 == readers.findings(spark, str(tmp_path / "f.json"), "struct<n:string>", "grns").count()
    rows = spark.createDataFrame([(1, '{"a": {"b": 3}}'), (2, "no json")], "k int, j string")
    assert [r["j"]["a"]["b"] if r["j"] and r["j"]["a"] else None for r in readers.json_payload(rows, "j", "a struct<b:int>").orderBy("k").collect()] == [3, None]
    with pytest.raises(Exception, match="expected a JSON object"):
        readers.json_payload(spark.createDataFrame([(3, None)], "k int, j string"), "j", "a struct<b:int>").collect()


def test_main_buyer_and_site(spark):
    from ledgerweave.functions.text import same_site
    from ledgerweave.operators.fourway import main_buyer

    orders = spark.createDataFrame([(f"p{k}", (b,)) for k, b in enumerate(["27aaaaa1111a1z1", "27AAAAA1111A1Z1 ", "29BBBBB2222B1Z2", None])], "po_id string, order struct<buyer_gstin:string>")
    assert [r["buyer_gstin"] for r in main_buyer(orders).collect()] == ["27AAAAA1111A1Z1"]
    sites = spark.createDataFrame([("North Yard", "north yard"), ("North Yard", "South"), (None, "South"), ("", "x")], "a string, b string")
    assert [r[0] for r in sites.select(same_site(F.col("a"), F.col("b"))).collect()][0] is True


def found_type():
    from ledgerweave.operators.findings import NONE

    return NONE
