"""A corpus pipeline of four stages: each is written as Parquet and read again as the next one's input.

1. Language ID: documents without a letter, or without a likely language, go.
2. N-gram Jaccard join (five words, 0.8): of each group of near copies the document with the smallest doc_id stays.
3. Secret scan: secrets in the texts are replaced by a mark, and n_chars follows.
4. Best-fit packing into sequences of 2048 tokens: a row per piece.

Rows that share a doc_id count as one document; one of them stays.  Null text, or text without a letter, goes in the
first stage; a document with a null doc_id is linked with nothing and stays.  Columns beside text and doc_id are carried
through, whatever their names; an empty table stays empty through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import langid, packing, secrets
from ledgerweave.llm.common import Tables, documents, small_batches
from ledgerweave.llm.jaccard import jaccard_components

#: Least score of the best language; noise and foreign text are the network's label ``und``, and go if that is sure enough.
LEAST_SCORE = 0.1
WORDS, SIMILARITY = 5, (80, 100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_known(docs, langid.train(docs, other=True), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = Tables(spark, "groups").write(jaccard_components(docs, WORDS, *SIMILARITY).select("doc_id", "component_id"))
    kept = docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    again = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").union(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: A trained network and a packing plan are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir))
    return tables.write(STAGES[-1][1](spark, docs, sf_dir))
