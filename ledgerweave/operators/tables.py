"""Intermediate tables in the folder that driver and executors share; numbering in two passes, and connected components by rounds of joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a folder of this machine, which is then the only one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = f"file://{tempfile.mkdtemp(prefix='ledgerweave-core-')}"
    return shared_folder.own


#: Whether what tasks have sent each other is deleted as soon as a query ends, and not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """Tables of one run: written, read again, and deleted by ``release`` (or at the end of a ``with`` block)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.many = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex[:12]}", 0

    def write(self, rows: DataFrame) -> DataFrame:
        """The rows from files, which outlive any executor; their plan is cut off."""
        self.many += 1
        path = f"{self.root}/{self.many}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            rows.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(rows.schema).parquet(path)

    def release(self) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.release()


def numbered(rows: DataFrame, order: list, tables: Stored, name: str = "seq", start: int = 1) -> DataFrame:
    """Adds start, start + 1, ... in order, in two passes: rows are dealt by ranges, sorted and placed within their range as
    they are written, and each range's place follows from the sizes of those before it (a number a partition)."""
    placed = tables.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, total = [], start
    for r in sorted(placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()):
        before.append((r["_part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def components(edges: DataFrame, tables: Stored) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Each round joins every node's larger neighbours, then its smaller ones, to its smallest neighbour, so paths shorten
    by a factor; it ends when a round changes nothing.  What is compared is a count and a sum, not the rows.
    """

    def star(rows: DataFrame, both: DataFrame, keep) -> DataFrame:
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        return rows.join(least, "a").where(keep)

    now = tables.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    seen = None
    while True:
        # the larger neighbours of a node hang on its smallest one
        large = star(now, now, F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # each node and its smaller neighbours hang on the smallest of these
        small = star(large, large, F.lit(True))
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        down = tables.write(hung)
        state = tuple(down.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38, 0)"))).first())
        if state == seen:
            return down.select(F.col("a").alias("node"), F.col("b").alias("component")).union(down.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen = state
        now = tables.write(down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
