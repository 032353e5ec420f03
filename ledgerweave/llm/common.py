"""What the operators share: tables in the shared folder, and bounded batches."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (as in tests) a local one, on one machine alone."""
    from_conf = spark.conf.get("spark.checkpoint.dir", None)
    if from_conf:
        return from_conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = f"file://{tempfile.mkdtemp(prefix='ledgerweave-')}"
    return shared_dir.own


class Tables:
    """Intermediate tables of one operator run, written to the shared folder and read again."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ledgerweave-{tag}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.kept: list[DataFrame] = []

    def write(self, df: DataFrame, small: bool = False) -> DataFrame:
        """Cuts the lineage: the rows come from files that outlive any executor.  small: much less comes out of the tasks than goes in, so few files do."""
        df = df.hint("rebalance") if small else df
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._table_path = path
        return out

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """A small table, and the number of its rows, gathered while it is written."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), small=True)
        return out, seen.get["n"]

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows stay on the executors' disks for later steps; those of a lost executor are worked out again."""
        self.kept.append(df.persist(StorageLevel.DISK_ONLY))
        return self.kept[-1]

    def done(self) -> None:
        """Nothing that was kept is read any more."""
        for t in self.kept:
            t.unpersist()
        self.release()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes what no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            if not hasattr(t, "_table_path"):
                t.unpersist()
                continue
            path = jvm.org.apache.hadoop.fs.Path(t._table_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Spark deletes the shuffle files of finished steps when the driver's plans are collected as garbage; this asks for it."""
        gc.collect()
        self.spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that an Arrow batch holds at most, where texts go to Python.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: batches of fewer rows keep little of them in the workers' and the JVM's memory at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
