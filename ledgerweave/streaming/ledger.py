"""A ledger that outlives runs: read, matched against and appended to by every micro-batch.

Each append writes one directory named after its batch, so a batch that runs
again after a failure replaces its own records and no others.  Order is arrival
order (``seq``); there is no event time and no watermark, because records never
expire.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.batch import LEDGER, canonical, reconcile
from ..operators.tables import Stored, numbered

SCHEMA = "seq long, " + LEDGER


class LedgerStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root, jvm

    def read(self, before: int | None = None) -> DataFrame:
        """All records, or those of batches before one."""
        fs, root, _ = self._fs()
        if not fs.exists(root):
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA + ", epoch long").option("basePath", self.path).parquet(self.path)
        return (rows if before is None else rows.where(F.col("epoch") < before)).drop("epoch")

    def append(self, additions: DataFrame, epoch: int) -> None:
        """First wins by vendor and number, records without a number are left out; stamped and numbered on."""
        known = self.read(before=epoch)
        key = F.concat_ws("|", F.lower(F.trim("vendor")), F.upper("invoice_number"))
        rows = additions.where("coalesce(invoice_number, '') <> ''").withColumn("_key", key)
        order = [c for c in ("batch_id", "index", "filename") if c in rows.columns]
        first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_k = 1").drop("_k")
        fresh = first.join(known.select(key.alias("_key")), "_key", "left_anti")
        last = known.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        names = [f.split()[0] for f in LEDGER.split(", ")]
        with Stored(self.spark) as tables:  # numbered in arrival order
            rows = numbered(fresh, order, tables, "seq", last + 1).withColumn("run_at", F.current_timestamp())
            rows.select("seq", *names).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def reset(self) -> None:
        fs, root, _ = self._fs()
        fs.delete(root, True)

    def tail(self, n: int = 200) -> DataFrame:
        return self.read().orderBy(F.desc("seq")).limit(n)

    def size(self) -> int:
        return self.read().count()


def reconcile_batch(files: DataFrame, store: LedgerStore, epoch: int, report: Callable[[dict[str, DataFrame], int], None] | None = None) -> None:
    """One micro-batch: match against what earlier batches left, report, then remember and let go of its tables."""
    with reconcile(canonical(files), store.read(before=epoch), keep=True) as tables:
        if report:
            report(tables, epoch)
        store.append(tables["ledger_additions"], epoch)


def reconcile_stream(files: DataFrame, store: LedgerStore, checkpoint: str, report: Callable[[dict[str, DataFrame], int], None] | None = None, **trigger):
    """Starts the query over a stream of reader answers (batch_id, index, filename, doc)."""
    return files.writeStream.foreachBatch(lambda rows, epoch: reconcile_batch(rows, store, epoch, report)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
