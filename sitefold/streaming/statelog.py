"""State of a stream as a log: what a micro-batch changes is appended, nothing is rewritten.

``changes/epoch=<n>`` holds the rows of the keys that micro-batch n touched, so what it writes follows
its own keys, not the size of the state.  Every ``every`` epochs the newest row of each key goes to
``base=<n>``, in key order, without the rows that are no longer live.  The state before epoch n is the
base at the last multiple of ``every`` and the changes since, the newest row of each key; both follow
from n alone, and an epoch that runs again overwrites its own folders from the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class StateLog:
    """Rows of ``schema``, one per ``key``, under ``path``."""

    def __init__(self, path: str, schema: str, key: str, every: int = 16):
        self.path, self.schema, self.key, self.every = path, schema, key, every

    def _base(self, epoch: int) -> int:
        return epoch // self.every * self.every

    def _read(self, spark: SparkSession, base: int, epoch: int) -> DataFrame:
        """The base at ``base`` (epoch -1) and the changes from it up to before ``epoch``."""
        schema: StructType = spark.createDataFrame([], self.schema).schema
        out = spark.createDataFrame([], schema).withColumn("epoch", F.lit(-1).cast("long"))
        if base:
            out = spark.read.schema(schema).parquet(f"{self.path}/base={base}").withColumn("epoch", F.lit(-1).cast("long"))
        if epoch > base:
            paths = [f"{self.path}/changes/epoch={n}" for n in range(base, epoch)]
            with_epoch = StructType([*schema.fields]).add("epoch", LongType())
            out = out.unionByName(spark.read.schema(with_epoch).option("basePath", f"{self.path}/changes").parquet(*paths))
        return out

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "epoch")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "epoch").alias("_r"))
        return last.select(self.key, *[F.col("_r")[c].alias(c) for c in rest])

    def before(self, spark: SparkSession, epoch: int, keys: DataFrame | None = None) -> DataFrame:
        """The state before ``epoch``; of the keys in ``keys`` only, if given."""
        rows = self._read(spark, self._base(epoch), epoch)
        return self._newest(rows if keys is None else rows.join(keys.select(self.key).distinct(), self.key, "left_semi"))

    def write(self, rows: DataFrame, epoch: int) -> None:
        """The new rows of the keys that ``epoch`` changed."""
        rows.write.mode("overwrite").parquet(f"{self.path}/changes/epoch={epoch}")

    def compact(self, spark: SparkSession, epoch: int, live: Column | None = None) -> None:
        """At the start of an epoch: writes its base if it is due, and drops what not even a rerun of
        this epoch reads any more."""
        if not epoch or epoch != self._base(epoch):
            return
        rows = self._newest(self._read(spark, epoch - self.every, epoch))
        (rows if live is None else rows.where(live)).repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(
            f"{self.path}/base={epoch}")
        old = epoch - 2 * self.every
        if old >= 0:
            drop_folder(spark, f"{self.path}/base={old}")
            for n in range(old, epoch - self.every):
                drop_folder(spark, f"{self.path}/changes/epoch={n}")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, wherever it is stored; none is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
