"""Append-only result folders for idempotent micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType


class BatchLog:
    """A table written one micro-batch at a time.

    Each batch owns the folder ``batch_id=<n>`` and overwrites it, so a replay
    after a failure leaves one copy. A batch reads only earlier batches, so a
    replay sees exactly what the first attempt saw.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark = spark
        self.path = path
        self.schema = schema

    def append(self, df: DataFrame, batch_id: int) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def _folder(self):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return files, folder

    def last(self, before: int | None = None) -> int | None:
        """The number of the newest complete batch, from the folder names."""
        files, folder = self._folder()
        if not files.exists(folder):
            return None
        jvm = self.spark.sparkContext._jvm
        done = [
            int(f.getPath().getName().removeprefix("batch_id=")) for f in files.listStatus(folder)
            if f.getPath().getName().startswith("batch_id=") and files.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
        ]
        return max((n for n in done if before is None or n < before), default=None)

    def read(self, before: int | None = None) -> DataFrame:
        full = StructType([*self.schema.fields, StructField("batch_id", LongType())])
        files, folder = self._folder()
        if not files.exists(folder):
            return self.spark.createDataFrame([], full)
        table = self.spark.read.schema(full).option("basePath", self.path).parquet(self.path)
        return table if before is None else table.filter(F.col("batch_id") < before)
