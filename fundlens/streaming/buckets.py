"""A keyed table in hash buckets. A merge rewrites the buckets of its keys and leaves the files of all others alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


# A bucket with more files than this is written anew as one.
FILES = 64


class BucketedTable:
    """Parquet under ``path/bucket=<n>``; the bucket is a hash of the keys.

    ``merge`` and ``append`` work in two steps, so a lost driver loses nothing. What the touched buckets get is written
    aside first; only when that is complete its files are moved into place, after those that they replace are deleted.
    A change that was cut off between the two is completed by the next access. The same run may come again, so
    ``combine`` has to give the same rows when its changes are in the table already, and who appends looks first which
    keys the table has. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 256):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        files, place = self._fs(path)
        return files.exists(place)

    def _delete(self, path: str) -> None:
        files, place = self._fs(path)
        files.delete(place, True)

    def numbered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some keys, at most as many as the table has."""
        return sorted(r.bucket for r in self.numbered(rows.select(*self.keys)).select("bucket").distinct().collect())

    def read(self, numbers: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets; the other folders are not read."""
        self._complete()
        full = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema)
        table = self.spark.read.schema(full).option("basePath", self.path).parquet(self.path)
        return (table if numbers is None else table.filter(F.col("bucket").isin(numbers))).drop("bucket")

    def of_keys(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys are among those given, from their buckets alone."""
        wanted = rows.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        table = self.read(self.touched(rows))
        return table.join(wanted, [table[k].eqNullSafe(wanted[f"_{k}"]) for k in self.keys], "left_semi")

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the touched buckets by ``combine(their rows, changes)``; returns their numbers. A bucket of which
        nothing is left is deleted."""
        numbers = self.touched(changes)
        if numbers:
            self._put(combine(self.read(numbers), changes), numbers, True)
        return numbers

    def append(self, rows: DataFrame, numbers: list[int]) -> None:
        """Adds rows, whose keys are in the buckets of these numbers, as one more file of each bucket. What the table
        holds is neither read nor written again."""
        self._complete()
        if numbers:
            self._put(rows, numbers, False)

    def crowded(self, numbers: list[int]) -> list[int]:
        """Those of the buckets that have so many files that a merge should write them anew."""
        self._complete()
        return [n for n in numbers if len(self._inside(f"{self.path}/bucket={n}")) > FILES]

    def _inside(self, path: str) -> list[str]:
        files, place = self._fs(path)
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def _move(self, path: str, to: str) -> None:
        files, place = self._fs(path)
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
        files.mkdirs(target.getParent())
        if not files.rename(place, target):
            raise OSError(f"{path} could not be moved to {to}")

    def _put(self, rows: DataFrame, numbers: list[int], replace: bool) -> None:
        aside = f"{self.path}-next"
        new = self.numbered(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]))
        new.repartition(len(numbers), "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{aside}/rows")
        left = {int(name.removeprefix("bucket=")) for name in self._inside(f"{aside}/rows") if name.startswith("bucket=")}
        plan = [(n, n in left, replace) for n in numbers if replace or n in left]
        # Written last; from then on the change counts.
        self.spark.createDataFrame(plan, "bucket int, left boolean, replace boolean").coalesce(1).write.mode("overwrite").parquet(f"{aside}/numbers")
        self._complete()

    def _complete(self) -> None:
        """Puts what was written aside into place. What was moved already is not there any more, so it can begin anew."""
        aside = f"{self.path}-next"
        if not self._exists(f"{aside}/numbers/_SUCCESS"):
            return
        for r in self.spark.read.schema("bucket int, left boolean, replace boolean").parquet(f"{aside}/numbers").collect():
            source, target = f"{aside}/rows/bucket={r.bucket}", f"{self.path}/bucket={r.bucket}"
            if not r.replace:
                for name in self._inside(source):
                    self._move(f"{source}/{name}", f"{target}/{name}")
            elif not r.left or self._exists(source):
                self._delete(target)
                if r.left:
                    self._move(source, target)
        self._delete(aside)


class KnownKeys:
    """Keys that were accepted, with the run that did. Only the buckets of the keys asked for are read."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 256):
        fields = [schema[k] for k in keys]
        self.keys = keys
        self.table = BucketedTable(spark, path, StructType([*fields, StructField("run", LongType())]), keys, buckets)

    def unknown(self, rows: DataFrame, run: int) -> DataFrame:
        """Rows whose keys no earlier run has; what the same run stored does not count, so a replay sees what it saw."""
        known = self.table.read(self.table.touched(rows)).filter(F.col("run") < run)
        known = known.select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        return rows.join(known, [rows[k].eqNullSafe(known[f"_{k}"]) for k in self.keys], "left_anti")

    def add(self, rows: DataFrame, run: int) -> None:
        new = rows.select(*self.keys).distinct().withColumn("run", F.lit(run).cast("bigint"))
        self.table.merge(new, lambda old, more: old.filter(F.col("run") != run).unionByName(more))
