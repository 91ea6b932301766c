"""Session settings and the staging of shared intermediate results."""

from __future__ import annotations

import os
import pathlib
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # The statement chain compiles more plans than the default cache keeps.
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("fundlens")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def package_on_workers(spark: SparkSession) -> None:
    """Python workers started from now on also look where the driver found this package."""
    root, known = str(pathlib.Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    folders = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in folders:
        known["PYTHONPATH"] = os.pathsep.join([*folders, root])


def staging_root(spark: SparkSession) -> str | None:
    """Folder for staged tables: the cluster's checkpoint folder, or a scratch
    folder in local mode only. ``None`` means there is no shared folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        return None
    scratch = tempfile.mkdtemp(prefix="fundlens-stage-")
    spark.conf.set("spark.fundlens.staging", scratch)
    return scratch


class Staging:
    """Writes results that several later steps read and scans them back.

    The written copy cuts the lineage, so a lost executor repeats only the work
    after it, and gives later joins real size statistics. Without a shared
    folder the results are cached on the executors instead; lost blocks are then
    computed again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.fundlens.staging", None) or staging_root(spark)
        self.folder = None if root is None else f"{root}/fundlens/{uuid.uuid4().hex}"
        self.cached: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        if self.folder is None:
            self.cached.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return self.cached[-1]
        path = f"{self.folder}/{name}"
        # Most columns are hex digests, of which the default codec leaves every byte.
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # a repeated attempt replaces what a failed one left
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        """Deletes this run's copies; frames built on them become unreadable."""
        for df in self.cached:
            df.unpersist()
        if self.folder is not None:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
