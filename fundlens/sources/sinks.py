"""Writing submissions, events and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


class SchemaMismatch(ValueError):
    pass


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The frame in the declared schema. Unknown columns are refused; missing
    ones become NULL, so older writers keep working after columns were added."""
    declared = StructType.fromDDL(ddl)
    unknown = sorted(set(df.columns) - set(declared.names))
    if unknown:
        raise SchemaMismatch(f"columns not in the schema: {unknown}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in declared.fields
        ]
    )


ROWS_PER_FILE = 1_000_000


def append_by_date(df: DataFrame, path: str, ddl: str, time: str, cluster: list[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Append under a date partition in files of about ``rows_per_file``, each of one range of (date, cluster columns).

    The rows are counted, ranges of the order are sampled, and each task sorts and writes one: so a busy day is
    split into ranges of the cluster columns, quiet days share a task, and there are at most rows / rows_per_file files
    and one for each date. Readers that filter on a cluster column skip files and row groups by their bounds.
    """
    dated = conform(df, ddl).withColumn("date", F.to_date(time))
    ranges = max(1, -(-df.count() // rows_per_file))
    (
        dated.repartitionByRange(ranges, "date", *cluster).sortWithinPartitions("date", *cluster)
        .write.mode("append").partitionBy("date").parquet(path)
    )


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows together after columns were added."""
    return old.unionByName(new, allowMissingColumns=True)
