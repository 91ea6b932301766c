"""Scans of the base tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas

SCHEMAS = {
    "extractions": schemas.EXTRACTIONS,
    "submission_documents": schemas.LEDGER,
    "submissions": schemas.SUBMISSIONS,
    "transaction_rules": schemas.RULES,
    "business_calendar": schemas.CALENDAR,
}


def scan(spark: SparkSession, name: str, path: str, kind: str = "parquet", where: Column | None = None) -> DataFrame:
    """A base table without schema inference; a filter on ``date`` prunes folders."""
    declared = SCHEMAS[name]
    table = spark.read.schema(f"{declared}, date date").format(kind).load(path)
    return table if where is None else table.filter(where)


def since(days: int, now: Column | None = None) -> Column:
    """Filter on the date partition: the last so many days."""
    return F.col("date") >= F.date_sub(F.to_date(now if now is not None else F.current_timestamp()), days)
