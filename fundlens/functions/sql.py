"""The library's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import unicode_fold_udf


def register_functions(spark: SparkSession) -> None:
    """Makes ``normalize_description(text)`` and ``fold_text(text)`` usable in SQL.

    ``fold_text`` is the one Python function; it is skipped for ASCII text.
    """
    spark.udf.register("unicode_fold", unicode_fold_udf())
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fold_text(value STRING) RETURNS STRING RETURN "
        r"coalesce(unicode_fold(CASE WHEN value RLIKE '[^\\x00-\\x7F]' THEN value END), lower(value))"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalize_description(value STRING) RETURNS STRING RETURN "
        r"upper(trim(regexp_replace(fold_text(coalesce(value, '')), '[^\\p{L}\\p{N}]+', ' ')))"
    )
