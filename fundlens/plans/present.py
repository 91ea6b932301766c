"""Flat output columns, so that results compare across engines.

A spec lists ``name:kind`` pairs. Kinds: s text, n integer, m exact money as a
double, x average rounded to four places, b boolean, d date as text, l list of
texts joined with commas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _pairs(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    def column(name, kind):
        c = F.col(name)
        if kind == "n":
            c = c.cast("bigint")
        elif kind == "m":
            c = c.cast("double")
        elif kind == "x":
            c = F.round(c, 4).cast("double")
        elif kind == "l":
            c = F.array_join(c, ",")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        return c.alias(name)

    return df.select(*[column(*pair) for pair in _pairs(spec)])


def wrap(sql: str, spec: str) -> str:
    def column(name, kind):
        body = {
            "n": f"CAST({name} AS BIGINT)",
            "m": f"CAST({name} AS DOUBLE)",
            "x": f"round(CAST({name} AS DOUBLE), 4)",
            "l": f"array_to_string({name}, ',')",
            "b": f"CAST({name} AS BOOLEAN)",
        }.get(kind, f"CAST({name} AS VARCHAR)")
        return f"{body} AS {name}"

    return f"SELECT {', '.join(column(*pair) for pair in _pairs(spec))} FROM (\n{sql}\n) AS result"
