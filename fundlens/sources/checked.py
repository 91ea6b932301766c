"""Tables that become visible only after their constraints have held.

Row constraints and totals are counted by the pass that writes the rows (``observe``), so the input is read and worked
out once. Unique keys are counted from the written key columns alone, combined before the shuffle. A table that breaks
a constraint is deleted where it was written aside; readers never see it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .calendar import Calendar, calendar_flag_checks
from .rules import RULES_V1_COUNT, RULES_V1_DIGEST, rule_checks, rules_digest


class ConstraintFailed(ValueError):
    """``counts``: constraint to the number of rows (or totals, or surplus rows of a key) that break it."""

    def __init__(self, counts: dict[str, int]):
        super().__init__(", ".join(f"{name}: {n}" for name, n in sorted(counts.items()) if n))
        self.counts = counts


@dataclass(frozen=True)
class Constraints:
    """``rows``: name to a condition that each row has to meet (NULL does not meet it). ``totals``: name to an
    aggregate that has to be true of all rows. ``unique``: name to key columns without repeats (NULLs are equal)."""

    rows: dict[str, Column] = field(default_factory=dict)
    totals: dict[str, Column] = field(default_factory=dict)
    unique: dict[str, list[str]] = field(default_factory=dict)


def written_with_counts(df: DataFrame, path: str, constraints: Constraints) -> tuple[int, dict[str, int]]:
    """Writes the rows to ``path`` and returns their number and, per constraint, how many break it."""
    seen = Observation()
    flagged = df.select("*", *[F.coalesce(met, F.lit(False)).alias(f"_met_{name}") for name, met in constraints.rows.items()])
    flags = [f"_met_{name}" for name in constraints.rows]
    broken = [F.count_if(~F.col(flag)).alias(name) for flag, name in zip(flags, constraints.rows)]
    untrue = [F.when(F.coalesce(met, F.lit(False)), 0).otherwise(1).alias(name) for name, met in constraints.totals.items()]
    # The counts stand directly before the writing, so no later stage can repeat them.
    counted = flagged.observe(seen, F.count(F.lit(1)).alias("_rows"), *broken, *untrue)
    counted.drop(*flags).write.mode("overwrite").parquet(path)
    counts = dict(seen.get)
    rows = counts.pop("_rows")
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    for name, keys in constraints.unique.items():
        # Of each task the map side sends one row a key, so a key that repeats a million times is no hot group.
        counts[name] = written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    return rows, counts


def write_checked(df: DataFrame, path: str, constraints: Constraints) -> int:
    """Replaces the table at ``path`` if all constraints hold and returns its number of rows; else ``ConstraintFailed``,
    and what was at ``path`` stays. An attempt that was cut off leaves a folder beside it that no reader looks at."""
    aside = f"{path.rstrip('/')}__attempt_{uuid.uuid4().hex}"
    rows, counts = written_with_counts(df, aside, constraints)
    jvm = df.sparkSession.sparkContext._jvm
    target, attempt = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(aside)
    files = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    if any(counts.values()):
        files.delete(attempt, True)
        raise ConstraintFailed(counts)
    files.delete(target, True)
    if not files.rename(attempt, target):
        raise OSError(f"{aside} could not take the place of {path}")
    return rows


def rule_constraints(version: int | None = None) -> Constraints:
    """What holds of every rule table; of version 1 also its number of rules."""
    size = {} if version != 1 else {"RULE_COUNT": F.count_if(F.col("analysis_version") == 1) == RULES_V1_COUNT}
    return Constraints({name: ~bad for name, bad in rule_checks().items()}, size, {"DUPLICATE_RULE": ["analysis_version", "rule_id"]})


def write_rules(rules: DataFrame, path: str) -> int:
    """The rule table, after all its constraints. Version 1 must also have its digest; rules are few, and the digest
    is that of one text."""
    version = 1 if rules.filter("analysis_version = 1").limit(1).count() else None
    if version and rules_digest(rules).first().digest != RULES_V1_DIGEST:
        raise ConstraintFailed({"DIGEST": 1})
    return write_checked(rules, path, rule_constraints(version))


def calendar_constraints(calendar: Calendar) -> Constraints:
    size = (calendar.last - calendar.first).days + 1
    return Constraints(
        {name: ~bad for name, bad in calendar_flag_checks().items()},
        {
            "COMPLETE": F.count(F.lit(1)) == size, "FIRST_DAY": F.min("calendar_date") == F.lit(calendar.first),
            "LAST_DAY": F.max("calendar_date") == F.lit(calendar.last),
        },
        {"DUPLICATE_DAY": ["calendar_date"]},
    )
