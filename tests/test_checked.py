import pytest
from pyspark.sql import functions as F

from fundlens.sources.calendar import Calendar
from fundlens.sources.checked import (
    ConstraintFailed, Constraints, calendar_constraints, write_checked, write_rules, written_with_counts,
)
from fundlens.sources.rules import default_rules


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(1000).mapInArrow(noted, "id long")
    found = written_with_counts(rows, f"{tmp_path}/t", Constraints({"SMALL": F.col("id") < 990, "KNOWN": F.nullif("id", F.lit(5)) >= 0}, {"FULL": F.count("id") == 1000, "LOW": F.min("id") == 1}))
    assert found == (1000, {"SMALL": 10, "KNOWN": 1, "FULL": 0, "LOW": 1})
    assert seen.value == 1000  # one pass


def test_a_table_that_breaks_a_constraint_stays_unseen(spark, tmp_path):
    path, keys = f"{tmp_path}/t", Constraints(unique={"REPEATED": ["k"]})
    first = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    assert write_checked(first, path, keys) == 3
    with pytest.raises(ConstraintFailed, match="REPEATED: 3") as failed:
        write_checked(first.union(first), path, keys)
    assert failed.value.counts == {"REPEATED": 3}
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert write_checked(first.limit(0), path, keys) == 0 and spark.read.parquet(path).count() == 0


def test_rules_and_calendar_pass_their_constraints(spark, tmp_path):
    rules = default_rules(spark)
    assert write_rules(rules, f"{tmp_path}/rules") == 29
    for broken in (rules.limit(28), rules.withColumn("priority", F.lit(-1).cast("bigint"))):
        with pytest.raises(ConstraintFailed, match="DIGEST"):
            write_rules(broken, f"{tmp_path}/rules")
    second = rules.withColumn("analysis_version", F.lit(2).cast("bigint")).withColumn("match_value", F.lower("match_value"))
    with pytest.raises(ConstraintFailed, match="MATCH_VALUE_NOT_NORMALISED: 29"):
        write_rules(second, f"{tmp_path}/rules")
    calendar = Calendar()
    days = calendar.days(spark)
    assert write_checked(days, f"{tmp_path}/days", calendar_constraints(calendar)) == 9497
    with pytest.raises(ConstraintFailed) as failed:
        write_checked(days.filter(F.col("calendar_date") > F.lit(calendar.first)), f"{tmp_path}/days", calendar_constraints(calendar))
    assert {k for k, n in failed.value.counts.items() if n} == {"COMPLETE", "FIRST_DAY"}
