"""Business calendar: one row per day with US federal holidays."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Holidays on a set day (month, day, name, first year) ...
FIXED_HOLIDAYS = [
    (1, 1, "New Year's Day", None),
    (6, 19, "Juneteenth National Independence Day", 2021),
    (7, 4, "Independence Day", None),
    (11, 11, "Veterans Day", None),
    (12, 25, "Christmas Day", None),
]
# ... and on the n-th weekday of a month (month, day of week with Sunday 1, n, name; -1 is last).
FLOATING_HOLIDAYS = [
    (1, 2, 3, "Birthday of Martin Luther King, Jr."),
    (2, 2, 3, "Washington's Birthday"),
    (5, 2, -1, "Memorial Day"),
    (9, 2, 1, "Labor Day"),
    (10, 2, 2, "Columbus Day"),
    (11, 5, 4, "Thanksgiving Day"),
]

MAX_YEARS = 400


@dataclass(frozen=True)
class Calendar:
    """Calendar over whole years. At most 400 years, so under 150,000 rows:
    small enough to broadcast whatever the size of the data joined to it."""

    start_year: int = 2015
    end_year: int = 2040

    def __post_init__(self):
        if not 0 < self.end_year - self.start_year + 1 <= MAX_YEARS:
            raise ValueError("calendar must span 1 to 400 years")

    @property
    def first(self) -> dt.date:
        return dt.date(self.start_year, 1, 1)

    @property
    def last(self) -> dt.date:
        return dt.date(self.end_year, 12, 31)

    def _bound(self, value: dt.date) -> Column:
        return F.lit(value)

    def clip_start(self, day: Column) -> Column:
        return F.when(day.isNotNull(), F.greatest(day, self._bound(self.first)))

    def clip_end(self, day: Column) -> Column:
        return F.when(day.isNotNull(), F.least(day, self._bound(self.last)))

    def contains(self, day: Column) -> Column:
        return day.between(self._bound(self.first), self._bound(self.last))

    def days(self, spark: SparkSession) -> DataFrame:
        holidays = _holidays(spark, self.start_year, self.end_year).filter(
            self.contains(F.col("calendar_date"))
        )
        dates = spark.range(1).select(
            F.explode(F.sequence(F.lit(self.first), F.lit(self.last))).alias("calendar_date")
        )
        weekend = F.dayofweek("calendar_date").isin(1, 7)
        return dates.join(F.broadcast(holidays), "calendar_date", "left").select(
            "calendar_date",
            (~weekend & F.col("holiday_name").isNull()).alias("is_business_day"),
            weekend.alias("is_weekend"),
            F.col("holiday_name").isNotNull().alias("is_federal_holiday"),
            "holiday_name",
        )

    def ordinals(self, spark: SparkSession) -> DataFrame:
        """Each day with the number of business days up to and including it.

        Counting the business days between two dates is then a subtraction. The
        window has one partition, of the bounded calendar only.
        """
        running = Window.orderBy("calendar_date").rowsBetween(Window.unboundedPreceding, 0)
        return self.days(spark).select(
            "calendar_date",
            "is_business_day",
            F.sum(F.col("is_business_day").cast("bigint")).over(running).alias("business_day_ordinal"),
        )


def _holidays(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    year = F.col("year").cast("int")
    years = spark.range(start_year, end_year + 1).withColumnRenamed("id", "year")

    fixed = [
        F.when(
            year >= (since or 0),
            F.struct(F.make_date(year, F.lit(month), F.lit(day)).alias("day"), F.lit(name).alias("name")),
        )
        for month, day, name, since in FIXED_HOLIDAYS
    ]
    floating = []
    for month, weekday, nth, name in FLOATING_HOLIDAYS:
        first = F.make_date(year, F.lit(month), F.lit(1))
        if nth > 0:
            day = F.date_add(first, F.pmod(weekday - F.dayofweek(first), F.lit(7)) + 7 * (nth - 1))
        else:
            last = F.last_day(first)
            day = F.date_sub(last, F.pmod(F.dayofweek(last) - weekday, F.lit(7)))
        floating.append(F.struct(day.alias("day"), F.lit(name).alias("name")))

    fixed_days = years.select(F.explode(F.array_compact(F.array(*fixed))).alias("h")).select("h.*")
    # A Sunday holiday is also observed on Monday; a Saturday one is not moved.
    observed = fixed_days.filter(F.dayofweek("day") == 1).select(
        F.date_add("day", 1).alias("day"), F.concat("name", F.lit(" (Observed)")).alias("name")
    )
    floating_days = years.select(F.explode(F.array(*floating)).alias("h")).select("h.*")
    named = fixed_days.unionByName(observed).unionByName(floating_days)
    return named.groupBy(F.col("day").alias("calendar_date")).agg(
        F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("holiday_name")
    )


def calendar_flag_checks() -> dict[str, Column]:
    """Violation code to the condition under which a day shows it."""
    bad = (
        F.col("is_business_day").isNull()
        | (F.col("is_business_day") != ~(F.col("is_weekend") | F.col("is_federal_holiday")))
        | (F.col("is_federal_holiday") != F.col("holiday_name").isNotNull())
    )
    return {"INCONSISTENT_FLAGS": F.coalesce(bad, F.lit(False))}


def calendar_violations(days: DataFrame, calendar: Calendar) -> DataFrame:
    """Rows that break the calendar contract; empty when it holds."""
    size = (calendar.last - calendar.first).days + 1
    whole = days.agg(
        F.count("*").alias("rows"),
        F.countDistinct("calendar_date").alias("dates"),
        F.min("calendar_date").alias("low"),
        F.max("calendar_date").alias("high"),
    ).filter(
        (F.col("rows") != size)
        | (F.col("dates") != size)
        | (F.col("low") != F.lit(calendar.first))
        | (F.col("high") != F.lit(calendar.last))
    ).select(F.lit("INCOMPLETE_OR_DUPLICATED").alias("violation"), F.lit(None).cast("date").alias("calendar_date"))
    flags = [days.filter(bad).select(F.lit(code).alias("violation"), "calendar_date") for code, bad in calendar_flag_checks().items()]
    return reduce(DataFrame.unionByName, flags, whole)
