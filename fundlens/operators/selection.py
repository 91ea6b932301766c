"""Exact medians per key by counted ranges, so that no task holds the values of a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Staging

LIMIT = 10_000
RANGES = 1_000
SALTS = 32


def exact_medians(values: DataFrame, keys: list[str], value: str, name: str, limit: int = LIMIT) -> DataFrame:
    """The decimal median of each key's values (the mean of the two in the middle): (*keys, name). Null values and
    keys count for nothing.

    The histogram of values is made first, combined before the shuffle. Keys of up to ``limit`` distinct values are
    ranked by a window over it. A key with more is narrowed down: its span of values is cut into a thousand ranges,
    the ranges are counted, and the one that holds the middle is cut again until it has no more than ``limit`` values.
    So a window holds the counts of a thousand ranges, or ``limit`` values.
    """
    kind = values.schema[value].dataType
    counted = values.filter(F.col(value).isNotNull()).dropna(subset=keys).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    many = values.filter(F.col(value).isNotNull()).dropna(subset=keys).groupBy(*keys).agg(F.approx_count_distinct(value, 0.02).alias("d")).filter(F.col("d") > int(0.9 * limit)).select(*keys)
    if many.isEmpty():
        return _median(_ranked(counted, keys), keys, name)
    stage = Staging(values.sparkSession)
    many = stage(many, "many")
    # Decimals go as whole numbers of their last place, which differences and ranges need.
    scale = 10 ** kind.scale
    whole = stage(counted.join(many, keys, "left_semi").withColumn("whole", (F.col("value") * F.lit(scale)).cast("decimal(38,0)")), "histogram")
    targets = narrowed(whole, keys, stage, limit)
    left = _meet(whole, targets, keys).filter(F.col("whole").between(F.col("low"), F.col("high")))
    own = [*keys, "which"]
    up_to = Window.partitionBy(*own).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("before") + F.sum("n").over(up_to)
    hit = left.withColumn("last", last).filter(F.col("rank").between(F.col("last") - F.col("n") + 1, F.col("last")))
    hot = hit.groupBy(*keys).agg(F.min("value").alias("a"), F.max("value").alias("b"))
    plain = _median(_ranked(counted.join(many, keys, "left_anti"), keys), keys, name)
    return plain.unionByName(hot.select(*keys, _mean(F.col("a"), F.col("b")).alias(name)))


def _mean(a: Column, b: Column) -> Column:
    return ((a + b) * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(20,3)")


def _ranked(counted: DataFrame, keys: list[str]) -> DataFrame:
    key = Window.partitionBy(*keys)
    up_to = key.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select("*", F.sum("n").over(up_to).alias("last"), F.sum("n").over(key).alias("total"))


def _median(ranked: DataFrame, keys: list[str], name: str) -> DataFrame:
    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("last") - F.col("n") + 1, F.col("last")), F.col("value")))

    low, high = at(F.floor((F.col("total") + 1) / F.lit(2))), at(F.floor(F.col("total") / F.lit(2)) + 1)
    return ranked.groupBy(*keys).agg(_mean(low, high).alias(name))


def _meet(whole: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each key with its targets (two rows a key); the values of a key are spread over salts."""
    salted = whole.withColumn("salt", F.pmod(F.xxhash64("whole"), F.lit(SALTS)))
    copies = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "salt"]).drop("salt")


def narrowed(whole: DataFrame, keys: list[str], stage: Staging, limit: int) -> DataFrame:
    """Per key and middle rank (``which`` 0 and 1) a range low..high of whole numbers that holds the rank and at most
    ``limit`` distinct values, and how many values come ``before`` it."""
    spans = whole.groupBy(*keys).agg(F.min("whole").alias("low"), F.max("whole").alias("high"), F.sum("n").alias("total"), F.count("*").alias("inside"))
    ranks = F.array(F.floor((F.col("total") + 1) / F.lit(2)), F.floor(F.col("total") / F.lit(2)) + 1)
    targets = stage(spans.select(*keys, F.posexplode(ranks).alias("which", "rank"), "low", "high", F.lit(0).cast("bigint").alias("before"), "inside"), "targets-0")
    turn = 0
    own = [*keys, "which"]
    while not targets.filter((F.col("inside") > limit) & (F.col("low") < F.col("high"))).isEmpty():
        turn += 1
        width = F.ceil((F.col("high") - F.col("low") + 1) / F.lit(RANGES)).cast("decimal(38,0)")
        met = _meet(whole, targets, keys).filter(F.col("whole").between(F.col("low"), F.col("high"))).withColumn("width", width)
        number = F.floor((F.col("whole") - F.col("low")) / F.col("width")).cast("bigint")
        ranges = met.groupBy(*own, "rank", "low", "high", "before", "width", number.alias("number")).agg(F.sum("n").alias("n"), F.count("*").alias("inside"))
        up_to = Window.partitionBy(*own).orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
        counted = ranges.withColumn("last", F.col("before") + F.sum("n").over(up_to))
        holds = counted.filter(F.col("rank").between(F.col("last") - F.col("n") + 1, F.col("last")))
        low = (F.col("low") + F.col("number") * F.col("width")).cast("decimal(38,0)")
        targets = stage(holds.select(
            *own, "rank", low.alias("low"), F.least("high", low + F.col("width") - 1).cast("decimal(38,0)").alias("high"),
            (F.col("last") - F.col("n")).alias("before"), "inside"), f"targets-{turn}")
    return targets
