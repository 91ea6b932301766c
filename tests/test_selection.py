"""Exact medians against sorted lists, over keys of few, many and equal values."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from fundlens.operators import selection as S
from fundlens.session import Staging

SHAPE = "k string, part string, amount decimal(18,2)"


def expected(rows):
    groups = {}
    for k, part, v in rows:
        if k is not None and part is not None and v is not None:
            groups.setdefault((k, part), []).append(v)
    out = {}
    for key, vs in groups.items():
        vs.sort()
        out[key] = (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2
    return out


def rows_of(seed):
    rng = random.Random(seed)
    cents = lambda n: Decimal(n).scaleb(-2)
    rows = [("hot", "a", cents(rng.randint(-10**6, 10**9))) for _ in range(9000)]  # a third of all, nearly all distinct
    rows += [("close", "a", cents(10**15 + rng.randint(0, 4000))) for _ in range(6000)]
    rows += [("far", "b", cents(int(10 ** rng.uniform(0, 17)))) for _ in range(5001)] + [("far", "b", Decimal("9999999999999999.99")), ("far", "b", Decimal("-9999999999999999.99"))]
    rows += [("two", "a", cents(v)) for v in (1, 2)] + [("one", "a", cents(5))] + [("equal", "a", cents(7))] * 4000
    rows += [("gap", "c", cents(v)) for v in [*range(1500), *range(10**12, 10**12 + 1500)]]  # the middle falls between
    rows += [("hot", "a", None), (None, "a", cents(1)), ("none", "a", None)]
    rng.shuffle(rows)
    return rows


def test_medians_of_hot_keys(spark):
    rows = rows_of(1)
    values = spark.createDataFrame(rows, SHAPE).repartition(8)
    want = expected(rows)
    for limit in (50, 700, 100_000):
        found = {(r.k, r.part): r.m for r in S.exact_medians(values, ["k", "part"], "amount", "m", limit).collect()}
        assert found == want


def test_ranges_are_bounded(spark):
    counted = spark.createDataFrame(rows_of(2), SHAPE).dropna().groupBy("k", "part", F.col("amount").alias("value")).agg(F.count("*").alias("n"))
    whole = counted.withColumn("whole", (F.col("value") * 100).cast("decimal(38,0)")).cache()
    targets = S.narrowed(whole, ["k", "part"], Staging(spark), 50)
    left = S._meet(whole, targets, ["k", "part"]).filter(F.col("whole").between(F.col("low"), F.col("high"))).groupBy("k", "part", "which").count()
    assert {r.which for r in left.collect()} == {0, 1} and max(r["count"] for r in left.collect()) <= 50
    whole.unpersist()


def test_no_values(spark):
    assert S.exact_medians(spark.createDataFrame([], SHAPE), ["k", "part"], "amount", "m").collect() == []
