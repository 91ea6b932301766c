"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the point i * golden ratio modulo 1 (in 32-bit fixed point). The points fall evenly into
[0, 1), which the sources share by their numbers of slots; so every stretch of the mix holds each source in its share.
A source has slots by its target, but LEAST_SLOTS at least: one with a small target has shorter blocks, not fewer of
them. The slots of a source are ranked and its target is cut into as many equal runs of words; the r-th slot takes run
r of its documents in shuffled order, over again when the source is used up, twice at most. So each source gives its
target to the word.

Running sums and ranks go by buckets of a source, so that no task holds a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Stage

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 2654435769  # 2**32 / golden ratio
SLOTS = 1024  # slots a source has on average, while blocks stay below MOST_WORDS
MOST_WORDS = 65_536
LEAST_SLOTS = 256  # slots of a source with a small target
BUCKET_ROWS = 4096
REPEATS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """``documents``: sid, doc_id, size, source, first (words of its source before it), source_size, target.
    ``schedule``: slot, sid, block, epoch, begin, end: the words of its source, counted on through its epochs, that
    the slot takes; epoch is that of the first. Slots without words (of sources with fewer words than slots) are left
    out. ``pieces``: slot, epoch, sid, first, doc_id, from_word, to_word. ``block_words``: words of the longest blocks,
    about."""

    documents: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    block_words: int


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, repeats: int = REPEATS) -> DataFrame:
    """From rows (source, source_size): sid, weight and target.

    Sources in code point order, null last, have the weights in turn. They share ``percent`` of all sizes by weight;
    none gets more than ``repeats`` times its size, and the excess goes to the others by weight. In the order of
    size per weight the full ones come first: source j is full if its limit is within its share of what is left
    after those before it. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))
    rows = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", F.element_at(turn, (F.col("sid") - 1) % len(weights) + 1))
    everything = Window.partitionBy()
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * percent / 100.0).withColumn("most", F.col("source_size") * repeats)
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - before) / weight_left)
    rows = rows.withColumn("full", F.min(F.col("most") <= F.col("level") * F.col("weight")).over(by_room.rowsBetween(Window.unboundedPreceding, 0)))
    # The first source that is not full has the level of all that follow.
    level = F.max(F.when(~F.col("full") & (F.col("place") == F.col("first_open")), F.col("level"))).over(everything)
    rows = rows.withColumn("place", F.row_number().over(by_room)).withColumn("first_open", F.min(F.when(~F.col("full"), F.col("place"))).over(everything))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return rows.withColumn("target", target).select("source", "sid", "weight", "source_size", "target")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, seed: int = 11) -> Mix:
    """The schedule and what it takes of each document.

    Null texts have no words and are never taken. A null source is a source of its own. Rows that repeat a key count
    each; their order is by hash of the key and then by size, so equal rows may stand for each other. An empty
    table, or one without words, gives an empty schedule.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    sized = stage.write(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sized")
    sources = stage.write(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).drop("rows"), weights, percent), "sources")
    totals = sources.agg(F.count("*").alias("n"), F.sum("target").alias("words")).first()
    n, words = totals.n, totals.words or 0.0
    block = int(max(1, min(MOST_WORDS, words // (SLOTS * max(n, 1)))))
    sources = sources.withColumn("slots", F.greatest(F.col("target") / block, F.when(F.col("target") > 0, F.lit(float(LEAST_SLOTS))).otherwise(0.0)))
    sources = sources.withColumn("step", F.when(F.col("target") > 0, F.ceil(F.col("target") / F.col("slots"))).otherwise(F.lit(1)))  # about the words of a slot
    slots = sources.agg(F.sum("slots").alias("slots")).first().slots or 0.0

    named = sources.withColumnRenamed("source", "name").select("name", "sid", "source_size", "target", "step")
    documents = sized.join(named, sized.source.eqNullSafe(named.name)).drop("name")
    documents = documents.withColumn("order", F.xxhash64(F.lit(seed), "doc_id"))
    buckets = max(1, 1 << (sized.count() // BUCKET_ROWS).bit_length())
    documents = documents.withColumn("bucket", F.shiftrightunsigned("order", 64 - buckets.bit_length() + 1) if buckets > 1 else F.lit(0).cast("long"))
    documents = stage.write(documents, "documents")
    of_bucket = documents.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    of_bucket = of_bucket.select("sid", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = documents.withColumn("upto", F.sum("size").over(inside)).join(of_bucket, ["sid", "bucket"])
    placed = placed.withColumn("first", F.col("ahead") + F.col("upto") - F.col("size"))
    placed = stage.write(placed.select("sid", "doc_id", "size", "source", "first", "source_size", "target", "step"), "placed")

    schedule = stage.write(_schedule(sources, n, slots), "schedule")
    # Documents and slots meet in cells of ``step`` words of their source, once: in the cell where their common words begin.
    last = F.col("first") + F.col("size") - 1
    cut = placed.filter("size > 0").select(
        "sid", "doc_id", "first", "size", "step", F.explode(F.sequence(F.floor(F.col("first") / F.col("step")), F.floor(last / F.col("step")))).alias("cell"))
    begin = F.greatest("first", "low")
    end = F.least(F.col("first") + F.col("size"), F.col("high"))
    met = cut.join(_passes(schedule, sources), ["sid", "cell"]).filter((begin < end) & (F.floor(begin / F.col("step")) == F.col("cell")))
    pieces = met.select("slot", "epoch", "sid", "first", "doc_id", (begin - F.col("first")).alias("from_word"), (end - F.col("first")).alias("to_word"))
    return Mix(placed.drop("step"), schedule, pieces, block)


def _schedule(sources: DataFrame, n: int, slots: float) -> DataFrame:
    """Rows (slot, sid, block, epoch, begin, end). Slots find their source by an equality join on cells of [0, 1)."""
    cells = 4 * max(n, 1)
    upto = F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    spans = sources.withColumn("upto", upto).filter("target > 0")
    give = F.least(F.round("target").cast("long"), F.col("source_size") * REPEATS)
    spans = spans.select("sid", "source_size", give.alias("give"), ((F.col("upto") - F.col("slots")) / slots if slots else F.lit(0.0)).alias("low"), (F.col("upto") / slots if slots else F.lit(0.0)).alias("high"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1).cast("long")))))
    spark = sources.sparkSession
    points = spark.range(int(-(-slots // 1))).select(F.col("id").alias("slot"), (((F.col("id") % (1 << 32)) * GOLDEN % (1 << 32) + 0.5) / float(1 << 32)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * cells))
    last = F.col("high") >= 1 - 1e-9
    chosen = points.join(spans, "cell").filter((F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | last))
    chosen = chosen.select("slot", "sid", "source_size", "give", F.floor(F.col("slot") / BUCKET_ROWS).alias("chunk"))
    counts = chosen.groupBy("sid", "chunk").agg(F.count("*").alias("here"))
    ahead = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("ahead"), F.sum("here").over(Window.partitionBy("sid")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = chosen.withColumn("inside", rank).join(counts, ["sid", "chunk"]).withColumn("block", F.col("ahead") + F.col("inside"))
    # block * give / n without its large product
    begin, end = (F.expr(f"{r} * (give div n) + ({r} * (give % n)) div n") for r in ("block", "(block + 1)"))
    ranked = ranked.withColumn("begin", begin).withColumn("end", end).filter("begin < end")
    return ranked.select("slot", "sid", "block", F.expr("begin div source_size").alias("epoch"), "begin", "end")


def _passes(schedule: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (slot, sid, epoch, low, high, cell): a slot's words in each epoch, for each cell of its source they touch."""
    rows = schedule.drop("epoch").join(sources.select("sid", "source_size", "step"), "sid")
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(begin div source_size, (end - 1) div source_size)")))
    before = F.col("epoch") * F.col("source_size")
    rows = rows.withColumn("low", F.greatest(F.col("begin") - before, F.lit(0))).withColumn("high", F.least(F.col("end") - before, F.col("source_size")))
    cells = F.sequence(F.floor(F.col("low") / F.col("step")), F.floor((F.col("high") - 1) / F.col("step")))
    return rows.select("slot", "sid", "epoch", "low", "high", F.explode(cells).alias("cell"))


def taken_words(found: Mix) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).
    A document's place in its source (sid, first) names it, so keys may repeat or be null."""
    taken = found.pieces.groupBy("sid", "first").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    with_words = found.documents.filter("size > 0").join(taken, ["sid", "first"], "left")
    columns = ["doc_id", "size", "source_size", "target"]
    none = found.documents.filter("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return with_words.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).union(none)
