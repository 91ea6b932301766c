"""Running totals, row numbers and neighbours that survive a hot key.

A plain window over a key puts all of that key's rows into one task. Here rows
are first added up per key and level (say day, then statement), windows run over
those sums, and only rows that share a key and all levels meet in a window.
Keys of few rows need none of that and take the plain window, which moves their
rows once. Neighbour lookups go by row number in fixed-size blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Staging

BLOCK = 10_000
COARSE = 1_000
# A key with more rows than this is added up level by level.
HOT = 100_000


def _same_place(rows: DataFrame, sums: DataFrame, place: list[str]) -> DataFrame:
    """Inner join on columns whose NULLs are equal; the columns of ``rows`` stay."""
    named = sums.withColumnsRenamed({c: f"_at_{c}" for c in place})
    on = [rows[c].eqNullSafe(named[f"_at_{c}"]) for c in place]
    return rows.join(named, on).drop(*[f"_at_{c}" for c in place])


def running_totals(
    df: DataFrame, keys: list[str], levels: list[str], tail: list[str], totals: dict[str, Column], hot: int = HOT
) -> DataFrame:
    """Inclusive running sum of each expression, in the order (*levels, *tail).

    ``levels`` go from coarse to fine; NULLs are values of their own and come first. Totals keep the type of
    their sums, so decimals keep their fraction; conditions are counted. The rows of each key are counted first:
    keys of more than ``hot`` rows go by levels, all others by one window.
    """
    names = list(totals)
    marked = df.select("*", *[totals[n].alias(f"_in_{n}") for n in names])
    flags = [c for c, kind in marked.dtypes if c.startswith("_in_") and kind == "boolean"]
    marked = marked.withColumns({c: F.col(c).cast("bigint") for c in flags})
    many = df.groupBy(*keys).count().filter(F.col("count") > hot).select(*[F.col(c).alias(f"_hot_{c}") for c in keys])
    if many.isEmpty():
        return _by_key(marked, df.columns, keys, levels, tail, names)
    many = Staging(df.sparkSession)(many, "hot")
    on = [marked[c].eqNullSafe(many[f"_hot_{c}"]) for c in keys]
    few = _by_key(marked.join(many, on, "left_anti"), df.columns, keys, levels, tail, names)
    return few.unionByName(_by_levels(marked.join(many, on, "left_semi"), df.columns, keys, levels, tail, names))


def _by_key(marked: DataFrame, columns: list[str], keys: list[str], levels: list[str], tail: list[str], names: list[str]) -> DataFrame:
    """The totals by a window over each key; NULL, of the same type, where ``_by_levels`` has it so."""
    so_far = Window.partitionBy(*keys).orderBy(*levels, *tail).rowsBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy(*keys, *levels).orderBy(*tail).rowsBetween(Window.unboundedPreceding, 0)
    kinds = _by_levels(marked, columns, keys, levels, tail, names).schema

    def total(name):
        added = F.sum(f"_in_{name}").over(so_far).cast(kinds[name].dataType)
        # A place whose amounts so far are all unknown has no total, whatever came before it.
        return F.when(F.sum(f"_in_{name}").over(here).isNotNull(), added) if marked.schema[f"_in_{name}"].nullable else added

    return marked.select(*columns, *[total(n).alias(n) for n in names])


def _by_levels(marked: DataFrame, columns: list[str], keys: list[str], levels: list[str], tail: list[str], names: list[str]) -> DataFrame:
    """The totals from sums per level, so that no window holds the rows of a key."""
    place = [*keys, *levels]
    sums = marked.groupBy(*place).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in names])

    def preceding(rows: DataFrame, depth: int) -> DataFrame:
        """Adds what comes before each row among the rows of the same parent."""
        order = Window.partitionBy(*keys, *levels[:depth]).orderBy(levels[depth])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(
            *keys, *levels[: depth + 1], *[f"_sum_{n}" for n in names],
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in names],
        )

    carried = preceding(sums, len(levels) - 1)
    rows = sums
    for depth in range(len(levels) - 2, -1, -1):
        parent = [*keys, *levels[: depth + 1]]
        rows = rows.groupBy(*parent).agg(*[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in names])
        outer = preceding(rows, depth).select(*parent, *[F.col(f"_before_{n}").alias(f"_outer_{n}") for n in names])
        carried = _same_place(carried, outer, parent).select(
            *place, *[f"_sum_{n}" for n in names],
            *[(F.col(f"_before_{n}") + F.col(f"_outer_{n}")).alias(f"_before_{n}") for n in names],
        )
    carried = carried.select(*place, *[f"_before_{n}" for n in names])
    within = Window.partitionBy(*place).orderBy(*tail).rowsBetween(Window.unboundedPreceding, 0)
    joined = _same_place(marked, carried, place)
    return joined.select(
        *[joined[c] for c in columns],
        *[(F.col(f"_before_{n}") + F.sum(f"_in_{n}").over(within)).alias(n) for n in names],
    )


def globally_numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based row number of all rows in one total order, without a window over them: ranges of the order go to
    partitions, each is sorted where it is, and the counts of the partitions before it are added. NULLs come first.

    Rows that agree in all of ``order`` share a partition, so it should end with a column that tells rows apart. The
    sorted rows are stored once, since a second run may cut the ranges elsewhere.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = Staging(df.sparkSession)(ranged, "ranged")
    part = F.shiftright("_at", 33)  # the id holds the partition above 33 bits and the place in it below
    sizes = {r.part: r["count"] for r in stored.groupBy(part.alias("part")).count().collect()}  # a number for each partition
    starts, before = [], 0
    for number in sorted(sizes):
        starts.append((number, before))
        before += sizes[number]
    offsets = df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    placed = stored.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.col("_before") + place + 1).alias(name))


def numbered_by_index(df: DataFrame, keys: list[str], index: str, tail: list[str], name: str) -> DataFrame:
    """1-based row number per key in the order (index, *tail), for an integer
    index; ranges of the index are counted first."""
    coarse = df.withColumn("_coarse", F.floor(F.col(index) / F.lit(COARSE)))
    return running_totals(coarse, keys, ["_coarse", index], tail, {name: F.lit(1)}).drop("_coarse")


def neighbours(
    df: DataFrame, keys: list[str], number: str, lookups: dict[str, tuple[str, int]], block: int = BLOCK
) -> DataFrame:
    """Values of rows a fixed distance away, given a gapless 1-based row number.

    ``lookups`` maps an output name to (column, offset). Rows near the edge of a
    block are copied into the block next to it, so no task ever holds more than
    one block of a key.
    """
    reach = sorted({0, *[-offset for _, offset in lookups.values()]})
    blocks = F.array_distinct(
        F.array(*[F.floor((F.col(number) + step) / F.lit(block)) for step in reach])
    )
    spread = df.withColumn("_block", F.explode(blocks))
    order = Window.partitionBy(*keys, "_block").orderBy(number)

    def neighbour(column, offset):
        return (F.lead(column, offset) if offset > 0 else F.lag(column, -offset)).over(order)

    looked = spread.select("*", *[neighbour(*lookup).alias(name) for name, lookup in lookups.items()])
    return looked.filter(F.col("_block") == F.floor(F.col(number) / F.lit(block))).drop("_block")


def nest_pages(
    df: DataFrame, key: str, order: list[str], fields: list[str], name: str, page: int = 1_000
) -> DataFrame:
    """Ordered arrays of rows per key, in pages of bounded size. The first order
    column is an integer.

    A key with up to ``page`` rows gets one array (page 0). Larger keys continue
    on further pages, so nothing is dropped and no array grows without bound.
    """
    first, *rest = order
    numbered = numbered_by_index(df, [key], first, rest, "_row")
    paged = numbered.withColumn("page", F.floor((F.col("_row") - 1) / F.lit(page)))
    return (
        paged.groupBy(key, "page")
        .agg(F.array_sort(F.collect_list(F.struct("_row", *fields))).alias(name))
        .withColumn(name, F.transform(name, lambda row: row.dropFields("_row")))
    )
