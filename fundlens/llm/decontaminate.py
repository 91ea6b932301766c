"""Benchmark decontamination: word windows of the benchmark, as one constant hash set, against every word window.

Only column functions: a text becomes the array of its normalised words, and a window that starts at a word is
looked up in the set. The look-up compares the window itself, so a hit is verified. First and last words are looked
up before, which spares most windows their making. The set travels as a constant of the plan and only while it is
below ``MOST_WINDOWS``; a larger benchmark is joined with the exploded windows instead, with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Stage

WIDTH = 13
MOST_WINDOWS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


HITS = "array<struct<at: int, length: int, window: string>>"


def words_sql(text: str) -> str:
    """Normalised words: A-Z lower-cased, runs of digits, letters a-z and characters beyond ASCII; null has none."""
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), r'{WORD}', 0)"


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (item, length, window): every ``width`` consecutive words of an item, or all words of a shorter one.
    Items without words have none."""
    known = benchmark.select(F.col(item).alias("item"), F.expr(words_sql(f"`{text}`")).alias("w")).filter("size(w) > 0")
    known = known.withColumn("length", F.least(F.size("w"), F.lit(width)))
    at = known.select("item", "length", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("at"))
    return at.select("item", "length", F.array_join(F.slice("w", F.col("at"), F.col("length")), " ").alias("window")).distinct()


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))  # words hold neither quotes nor backslashes


def hits_sql(found: DataFrame) -> str | None:
    """SQL over an array w of words: the hits (at, length, window). None if the set is too large for a constant."""
    rows = found.select("length", "window").distinct().limit(MOST_WINDOWS + 1).collect()
    if len(rows) > MOST_WINDOWS:
        return None
    parts = []
    for length in sorted({r.length for r in rows}):
        own = [r.window for r in rows if r.length == length]
        first, last = {x.split(" ")[0] for x in own}, {x.split(" ")[-1] for x in own}
        look = (
            f"get(w, i - 1) IN ({_quoted(first)}) AND get(w, i + {length - 2}) IN ({_quoted(last)}) "
            f"AND array_join(slice(w, i, {length}), ' ') IN ({_quoted(own)})"
        )
        parts.append(
            f"CASE WHEN size(w) >= {length} THEN transform(filter(sequence(1, size(w) - {length - 1}), i -> {look}), "
            f"i -> struct(i AS at, {length} AS length, array_join(slice(w, i, {length}), ' ') AS window)) ELSE CAST(array() AS {HITS}) END"
        )
    return f"concat({', '.join(parts)})" if parts else f"CAST(array() AS {HITS})"


def _summary(words: str, hits: str) -> Column:
    """Struct (n_words, hits, places, contaminated). The arrays are bound as lambda variables, so they are made once
    wherever the optimizer puts the expression; places are those (from 1) of the words inside any hit, each once.
    Contaminated: at least a twentieth of the words is hit."""
    places = "array_distinct(flatten(transform(h, x -> sequence(x.at, x.at + x.length - 1))))"
    final = "named_struct('n_words', size(w), 'hits', h, 'places', p, 'contaminated', size(p) > 0 AND 20L * size(p) >= size(w))"
    bound = f"get(transform(array({hits}), h -> get(transform(array({places}), p -> {final}), 0)), 0)"
    return F.expr(f"get(transform(array({words}), w -> {bound}), 0)")


def with_hits(docs: DataFrame, found: DataFrame, text: str = "text", name: str = "_hit") -> DataFrame:
    """docs with the summary of each text's hits as one more column."""
    own = words_sql(f"`{text}`")
    hits = hits_sql(found)
    if hits is not None:
        return docs.withColumn(name, _summary(own, hits))
    lengths = [r.length for r in found.select("length").distinct().collect()]  # at most WIDTH of them
    keyed = Stage(docs.sparkSession, "decontaminate").write(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    every = keyed.select("_row", F.expr(own).alias("w"), F.explode(F.array(*map(F.lit, lengths))).alias("length")).filter("size(w) >= length")
    every = every.select("_row", "length", "w", F.explode(F.expr("sequence(1, size(w) - length + 1)")).alias("at"))
    every = every.select("_row", "at", "length", F.expr("array_join(slice(w, at, length), ' ')").alias("window"))
    hits = every.join(found.select("length", "window").distinct(), ["length", "window"], "left_semi")
    hits = hits.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("at", "length", "window"))).alias("_found"))
    return keyed.join(hits, "_row", "left").withColumn(name, _summary(own, f"coalesce(_found, CAST(array() AS {HITS}))")).drop("_row", "_found")


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated.

    Null and empty texts have no words and are clean. Repeated rows and null keys keep a row each. Items with a null
    id hit words but are not listed. An empty benchmark hits nothing. Texts are scanned whole.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    found = stage.write(windows(benchmark, text="text", width=width), "windows")
    scanned = with_hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), found)
    rows = stage.write(
        scanned.select(
            F.monotonically_increasing_id().alias("row"), "key", F.col("_hit.n_words").cast("long").alias("n_words"), F.size("_hit.places").cast("long").alias("n_hit"),
            F.array_distinct("_hit.hits.window").alias("found"), "_hit.contaminated"), "rows")
    items = found.filter("item is not null").select("window", F.col("item").cast("string").alias("item")).distinct()
    listed = (
        rows.filter("n_hit > 0").select("row", F.explode("found").alias("window")).join(items, "window")
        .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    none = F.array().cast("array<string>")
    return rows.join(listed, "row", "left").select(
        F.col("key").alias(key), "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), "contaminated")


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs without the contaminated ones; all columns stay. Rows need no key."""
    own = Stage(docs.sparkSession, "decontaminate")
    found = own.write(windows(benchmark, width=width), "windows")
    return with_hits(_apart(docs, text), found).filter("NOT _hit.contaminated").select("doc.*")


def _apart(docs: DataFrame, text: str) -> DataFrame:
    """The rows as one column and their texts as another, so that added columns clash with none of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text}`").alias("text"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with the hit words cut out of the text; what stands between words stays. Clean texts are unchanged."""
    found = Stage(docs.sparkSession, "decontaminate").write(windows(benchmark, width=width), "windows")
    scanned = with_hits(_apart(docs, text), found).withColumn("_cut", F.col("_hit.places"))
    cut = scanned.withColumn("_parts", F.when(F.size("_cut") > 0, F.regexp_extract_all(F.col("text"), F.lit(_PART), F.lit(0))))
    shift = f"CASE WHEN get(_parts, 0) RLIKE '^{_SQL_WORD_START}' THEN 0 ELSE 1 END"
    rest = F.expr(f"array_join(filter(_parts, (p, j) -> (j - {shift}) % 2 <> 0 OR NOT array_contains(_cut, CAST((j - {shift}) / 2 AS int) + 1)), '')")
    kept = F.when(F.size("_cut") > 0, rest).otherwise(F.col("text"))
    return cut.select(*[kept.alias(c) if c == text else F.col(f"doc.`{c}`") for c in docs.columns])


_LETTERS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # with capitals, which stand in the text itself
_PART = f"[^{_LETTERS}]+|[{_LETTERS}]+"
_SQL_WORD_START = f"[^{_LETTERS}]".replace("\\", "\\\\")
