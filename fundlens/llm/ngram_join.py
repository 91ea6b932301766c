"""Jaccard self-join of documents on word shingles by a grouped prefix join.

A document is the set of its hashed shingles. Under one order of all shingles (rare ones first) two sets
that are similar enough share a shingle of their prefixes, so only documents that meet in a prefix shingle
are compared:

1. documents with equal sets are one node; nodes with equal prefixes and sizes are one group;
2. groups meet in the shingles of their prefixes. First every meeting is compared in a star around the member
   that has the shingle earliest, which is the least changed copy of a family; what links becomes one label;
3. then all meetings of groups with different labels are expanded to their members and compared, so no link
   between two components is lost, but a family of n copies costs about n comparisons instead of n * n. Before that, the
   number of prefix shingles that two can share at most rules out most of them;
4. components of the links follow by alternating large-star and small-star rounds.

So only components are computed. Pairs that one label holds already are never compared: neither the links of a
document nor their number can be had from here.

The order comes from a table of fixed size: how many documents have a shingle of each of 2**20 buckets. It
bears on the cost only. Nodes are 64-bit set hashes and shingles 64-bit hashes: equal hashes are taken for
equal shingles. All intermediate results are tables in the shared folder; only tables of fixed size
(bucket counts, bit sets) come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Stage, arrow_rows, mix, release, small_batches, word_hashes

ORDER_BITS = 20
FILTER_BITS = 24
_BLOCKS = 64
_SALTS = mix(np.arange(1, 65, dtype=np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, no words none."""
    if not len(words):
        return words
    size = min(k, len(words))
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += mix(words[i : len(words) - size + 1 + i] ^ _SALTS[i % 64]) * (_SALTS[(i * 7 + 3) % 64] | np.uint64(1))
    return np.unique(mix(total))


def _node(found: np.ndarray) -> int:
    """Hash of a set of shingles, as a signed number."""
    spread = mix(found ^ _SALTS[40]) + mix(found) * (_SALTS[41] | np.uint64(1))
    return int(mix(spread.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found))).view(np.int64)[0])


def needed(size, percent: int):
    """Least size of the intersection for a set of ``size`` to be similar to any set."""
    return -(-percent * size // 100)


def _ordered(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the common order: by rank of the bucket, then by hash."""
    key = (rank[found >> np.uint64(64 - ORDER_BITS)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
    return found[np.argsort(key, kind="stable")]


def _signatures(k: int):
    """Per row its id, size of the set and node; at the end of a task the counts of its shingles by bucket."""

    def run(batches):
        counts = np.zeros(1 << ORDER_BITS, dtype=np.int64)
        for batch in batches:
            ids, sizes, nodes, seen = batch.column(0), [], [], []
            for _, words in word_hashes(batch.column(1).to_pylist()):
                found = shingles(words, k)
                sizes.append(len(found))
                nodes.append(_node(found))
                seen.append(found >> np.uint64(64 - ORDER_BITS))
            if seen:
                counts += np.bincount(np.concatenate(seen).astype(np.int64), minlength=1 << ORDER_BITS)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    ["doc_id", "n", "node", "block", "counts"])
        if counts.any():
            parts = [x.astype(np.int32).tobytes() for x in np.split(np.minimum(counts, (1 << 31) - 1), _BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(_BLOCKS, pa.int64()), pa.nulls(_BLOCKS, pa.int64()), pa.nulls(_BLOCKS, pa.int64()), pa.array(range(_BLOCKS), pa.int32()), pa.array(parts, pa.binary())],
                ["doc_id", "n", "node", "block", "counts"])

    return run


def _merge_blocks(kind: str):
    """Adds (int32) or joins (bits) the blocks of all tasks; holds one block of each number."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, np.int32).astype(np.int64) if kind == "sum" else np.frombuffer(raw, np.uint8)
                held[block] = part if block not in held else held[block] + part if kind == "sum" else held[block] | part
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "counts": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    return run


def _collected(blocks: DataFrame, kind: str, size: int, dtype) -> np.ndarray:
    """A table of ``size`` numbers from its blocks; a missing block is zeros."""
    whole = np.zeros(size, dtype=dtype)
    part = size // _BLOCKS
    for row in blocks.repartition("block").mapInArrow(_merge_blocks(kind), "block int, counts binary").collect():
        whole[row.block * part : (row.block + 1) * part] = np.frombuffer(bytes(row.counts), dtype)
    return whole


def _bit_blocks(batches):
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in batches:
        bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
    parts = [x.tobytes() for x in np.split(np.packbits(bits), _BLOCKS)]
    yield pa.RecordBatch.from_pydict({"block": pa.array(range(_BLOCKS), pa.int32()), "counts": pa.array(parts, pa.binary())})


def _prefixes(k: int, percent: int, rank: np.ndarray):
    """Per row with shingles: node, size, hash of (size, prefix), prefix."""

    def run(batches):
        for batch in batches:
            out = []
            for _, words in word_hashes(batch.column(0).to_pylist()):
                found = shingles(words, k)
                if len(found):
                    prefix = _ordered(found, rank)[: len(found) - needed(len(found), percent) + 1]
                    place = np.arange(len(prefix), dtype=np.uint64) * _SALTS[42]
                    group = mix(np.array([len(found)], dtype=np.uint64) + mix(prefix ^ mix(place)).sum(dtype=np.uint64))
                    out.append((_node(found), len(found), int(group.view(np.int64)[0]), prefix.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["node", "n", "g", "prefix"])

    return run


def _postings(batches):
    """Rows (token, g, n, pos) of the prefixes."""
    for batch in batches:
        tokens = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        sizes = [len(x) for x in tokens]
        if tokens:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(batch.column(1).to_numpy(), sizes)),
                 pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]))], ["token", "g", "n", "pos"])


def _meetings(percent: int):
    """From postings sorted by token, pos and g: the rows whose token others share (b null), and as pairs (g, b)
    with null token what each is compared with first: the first row of its token and the row before it.
    Between batches it keeps one row and the first row of the token that goes on."""

    def rows(token, g, n, pos):
        return [pa.array(token, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), pa.nulls(len(g), pa.int64())]

    def run(batches):
        names = ["token", "g", "n", "pos", "b"]
        tail, tail_shared, pivot = None, False, None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if not len(cols[0]):
                continue
            if tail is not None:
                cols = [np.r_[a, b] for a, b in zip(tail, cols)]
            token, g, n, pos = cols
            as_before = np.r_[tail_shared, token[1:] == token[:-1]]
            start = np.maximum.accumulate(np.where(as_before, 0, np.arange(len(token))))
            first_g, first_n = g[start], n[start]
            if tail_shared:
                first_g, first_n = np.where(start == 0, pivot[0], first_g), np.where(start == 0, pivot[1], first_n)
            new = np.flatnonzero(as_before)
            new = new[new > 0]
            pairs = np.unique(np.vstack([
                np.column_stack([np.minimum(o, g[new]), np.maximum(o, g[new])])[(o != g[new]) & (100 * np.minimum(m, n[new]).astype(np.int64) >= percent * np.maximum(m, n[new]).astype(np.int64))]
                for o, m in ((first_g[new], first_n[new]), (g[new - 1], n[new - 1]))]), axis=0)
            shared = as_before[:-1] | as_before[1:]
            yield pa.RecordBatch.from_arrays(rows(*(c[:-1][shared] for c in cols)), names)
            none = pa.nulls(len(pairs), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), none, none, pa.array(pairs[:, 1])], names)
            tail, tail_shared, pivot = [c[-1:] for c in cols], bool(as_before[-1]), (first_g[-1], first_n[-1])
        if tail_shared:
            yield pa.RecordBatch.from_arrays(rows(*tail), names)

    return run


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def components(stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """Table (node, root) of the nodes of the edges (a, b): root is the smallest node that links reach.

    Large-star: every larger neighbour of a node goes to its smallest neighbour; small-star: every smaller one and
    the node itself. Both only need each node's smallest neighbour, a partial aggregate, never its neighbour list.
    """
    edges = stage.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-0")
    before, turn = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        turn += 1
        after = stage.write(small.filter("u > v").distinct(), f"{name}-{turn}")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        stage.drop(f"{name}-{turn - 1}")
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def _sets(k: int, bits: np.ndarray):
    """Node and set of the rows whose node may be asked for."""

    def run(batches):
        wanted = np.unpackbits(bits).view(bool)
        for batch in batches:
            out = []
            for _, words in word_hashes(batch.column(0).to_pylist()):
                found = shingles(words, k)
                if len(found) and wanted[(node := _node(found)) % (1 << 64) >> (64 - FILTER_BITS)]:
                    out.append((node, found.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 2, (pa.int64(), pa.binary()))], ["node", "found"])

    return run


COMPARED = "a long, b long, shared int, n int"


def _compared(batches):
    """How many shingles each pair shares, and has together with repeats."""
    for batch in batches:
        shared, n = [], []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared.append(len(np.intersect1d(x, y, assume_unique=True)))
            n.append(len(x) + len(y))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32()), pa.array(n, pa.int32())], ["a", "b", "shared", "n"])


def _bounded(batches):
    """The same from prefixes, as the most that a pair can share: what both prefixes have, and all behind the prefix
    that ends first."""
    for batch in batches:
        shared, n = [], []
        for x, y, nx, ny in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared.append(min(len(np.intersect1d(x, y, assume_unique=True)) + max(nx - len(x), ny - len(y)), nx, ny))
            n.append(nx + ny)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int32()), pa.array(n, pa.int32())], ["a", "b", "shared", "n"])


def _similar(percent: int) -> Column:
    return F.col("shared") * (100 + percent) >= F.col("n") * percent


def bounded(stage: Stage, nodes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """For pairs of nodes (a, b) the most that they can share, from their prefixes alone."""
    one, two = (nodes.select(F.col("node").alias(x), F.col("prefix").alias(f"p{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "pa", "pb", "na", "nb")
    with arrow_rows(stage.spark, 500):
        return stage.write(both.mapInArrow(_bounded, COMPARED), name)


def compared(stage: Stage, texts: DataFrame, pairs: DataFrame, name: str, k: int) -> DataFrame:
    """For pairs of nodes (a, b) what their sets share. The sets are made again from the texts, for nodes
    that pass a bit set of the wanted ones, instead of keeping the sets of all documents."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    bits = _collected(nodes.mapInArrow(_bit_blocks, "block int, counts binary"), "or", (1 << FILTER_BITS) // 8, np.uint8)
    small_batches(stage.spark)
    sets = stage.write(texts.mapInArrow(_sets(k, bits), "node long, found binary").dropDuplicates(["node"]), f"{name}-sets")
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b").select("a", "b", "x", "y")
    with arrow_rows(stage.spark, 100):
        found = stage.write(both.mapInArrow(_compared, COMPARED), f"{name}-compared")
    stage.drop(f"{name}-sets")
    release(stage.spark)
    return found


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest key that links reach); node and root, the
    hashes that name the row's set and its component, for rows that repeat a key. Links are not counted: only those
    that connect components are looked for.

    Two documents link when 100 * shared shingles >= percent * shingles of either. Words are runs of characters
    other than white space, A-Z lower-cased. Null and empty texts have no shingles and link with nothing: their
    component is their own key. Rows with equal texts are in one component, rows that repeat a key keep a row
    each. A null key is never a component while a member has one. Very long texts are taken whole; their sets must
    fit into a task, as the texts do. An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "ngram-join")
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    with arrow_rows(spark, 1000):
        signed = stage.write(texts.mapInArrow(_signatures(k), "doc_id long, n long, node long, block int, counts binary"), "signed")
    counts = _collected(signed.filter("block is not null").select("block", "counts"), "sum", 1 << ORDER_BITS, np.int64)
    rank = np.minimum(8 * np.log2(1.0 + counts), 255).astype(np.uint8)
    signed = signed.filter("block is null").select("doc_id", "n", "node")
    with arrow_rows(spark, 1000):
        nodes = stage.write(
            texts.select("text").mapInArrow(_prefixes(k, percent, rank), "node long, n int, g long, prefix binary")
            .groupBy("node").agg(F.first("n").alias("n"), F.first("g").alias("g"), F.first("prefix").alias("prefix")), "nodes")
    members = nodes.select("g", "node", "n")
    heads = members.groupBy("g").agg(F.min("node").alias("head"), F.count("*").alias("size"))
    groups = nodes.groupBy("g").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).select("g", "n", "prefix")
    with arrow_rows(spark, 1000):
        postings = groups.mapInArrow(_postings, "token long, g long, n int, pos int")
        sorted_postings = postings.repartition("token").sortWithinPartitions("token", "pos", "g")
        met = stage.write(sorted_postings.mapInArrow(_meetings(percent), "token long, g long, n int, pos int, b long"), "met")
    release(spark)

    a, b = (heads.select(F.col("g").alias(x), F.col("head").alias(y)) for x, y in (("g", "na"), ("b", "nb")))
    star = met.filter("b is not null").select("g", "b").distinct().join(a, "g").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    inside = members.join(heads.filter("size > 1"), "g").filter("node > head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    star = bounded(stage, nodes, star.union(inside), "star")
    likely = star.filter(_similar(percent)).select("a", "b")
    known = compared(stage, texts.select("text"), likely, "first", k)
    links = known.filter(_similar(percent)).select("a", "b")
    roots = components(stage, links, "labels")

    labelled = stage.write(members.join(roots, "node", "left").select("g", "node", "n", F.coalesce("root", "node").alias("label")), "labelled")
    spans = labelled.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    rows = met.filter("b is null").select("token", "g", "n", "pos").join(spans, "g")
    mixed = rows.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l < h").select("token")
    rows = rows.join(mixed, "token", "left_semi")
    own = Window.partitionBy("g")  # at most a prefix
    rows = rows.withColumn("shared", F.count("*").over(own)).withColumn("before", F.row_number().over(own.orderBy("pos")) - 1)
    rows = stage.write(rows, "mixed")
    release(spark)
    x, y = rows.alias("x"), rows.alias("y")
    # What two sets share is in both prefixes, or behind the prefix that ends first; at a meeting, what lies before it
    # and after it in either bounds what both prefixes have, counting only shingles that other labels have too.
    need = (F.col("x.n") + F.col("y.n")) * percent  # similar sets share at least need / (100 + percent)
    at_most = F.least("x.pos", "y.pos") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    in_prefix = F.least("x.before", "y.before") + F.least(F.col("x.shared") - F.col("x.before"), F.col("y.shared") - F.col("y.before"))
    behind = F.greatest(*(F.floor((F.col(f"{r}.n") * percent + 99) / 100).cast("int") - 1 for r in "xy"))
    met_again = x.join(
        y, (F.col("x.token") == F.col("y.token")) & (F.col("x.g") < F.col("y.g"))
        & ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
        & similar_sizes(F.col("x.n"), F.col("y.n"), percent) & (at_most * (100 + percent) >= need)
        & ((in_prefix + behind) * (100 + percent) >= need),
    ).select(F.col("x.g").alias("g"), F.col("y.g").alias("h"), need.alias("need"), behind.alias("behind"))
    met_again = met_again.groupBy("g", "h", "need", "behind").count().filter((F.col("count") + F.col("behind")) * (100 + percent) >= F.col("need")).select("g", "h")
    one, two = labelled.select("g", F.col("node").alias("a"), F.col("label").alias("la")), labelled.select(F.col("g").alias("h"), F.col("node").alias("b"), F.col("label").alias("lb"))
    across = met_again.join(one, "g").join(two, "h").filter("la <> lb").select("a", "b")
    within = one.join(two, (one.g == two.h) & (one.a < two.b) & (one.la != two.lb)).select("a", "b")
    rest = stage.write(across.union(within).join(star.select("a", "b"), ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.union(compared(stage, texts.select("text"), rest, "second", k).filter(_similar(percent)).select("a", "b"))
        roots = components(stage, links, "roots")
    placed = signed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("low"))
    result = placed.join(lowest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), "node", "root")
    result = stage.write(result, "result")
    for name in ("signed", "nodes", "met", "star", "labelled", "mixed", "rest"):
        stage.drop(name)
    return result


def _nodes(text: Column, k: int) -> Column:
    """The node of each text."""

    @F.pandas_udf("long")
    def nodes(texts: pd.Series) -> pd.Series:
        return pd.Series([_node(shingles(words, k)) for _, words in word_hashes(texts.tolist())], dtype="int64")

    return nodes(text)


def one_per_component(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """One row of docs for each component: one with its smallest key. Of rows without shingles one stays for each key.
    Rows with a null key stay, as nothing names them. All columns of docs are kept.

    ``found`` is what similar_documents gives for docs. A key names the rows of a component unless it occurs with
    different sets; the rows of such keys, if there are any, are told apart by their nodes, made again from the texts.
    """
    known = found.filter(F.col("doc_id").isNotNull())
    own = known.groupBy("doc_id").agg(F.min(F.col("component_id") == F.col("doc_id")).alias("stays"), (F.min("node") < F.max("node")).alias("mixed"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))  # the columns added below clash with none
    named = rows.withColumn("key", F.col(f"doc.`{key}`")).filter("key IS NOT NULL")
    kept = named.join(own, named["key"] == own["doc_id"], "left").filter(F.coalesce(F.col("stays") & ~F.col("mixed"), F.lit(True)))
    first = kept.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("key"))).filter("turn = 1")
    result = first.select("doc.*").union(docs.filter(F.col(f"`{key}`").isNull()))
    mixed = own.filter("mixed").select("doc_id")
    if mixed.isEmpty():
        return result
    small_batches(docs.sparkSession)
    least = known.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("least")).select("least.doc_id", "least.node")
    least = least.union(known.filter("n_shingles = 0").select("doc_id", "node").distinct()).join(mixed, "doc_id", "left_semi")
    several = named.join(mixed, named["key"] == mixed["doc_id"], "left_semi").withColumn("at", _nodes(F.col(f"doc.`{text}`"), k))
    several = several.join(least, (F.col("key") == F.col("doc_id")) & (F.col("at") == F.col("node")), "left_semi")
    several = several.withColumn("turn", F.row_number().over(Window.partitionBy("key", "at").orderBy("key"))).filter("turn = 1")
    return result.union(several.select("doc.*"))
