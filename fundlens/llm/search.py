"""Ranked lexical search of many queries at once, with what they have in common worked out once.

Queries are sets of terms. What two queries share is mined in two steps. Terms that stand in the same queries are one
atom. Each query then is a list of atoms, those of most queries first, and the neighbours that occur together in the
lists of at least two queries become a new node, round by round, until no two neighbours are shared. So the queries
share a graph: atoms below, sums of two nodes above them, and a query is the sum of the few nodes left in its list.

Documents are read once: their length and the counts of the terms that any query has are stored (ids and counts of
terms, a fraction of the text). Then a task fills the accumulators of the atoms for a block of documents, adds
up the inner nodes in the order of the graph, each once, and takes every query's sum from its nodes. It keeps only the k
best of each query, so no pair of document and query leaves a task but those.

Scores are 64-bit integers. Queries go in blocks of bounded size, so the plan that the driver holds is bounded.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Stage, arrow_rows, reachable

BLOCK_ITEMS = 2000
BLOCK_CHARS = 2_000_000
SLICE = 4096
CELLS = 1 << 22  # accumulators in memory at once

# Letters, digits and all that is not ASCII are parts of terms; only A-Z are lower-cased.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


# ---- the graph that queries share ----------------------------------------------


class Sharing(NamedTuple):
    """``atom`` of each term; inner nodes as pairs of earlier nodes; the nodes of each query. Atoms come first."""

    vocabulary: list[bytes]
    atom: np.ndarray
    atoms: int
    pairs: list[tuple[int, int]]
    queries: list[list[int]]

    def terms_of(self, query: int) -> set[bytes]:
        """The terms that a query's nodes stand for."""
        todo, found = list(self.queries[query]), set()
        while todo:
            node = todo.pop()
            if node < self.atoms:
                found.add(node)
            else:
                todo += self.pairs[node - self.atoms]
        return {t for t, a in zip(self.vocabulary, self.atom) if a in found}


def share(sets: list[set[bytes]]) -> Sharing:
    """Mines the shared term sets of the queries and builds their graph."""
    holders: dict[bytes, list[int]] = {}
    for i, own in enumerate(sets):
        for t in own:
            holders.setdefault(t, []).append(i)
    vocabulary = sorted(holders)
    signatures: dict[tuple[int, ...], int] = {}
    atom = np.array([signatures.setdefault(tuple(holders[t]), len(signatures)) for t in vocabulary], dtype=np.int64)
    lists: list[list[int]] = [[] for _ in sets]
    for items, number in sorted(signatures.items(), key=lambda x: (-len(x[0]), x[0])):
        for i in items:
            lists[i].append(number)
    atoms, pairs = len(signatures), []
    while True:
        held = Counter(pair for own in lists for pair in set(zip(own, own[1:])))
        shared = {pair for pair, n in held.items() if n > 1}
        if not shared:
            return Sharing(vocabulary, atom, atoms, pairs, lists)
        # Where shared pairs overlap, the one of more queries is taken first; the rest is for the next round.
        rank = {pair: i for i, pair in enumerate(sorted(shared, key=lambda p: (-held[p], p)))}
        numbers: dict[tuple[int, int], int] = {}
        for i, own in enumerate(lists):
            taken: set[int] = set()
            for at in sorted((at for at in range(len(own) - 1) if (own[at], own[at + 1]) in rank), key=lambda at: (rank[own[at], own[at + 1]], at)):
                if at not in taken and at + 1 not in taken:
                    taken |= {at, at + 1}
                    pair = (own[at], own[at + 1])
                    if pair not in numbers:
                        numbers[pair] = atoms + len(pairs)
                        pairs.append(pair)
                    own[at], own[at + 1] = -1 - numbers[pair], None
            lists[i] = [x if x >= 0 else -1 - x for x in own if x is not None]


# ---- counts ----------------------------------------------------------------------


def _count(vocabulary: list[bytes]):
    """Per document its length in terms, and ids and counts of the terms that queries have. At the end of a task, in
    slices (``part``, ``sums``), the vector of its sums: documents with terms, their length, document frequencies."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches):
        sums = np.zeros(2 + len(number), dtype=np.int64)
        for batch in batches:
            sizes, ids, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                sizes.append(len(found))
                own = sorted((number[t], n) for t, n in Counter(found).items() if t in number)
                ids.append(np.array([x for x, _ in own], dtype=np.int32))
                counts.append(np.array([x for _, x in own], dtype=np.int32))
                sums[2 + ids[-1]] += 1
                sums[:2] += bool(found), len(found)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["doc", "n", "ids", "counts", "part", "sums"])
        if sums[0]:
            slices = _slices(sums)
            n, none = len(slices), pa.nulls(len(slices), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, batch.column(0).type), pa.nulls(n, pa.int64()), none, none, pa.array(range(n), pa.int32()), pa.array(slices, pa.binary())], ["doc", "n", "ids", "counts", "part", "sums"])

    return run


def _slices(vector: np.ndarray) -> list[bytes]:
    return [vector[at : at + SLICE].tobytes() for at in range(0, len(vector), SLICE)]


def _added(batches):
    """Slices of the same number added up."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(raw, np.int64)
            held[part] = held[part] + own if part in held else own
    if held:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int32()), "sums": pa.array([x.tobytes() for x in held.values()], pa.binary())})


# ---- scores ----------------------------------------------------------------------


class _Best:
    """The k best documents of a query that a task has met: scores and documents, cut back now and then."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.held: list[tuple[int, int, object]] = []

    def offer(self, scores: np.ndarray, docs: list) -> None:
        hits = np.flatnonzero(scores >= max(self.least, 1))
        if len(hits) > 4 * self.k:  # all that tie with the k-th best stay
            hits = hits[scores[hits] >= np.partition(scores[hits], -self.k)[-self.k]]
        for at in hits:
            doc = docs[at]
            self.held.append((-int(scores[at]), doc is None, doc))
        if len(self.held) > 8 * self.k:
            self.cut()

    def cut(self) -> list:
        self.held.sort(key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))
        del self.held[self.k :]
        if len(self.held) == self.k:
            self.least = -self.held[-1][0]
        return self.held


def _score(graph: Sharing, weights: np.ndarray, documents: int, length: int, k: int, kind: pa.DataType):
    nodes = graph.atoms + len(graph.pairs)
    rows = max(1, CELLS // max(nodes, 1))
    atom = graph.atom

    def accumulators(sizes: list[int], ids: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Node by document: what each node's terms add to the score of each document."""
        out = np.zeros((nodes, len(sizes)), dtype=np.int64)
        which = np.repeat(np.arange(len(sizes)), [len(x) for x in ids])
        term, tf = np.concatenate(ids), np.concatenate(counts).astype(np.int64)
        measure = np.array([50 + 50 * n * documents // length for n in sizes], dtype=np.int64)
        np.add.at(out, (atom[term], which), weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * measure[which])))
        for i, (a, b) in enumerate(graph.pairs, graph.atoms):
            np.add(out[a], out[b], out=out[i])
        return out

    def run(batches):
        best = [_Best(k) for _ in graph.queries]
        for batch in batches:
            docs, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, counts = ([np.frombuffer(x, np.int32) for x in batch.column(i).to_pylist()] for i in (2, 3))
            for at in range(0, len(docs), rows):
                cut = slice(at, at + rows)
                sums = accumulators(sizes[cut], ids[cut], counts[cut])
                for own, keep in zip(graph.queries, best):
                    if own:
                        keep.offer(sums[own].sum(axis=0) if len(own) > 1 else sums[own[0]], docs[cut])
        out = [(i, doc, -score) for i, keep in enumerate(best) for score, _, doc in keep.cut()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), kind, pa.int64()))], ["item", "doc", "score"])

    return run


def _blocks(items: DataFrame, key: str, text: str):
    """Blocks of queries (key, distinct terms), bounded in number and length; a very long query is a block."""
    block, chars = [], 0
    for row in items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or chars + len(row.text or "") > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.key, set(terms(row.text))))
        chars += len(row.text or "")
    if block:
        yield block


def ranked_search(items: DataFrame, docs: DataFrame, k: int = 50, item_key: str = "item_id", item_text: str = "text", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k documents of highest score of each item, ties to the smaller key.

    A document scores, over the distinct terms of an item that it holds, w * ((10**9 * tf) div (1000 * tf + 20 * m)):
    w is floor(1000 * ln((2N + 2) / (2df + 1))), m is 50 + (50 * n * N) div L; N documents have terms, L terms in all,
    df of them hold the term, n terms are in this one. Scores of 0 are no hits.

    Null and empty texts have no terms: such items find nothing, such documents are not found. Rows that repeat a key
    are items or documents of their own; null keys are kept, a null document key comes last among equal scores. Very
    long texts are counted whole. An empty table gives no rows. Columns other than the named ones are not looked at.

    Each block of items (at most 2,000, or 2 million characters) reads the documents once more.
    """
    spark = docs.sparkSession
    reachable(spark)
    stage = Stage(spark, "search")
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    texts = docs.select(F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    counted = f"doc {kind.simpleString()}, n long, ids binary, counts binary, part int, sums binary"
    found = None
    for turn, block in enumerate(_blocks(items, item_key, item_text)):
        graph = share([own for _, own in block])
        with arrow_rows(spark, 500):
            rows = stage.write(texts.mapInArrow(_count(graph.vocabulary), counted), f"counts-{turn}")
            sums = rows.filter("part IS NOT NULL").select("part", "sums").mapInArrow(_added, "part int, sums binary")
            sums = sums.repartition("part").mapInArrow(_added, "part int, sums binary").collect()
        if not sums:
            continue
        documents, length, *frequency = np.concatenate([np.frombuffer(r.sums, np.int64) for r in sorted(sums)]).tolist()
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency], dtype=np.int64)
        with arrow_rows(spark, 2000):
            hits = rows.filter("part IS NULL AND octet_length(ids) > 0").select("doc", "n", "ids", "counts").mapInArrow(
                _score(graph, weights, documents, length, k, _arrow_type(kind)), f"item int, doc {kind.simpleString()}, score long")
            hits = stage.write(hits, f"hits-{turn}")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
        named = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"item int, name {item_kind.simpleString()}")
        best = hits.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(named), "item").select(F.col("name").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
        found = stage.write(best, f"best-{turn}") if found is None else found.union(stage.write(best, f"best-{turn}"))
        stage.drop(f"counts-{turn}")
        stage.drop(f"hits-{turn}")
    if found is None:
        return spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {kind.simpleString()}, score long")
    return found


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
