"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

On unit vectors the largest cosine is the smallest Euclidean distance, which is a metric: the side of a vantage point
can be skipped if the ball around the query that holds its best candidates does not reach over the border. The radius
of the ball is taken times ``factor``: 1 is exact search, less prunes more and may miss. Shards are dealt by hash, so
a family of equal vectors is spread; a shard keeps equal vectors once, with their smallest ids.

Vectors are kept divided by a power of two, so that their largest component is near 1: cosines stay the same to the last
bit, and the squares of very large or small components neither overflow nor vanish.

The trees are written once as an index. Queries go in blocks, and a block meets each shard as one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Stage, arrow_rows

LEAF = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 512
SLACK = 1e-7  # for rounding of distances; candidates are ranked by exact cosines afterwards


def _usable(vectors: list) -> list[int]:
    """Places of the vectors that take part: not null, without null or non-finite components, not all zero."""
    kept = []
    for i, v in enumerate(vectors):
        if v and None not in v:
            x = np.asarray(v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                kept.append(i)
    return kept


def scaled(vector) -> np.ndarray:
    """The vector over the power of two that brings its largest component to 0.5 or more, below 1."""
    x = np.asarray(vector, dtype=np.float64) + 0.0  # -0.0 becomes 0.0, so that equal vectors have equal bytes
    return np.ldexp(x, -np.frexp(np.abs(x).max())[1])


def cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines in double precision of ``scaled`` vectors; equal vectors give equal numbers, whatever else is in ``many``."""
    return (many * one).sum(axis=1) / (np.sqrt((many * many).sum(axis=1)) * np.sqrt((one * one).sum()))


class Tree:
    """Vectors in the order of the leaves, and per node: vantage point, median distance, children or leaf span."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, float, int, int, int, int]] = []  # vantage, border, inner, outer, begin, end
        rng = np.random.default_rng(seed)
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                v, b, inner, outer, x, y = self.nodes[parent]
                self.nodes[parent] = (v, b, here if side == 0 else inner, here if side else outer, x, y)
            span = self.order[begin:end]
            if len(span) <= LEAF:
                self.nodes.append((-1, 0.0, -1, -1, begin, end))
                continue
            vantage = int(span[rng.integers(len(span))])
            away = np.sqrt(np.maximum(2 - 2 * (vectors[span] @ vectors[vantage]), 0))
            by = np.argsort(away, kind="stable")
            self.order[begin:end] = span[by]
            middle = len(span) // 2
            self.nodes.append((vantage, float(away[by[middle]]), -1, -1, begin, end))
            todo += [(begin, begin + middle, here, 0), (begin + middle, end, here, 1)]

    def search(self, vectors: np.ndarray, queries: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query the places of all vectors that may be among its k nearest."""
        worst = np.full(len(queries), np.inf)  # distance of the k-th best so far
        best = np.full((len(queries), k), np.inf)
        found: list[list[np.ndarray]] = [[] for _ in queries]
        todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            at, rows, gap = todo.pop()
            rows = rows[gap <= factor * worst[rows] + SLACK]
            if not len(rows):
                continue
            vantage, border, inner, outer, begin, end = self.nodes[at]
            if vantage < 0:
                span = self.order[begin:end]
                away = np.sqrt(np.maximum(2 - 2 * (queries[rows] @ vectors[span].T), 0))
                best[rows] = np.sort(np.hstack([best[rows], np.sort(away, axis=1)[:, :k]]), axis=1)[:, :k]
                worst[rows] = best[rows, -1]
                for i, row in enumerate(rows):
                    if (near := away[i] <= worst[row] + SLACK).any():
                        found[row].append(np.column_stack([span[near], away[i][near]]))
                continue
            away = np.sqrt(np.maximum(2 - 2 * (queries[rows] @ vectors[vantage]), 0))
            inside = away < border
            # The nearer side first (last on the stack), so that the other side is tried with a small ball.
            for near, far, mask in ((inner, outer, inside), (outer, inner, ~inside)):
                if mask.any():
                    todo.append((far, rows[mask], np.abs(away[mask] - border)))
                    todo.append((near, rows[mask], np.zeros(mask.sum())))
        out = []
        for row, parts in enumerate(found):
            every = np.vstack(parts) if parts else np.zeros((0, 2))
            out.append(every[every[:, 1] <= worst[row] + SLACK, 0].astype(int))
        return out


def _pack(batches):
    """Per row with a usable vector: id, number of components, the components as 64-bit bytes."""
    for batch in batches:
        ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        kept = _usable(vectors)
        raw = [scaled(vectors[i]) for i in kept]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in kept], pa.int64()), pa.array([len(x) for x in raw], pa.int32()), pa.array([x.tobytes() for x in raw], pa.binary())], ["vec_id", "dim", "raw"])


def _index(k: int):
    """The index row of a shard: distinct vectors, the smallest k + 1 ids of each, and the tree."""

    def run(table: pa.Table) -> pa.Table:
        dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
        ids = table.column("vec_id").to_numpy(zero_copy_only=False)
        raw = np.array(table.column("raw").to_pylist(), dtype=object)
        order = np.argsort(ids, kind="stable")
        places: dict[bytes, list[int]] = {}
        for i in order:
            own = places.setdefault(raw[i], [])
            if not own or own[-1] != ids[i]:  # a repeated row is one candidate
                own.append(int(ids[i]))
        vectors = np.frombuffer(b"".join(places), np.float64).reshape(len(places), dim)
        repeats = int(np.unique(np.concatenate([*places.values()]), return_counts=True)[1].max())
        kept = np.full((len(places), k + 1), -1, dtype=np.int64)
        count = np.zeros(len(places), dtype=np.int64)
        for i, own in enumerate(places.values()):
            own = own[: k + 1]
            kept[i, : len(own)], count[i] = own, len(own)
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        tree = Tree(unit)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "vectors": pa.array([vectors.tobytes()], pa.binary()), "ids": pa.array([kept.tobytes()], pa.binary()),
            "count": pa.array([count.tobytes()], pa.binary()), "k": pa.array([k], pa.int32()), "repeats": pa.array([repeats], pa.int32()), "places": pa.array([tree.order.tobytes()], pa.binary()), "nodes": pa.array([np.array(tree.nodes, dtype=np.float64).tobytes()], pa.binary()),
        })

    return run


INDEX = "dim int, shard int, vectors binary, ids binary, count binary, k int, repeats int, places binary, nodes binary"


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard. Every usable vector is in it; vectors of different lengths are in different shards. Of equal
    vectors a shard names the k + 1 smallest ids, so the index answers for up to k neighbours. Rows that repeat id and
    vector count once; an id with different vectors is in the index with each of them."""
    packed = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter("vec_id IS NOT NULL").mapInArrow(_pack, "vec_id long, dim int, raw binary")
    shards = int(max(1, -(-vectors.count() // shard_rows)))
    dealt = packed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return Stage(vectors.sparkSession, "vp-tree").write(dealt.groupBy("dim", "shard").applyInArrow(_index(k), INDEX), "index")


def _search(k: int, factor: float):
    """Per row (index of a shard, block of queries): the block's best k of the shard, ranked exactly."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                dim = r["dim"]
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(-1, dim)
                ids, count = np.frombuffer(r["ids"], np.int64).reshape(len(vectors), -1), np.frombuffer(r["count"], np.int64)
                tree = Tree.__new__(Tree)
                tree.order = np.frombuffer(r["places"], np.int64)
                tree.nodes = [(int(a), b, int(c), int(d), int(e), int(f)) for a, b, c, d, e, f in np.frombuffer(r["nodes"], np.float64).reshape(-1, 6)]
                asked, raw = np.array(r["queries"], dtype=np.int64), np.frombuffer(b"".join(r["raws"]), np.float64).reshape(-1, dim)
                unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                sought = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                # More than k, as the vectors of the query's own id may be among them.
                for q, mark, one, near in zip(asked, r["marks"], raw, tree.search(unit, sought, k + r["repeats"], factor)):
                    score = np.repeat(cosines(one, vectors[near]), count[near])
                    own = np.concatenate([ids[i, : count[i]] for i in near]) if len(near) else np.zeros(0, np.int64)
                    other = own != q
                    order = np.lexsort((own[other], -score[other]))[:k]
                    out += zip([int(q)] * len(order), [mark] * len(order), own[other][order].tolist(), score[other][order].tolist())
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, types)], ["query_id", "mark", "vec_id", "score"])

    return run


def nearest(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, factor: float = 1.0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest of each query but itself, largest cosine first, ties to the
    smaller id. Queries without a usable vector or id have none; a query that repeats is asked once. An id that is asked with
    different vectors has a list for each of them; rows of the query's own id are never its neighbours, and another id
    with different vectors is named for each of them that is near.

    Vectors of which more than k + 1 are equal are covered by the smallest ids, as ties go to them. An index that was
    built for a smaller k is refused with a ValueError, since it may lack ids.
    """
    spark = index.sparkSession
    if (built := index.agg(F.min("k").alias("k")).first().k) is not None and k > built:
        raise ValueError(f"the index was built for k = {built}; build it with k = {k} or more")
    asked = queries.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).filter("vec_id IS NOT NULL").mapInArrow(_pack, "vec_id long, dim int, raw binary").dropDuplicates(["vec_id", "raw"])
    blocks = int(max(1, -(-queries.count() // BLOCK_ROWS)))
    asked = asked.withColumn("mark", F.xxhash64("raw")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "mark", "raw")).alias("q")).select("dim", "block", F.col("q.vec_id").alias("queries"), F.col("q.mark").alias("marks"), F.col("q.raw").alias("raws"))
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shard"))
    sent = asked.join(shards, "dim").withColumn("shard", F.explode("shard"))
    stage = Stage(spark, "vp-search")
    with arrow_rows(spark, 1):
        found = stage.write(sent.join(index, ["dim", "shard"]).mapInArrow(_search(k, factor), "query_id long, mark long, vec_id long, score double"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
