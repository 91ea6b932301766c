"""Links between all vectors of cosine at or above a threshold, by dual traversal of cover trees.

On unit vectors a cosine of at least t is a Euclidean distance of at most sqrt(2 - 2t), so links are close pairs in a
metric. A cover tree holds nested levels of centres with halving radii: the centres of a level lie more than its radius
apart, every vector is within that radius of one, and each centre stays one on all levels below. Two trees are walked
together from their roots. A pair of nodes is dropped if their distance exceeds the threshold by more than both covering
radii (the largest distances to anything below them); it is taken whole, without looking below, if the distance and
both radii together stay under it; else the children meet. What is left at the bottom is compared by cosine.

Equal vectors are one node with a count. Nodes are dealt to cells around pivots (a bounded sample), and large cells are
cut into shards of bounded size; a shard is one tree. Pairs of cells too far apart for any link are left out by the same
bound; a task holds the tree of its own shard and streams the others past it. For two shards it gives a row for each
vector that has links: their number, and another vector of its component. So however many pairs of a family link, they
are counted and never listed. Components follow by rounds of joins.

Trees prune as far as the data has structure. Vectors that are all about as far from each other as from any pivot
(random ones in many dimensions) leave no cell out, and every shard then meets every other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Stage, arrow_rows, reachable
from .ngram_join import components

SHARD_ROWS = 8192
MOST_CELLS = 1024
SALTS = 64
PRODUCTS = 1 << 21  # in memory at once
RADII = tuple(2.0 / 2**i for i in range(6))  # of the levels; below the last come the vectors themselves


def scaled(vector) -> np.ndarray | None:
    """The vector as 64-bit numbers, its largest component 1 in size; None if it cannot link: null, empty, zero, or
    with null or non-finite components. Scaling first keeps squares from overflow and underflow."""
    if not vector or None in vector:
        return None
    x = np.asarray(vector, dtype=np.float64)
    most = np.abs(x).max()
    if not np.isfinite(most) or not most:
        return None
    # By a power of two, which rounds nothing.
    return np.ldexp(x, -int(np.frexp(most)[1]))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


class CoverTree:
    """Scaled ``vectors`` and the rows that have each, and per level: places of the centres, the centre above each (by
    its position on the level above), the largest distance below it, rows below it, and whether it is alone there."""

    def __init__(self, vectors: np.ndarray, count: np.ndarray, levels=None):
        self.vectors, self.count = vectors, count
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        self.unit, self.rough = unit, unit.astype(np.float32)
        self.slack = max(1e-5, 1.2e-7 * vectors.shape[1])  # more than 32-bit products of unit vectors can be wrong by
        self.places, self.above = levels or self._levels()
        self._measure()

    def _levels(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        everything = np.arange(len(self.vectors))
        places, above = [everything[:1]], [np.zeros(1, dtype=np.int64)]
        best = self.rough @ self.rough[0]  # of each vector, the largest product with a centre
        for radius in RADII[1:]:
            self._add(places, above, self._centres(best, radius))
            if len(places[-1]) == len(everything):
                break
        if len(places[-1]) < len(everything):
            self._add(places, above, np.setdiff1d(everything, places[-1], assume_unique=True))
        return places, above

    def _add(self, places: list[np.ndarray], above: list[np.ndarray], new: np.ndarray) -> None:
        """The next level: the centres of the last one, each its own, and the new ones below their nearest."""
        last = places[-1]
        above.append(np.r_[np.arange(len(last)), self._nearest(new, last)])
        places.append(np.r_[last, new])

    def _centres(self, best: np.ndarray, radius: float) -> np.ndarray:
        """More centres, until all vectors are within the radius of one; each is farther than it from all others.
        ``best`` is kept up to date."""
        near = 1 - radius * radius / 2  # the product at that distance
        out = [np.zeros(0, dtype=np.int64)]
        free = np.flatnonzero(best < near)
        while len(free):
            some = free[:256]
            close = self.rough[some] @ self.rough[some].T >= near
            taken: list[int] = []
            covered = np.zeros(len(some), dtype=bool)
            for i in range(len(some)):
                if not covered[i]:
                    taken.append(i)
                    covered |= close[i]
            new = some[taken]
            out.append(new)
            np.maximum(best, (self.rough @ self.rough[new].T).max(axis=1), out=best)
            best[new] = 1
            free = free[256:][best[free[256:]] < near]
        return np.concatenate(out)

    def _nearest(self, below: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Position of the nearest centre for each place."""
        out = np.empty(len(below), dtype=np.int64)
        step = max(1, PRODUCTS // len(centres))
        for at in range(0, len(below), step):
            out[at : at + step] = (self.rough[below[at : at + step]] @ self.rough[centres].T).argmax(axis=1)
        return out

    def _measure(self) -> None:
        bottom = len(self.places) - 1
        low = self.places[bottom]
        self.radius = [np.zeros(len(p)) for p in self.places]
        self.rows = [np.zeros(len(p), dtype=np.int64) for p in self.places]
        self.rows[bottom] = self.count[low]
        self.single = [np.ones(len(p), dtype=bool) for p in self.places]
        own = np.arange(len(low))  # for each vector its centre on the level at hand
        for level in range(bottom - 1, -1, -1):
            own = self.above[level + 1][own]
            centre = self.unit[self.places[level][own]]
            away = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", self.unit[low], centre), 0))
            np.maximum.at(self.radius[level], own, away)
            np.add.at(self.rows[level], own, self.count[low])
            self.single[level] = np.bincount(own, minlength=len(self.places[level])) == 1
        self.children = []  # per level but the last: positions below in the order of their centres, and the ends
        for level in range(bottom):
            order = np.argsort(self.above[level + 1], kind="stable")
            self.children.append((order, np.searchsorted(self.above[level + 1][order], np.arange(len(self.places[level]) + 1))))

    def at(self, level: int) -> int:
        return min(level, len(self.places) - 1)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Positions on level + 1 of the children of nodes; behind the last level the nodes themselves."""
        if level >= len(self.children):
            return nodes
        order, ends = self.children[level]
        sizes = ends[nodes + 1] - ends[nodes]
        first = np.repeat(ends[nodes] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        return order[first + np.arange(sizes.sum())]


class Links:
    """What a walk finds: linked rows of each vector of both trees, and the components of both together. A pair of
    nodes that is taken whole is noted at the nodes and spread to what lies below them at the end."""

    def __init__(self, one: CoverTree, two: CoverTree):
        self.trees = (one, two)
        self.whole = [[np.zeros(len(p), dtype=np.int64) for p in t.places] for t in self.trees]
        self.joined = [[np.zeros(len(p), dtype=bool) for p in t.places] for t in self.trees]
        self.shift = 0 if one is two else len(one.vectors)  # places of the second tree follow those of the first
        self.label = np.arange(len(one.vectors) + (0 if one is two else len(two.vectors)))

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            a, b = self.label[x], self.label[y]
            differ = a != b
            x, y, a, b = x[differ], y[differ], a[differ], b[differ]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def take(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        """All below node a[i] links with all below node b[i]."""
        (one, two), la, lb = self.trees, self.trees[0].at(level), self.trees[1].at(level)
        np.add.at(self.whole[0][la], a, two.rows[lb][b])
        other = a != b if one is two else np.ones(len(a), dtype=bool)
        np.add.at(self.whole[1][lb], b[other], one.rows[la][a[other]])
        self.joined[0][la][a] = True
        self.joined[1][lb][b] = True
        self.unite(one.places[la][a], two.places[lb][b] + self.shift)

    def spread(self) -> list[np.ndarray]:
        """Linked rows of each vector of the first and of the second tree; of one tree with itself both are the same,
        and a vector's own rows are among them."""
        out = []
        for tree, whole, joined, shift in zip(self.trees, self.whole, self.joined, (0, self.shift)):
            for level in range(1, len(tree.places)):
                above = tree.above[level]
                whole[level] += whole[level - 1][above]
                low = joined[level - 1][above]
                joined[level] |= low
                self.unite(tree.places[level][low] + shift, tree.places[level - 1][above[low]] + shift)
            found = np.zeros(len(tree.vectors), dtype=np.int64)
            found[tree.places[-1]] = whole[-1]
            out.append(found)
        return [out[0] + out[1]] * 2 if self.trees[0] is self.trees[1] else out


def walk(one: CoverTree, two: CoverTree, threshold: float) -> Links:
    """The dual traversal, level by level, of two trees or of one with itself (each pair once, and nodes with
    themselves). Distances are bounded by 32-bit products and their error; what is near the threshold is worked
    out in double precision."""
    links, same = Links(one, two), one is two
    reach, slack = float(np.sqrt(max(2 - 2 * threshold, 0))), max(one.slack, two.slack)

    def met(level: int, x: np.ndarray, y: np.ndarray, twice: bool):
        """Pairs of nodes x and y of a level that need a look below. ``twice``: each pair comes in both orders."""
        la, lb = one.at(level), two.at(level)
        product = one.rough[one.places[la][x]] @ two.rough[two.places[lb][y]].T
        ra, rb = one.radius[la][x], two.radius[lb][y]
        least = 1 - (reach + ra) ** 2 / 2 - slack
        near = product >= least[:, None]
        if len(wide := np.flatnonzero(rb > 0)):
            near[:, wide] = product[:, wide] >= 1 - (reach + ra[:, None] + rb[wide]) ** 2 / 2 - slack
        i, j = np.nonzero(near)
        if twice:
            i, j = i[(first := x[i] <= y[j])], j[first]
        a, b, p, radii = x[i], y[j], product[i, j], ra[i] + rb[j]
        ends = one.single[la][a] & two.single[lb][b]
        linked = np.where(ends, p >= threshold + slack, (radii < reach) & (p >= 1 - np.maximum(reach - radii, 0) ** 2 / 2 + slack))
        if same:
            linked |= ends & (a == b)
        close = np.flatnonzero(ends & ~linked & (p >= threshold - slack))
        for at in range(0, len(close), 4096):
            some = close[at : at + 4096]
            linked[some] = cosine(one.vectors[one.places[la][a[some]]], two.vectors[two.places[lb][b[some]]]) >= threshold
        links.take(level, a[linked], b[linked])
        deeper = ~linked & ~ends
        return a[deeper], b[deeper]

    def lower(level: int, own: np.ndarray, others: np.ndarray, swapped: bool):
        """All children of one node against those of the nodes it meets, some products at a time."""
        wide = PRODUCTS // 64
        for left in range(0, len(others), wide):
            right = others[left : left + wide]
            step = max(1, PRODUCTS // len(right))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                yield met(level, right, some, False) if swapped else met(level, some, right, False)

    root = np.zeros(1, dtype=np.int64)
    pairs = [met(0, root, root, same)]
    for level in range(1, max(len(one.places), len(two.places))):
        a, b = (np.concatenate(x) if pairs else root[:0] for x in (list(zip(*pairs)) or ((), ())))
        pairs = []
        if same:
            for node in a[a == b]:
                own = one.below(level - 1, np.array([node]))
                step = max(1, PRODUCTS // len(own))
                for at in range(0, len(own), step):  # positions ascend, so what comes before was met already
                    pairs.append(met(level, own[at : at + step], own[at:], True))
            a, b = a[a != b], b[a != b]
        # Grouped by the nodes that have children below; they are few, so the products are large.
        fat = ~one.single[one.at(level - 1)][a]
        for left, right, mine, its, swapped in ((a[fat], b[fat], one, two, False), (b[~fat], a[~fat], two, one, True)):
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            nodes, starts = np.unique(left, return_index=True)
            for node, begin, end in zip(nodes, starts, np.r_[starts[1:], len(left)]):
                pairs += lower(level, mine.below(level - 1, np.array([node])), its.below(level - 1, right[begin:end]), swapped)
    return links


# ---- tasks ----------------------------------------------------------------------


def _pack(batches):
    """Per row: key, number of components and the scaled vector as bytes; null bytes for a vector that cannot link."""
    for batch in batches:
        dims, raws = [], []
        for v in batch.column(1).to_pylist():
            x = scaled(v)
            dims.append(None if x is None else len(x))
            raws.append(None if x is None else x.astype(np.float32).tobytes() if (x.astype(np.float32) == x).all() else x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], ["key", "dim", "raw"])


def _unpacked(raws: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in raws], dtype=np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _celled(pivots: dict[int, np.ndarray]):
    """Per node the cell of its nearest pivot and the distance to it; vectors of a length without pivots have cell 0."""

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist())
            cells, away = np.zeros(len(dims), dtype=np.int32), np.full(len(dims), 2.0)
            raws = batch.column("raw").to_pylist()
            for dim in set(dims.tolist()) & pivots.keys():
                at = np.flatnonzero(dims == dim)
                product = _unit(_unpacked([raws[i] for i in at], dim)) @ pivots[dim].T
                cells[at] = product.argmax(axis=1)
                away[at] = np.sqrt(np.maximum(2 - 2 * product.max(axis=1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return run


INDEX = "shard long, dim int, vectors binary, double boolean, counts binary, nodes binary, levels array<binary>"


def _index(table: pa.Table) -> pa.Table:
    """The tree of a shard as one row."""
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    vectors = _unpacked([table.column("raw")[int(i)].as_py() for i in order], dim)
    tree = CoverTree(vectors, table.column("n").to_numpy()[order])
    wide = not (vectors.astype(np.float32) == vectors).all()
    levels = [x.astype(np.int32).tobytes() for pair in zip(tree.places, tree.above) for x in pair]
    return pa.table({
        "shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32()), "vectors": pa.array([vectors.astype(np.float64 if wide else np.float32).tobytes()], pa.binary()), "double": pa.array([wide]),
        "counts": pa.array([tree.count.astype(np.int64).tobytes()], pa.binary()), "nodes": pa.array([nodes[order].tobytes()], pa.binary()), "levels": pa.array([levels], pa.list_(pa.binary())),
    })


def _tree(row: dict) -> tuple[CoverTree, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64 if row["double"] else np.float32).astype(np.float64).reshape(-1, row["dim"])
    levels = [np.frombuffer(x, np.int32).astype(np.int64) for x in row["levels"]]
    return CoverTree(vectors, np.frombuffer(row["counts"], np.int64), (levels[0::2], levels[1::2])), np.frombuffer(row["nodes"], np.int64)


def _walked(threshold: float):
    """Per vector that has links, for its shard and another: node, number of linked rows, a node of its component.
    Rows of a partition are sorted, each home shard first, then its visitors."""

    def run(batches):
        home = None
        for batch in batches:
            for row in batch.to_pylist():
                tree, nodes = _tree(row)
                if row["visits"] == 0:
                    home, home_nodes = tree, nodes
                    links = walk(home, home, threshold)
                    found = [(nodes, links.spread()[0] - home.count)]
                else:
                    links = walk(home, tree, threshold)
                    found = list(zip((home_nodes, nodes), links.spread()))
                every = np.concatenate([x for x, _ in found])
                counts, roots = np.concatenate([n for _, n in found]), every[links.label]
                some = (counts > 0) | (roots != every)
                yield pa.RecordBatch.from_arrays([pa.array(every[some]), pa.array(counts[some]), pa.array(roots[some])], ["node", "links", "root"])

    return run


# ---- the join ---------------------------------------------------------------------


def _pivots(vectors: DataFrame, packed: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Unit vectors around which the cells of each length lie: of lengths with more rows than a shard, one for so many
    rows, at most MOST_CELLS, those of the smallest hashes."""
    sizes = {r.dim: r["count"] for r in vectors.groupBy(F.size("v").alias("dim")).count().collect() if r.dim and r.dim > 0 and r["count"] > shard_rows}
    if not sizes:
        return {}
    wanted = {dim: min(MOST_CELLS, n // shard_rows + 1) for dim, n in sizes.items()}
    share = F.lit(0.0)
    for dim, n in sizes.items():
        share = F.when(F.col("dim") == dim, F.lit((2 * wanted[dim] + 50) / n)).otherwise(share)
    unit = F.col("node") / F.lit(float(1 << 64)) + 0.5
    sample = packed.filter((F.col("raw").isNotNull()) & (unit <= share)).groupBy("dim", "raw").agg(F.min("node").alias("node")).orderBy("dim", "node").collect()
    out: dict[int, np.ndarray] = {}
    for dim, most in wanted.items():
        raws = [bytes(r.raw) for r in sample if r.dim == dim][:most]
        if len(raws) > 1:
            out[dim] = _unit(_unpacked(raws, dim))
    return out


def _near_cells(cells: list, pivots: dict[int, np.ndarray], threshold: float, shard_rows: int) -> tuple[list[tuple], list[tuple]]:
    """Shards of each cell (dim, cell, first shard, shards), and pairs of cells that links can join (first shard and
    number of shards of both). A table of at most MOST_CELLS cells of each length."""
    reach, shards, pairs, first = float(np.sqrt(max(2 - 2 * threshold, 0))), [], [], 0
    for dim in sorted({c.dim for c in cells}):
        own = [c for c in cells if c.dim == dim]
        sizes = [1 if c.n <= 2 * shard_rows else -(-c.n // shard_rows) for c in own]
        starts = (first + np.cumsum([0, *sizes[:-1]])).tolist()
        first += sum(sizes)
        shards += [(dim, c.cell, at, n) for c, at, n in zip(own, starts, sizes)]
        if dim in pivots:
            centres, radii = pivots[dim][[c.cell for c in own]], np.array([c.away for c in own])
            near = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)) <= reach + radii[:, None] + radii + 1e-6
        else:
            near = np.ones((len(own), len(own)), dtype=bool)
        pairs += [(starts[i], sizes[i], starts[j], sizes[j]) for i, j in zip(*np.nonzero(np.triu(near)))]
    return shards, pairs


def _with_values(rows: DataFrame, values: DataFrame, on: str, salt) -> DataFrame:
    """Left join that spreads the rows of one key: values go to the pairs of key and salt that there are."""
    salted = rows.withColumn("salt", salt)
    placed = salted.select(on, "salt").distinct().join(values, on)
    return salted.join(placed, [on, "salt"], "left").drop("salt")


def linked_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of the table: key, n_links (other rows of cosine >= threshold), component_id (the smallest key
    that links reach, its own included) and kept (whether that is its own key).

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing: no links, their own
    key, kept. Vectors of different lengths do not link. Rows with equal vectors, or one a power of two times the other,
    are one node that counts each. Rows that repeat a key are rows of their own. A null key is a component's
    only if no member has one; such a row is kept if it is alone with it. An empty table gives no rows; other columns
    are not looked at. Nodes go by 64-bit hashes of their vectors.
    """
    spark = vectors.sparkSession
    reachable(spark)
    stage = Stage(spark, "cover-tree")
    kind = vectors.schema[key].dataType.simpleString()
    narrow = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    with arrow_rows(spark, 5000):
        packed = narrow.mapInArrow(_pack, f"key {kind}, dim int, raw binary").withColumn("node", F.when(F.col("raw").isNotNull(), F.xxhash64("raw")))
        pivots = _pivots(narrow, packed, shard_rows)
        nodes = packed.filter("raw IS NOT NULL").groupBy("dim", "raw").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.min("key").alias("low"))
        nodes = stage.write(nodes.mapInArrow(_celled(pivots), f"dim int, raw binary, node long, n long, low {kind}, cell int, away double"), "nodes")
        rows = stage.write(packed.select("key", "node"), "rows")
    cells = nodes.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).orderBy("dim", "cell").collect()
    shards, pairs = _near_cells(cells, pivots, threshold, shard_rows)
    dealt = nodes.join(spark.createDataFrame(shards, "dim int, cell int, first long, shards long"), ["dim", "cell"])
    dealt = dealt.withColumn("shard", F.col("first") + F.pmod("node", "shards"))
    index = stage.write(dealt.select("shard", "dim", "raw", "node", "n").groupBy("shard").applyInArrow(_index, INDEX), "index")
    met = spark.createDataFrame(pairs, "a0 long, an long, b0 long, bn long")
    met = met.select("b0", "bn", "a0", F.explode(F.expr("sequence(a0, a0 + an - 1)")).alias("a")).select("a", F.explode(F.expr("sequence(if(b0 = a0, a, b0), b0 + bn - 1)")).alias("b"))
    even = (F.col("a") + F.col("b")) % 2 == 0  # so that homes have about as many visitors each
    met = met.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("shard"))
    sent = met.join(index, "shard").withColumn("visits", (F.col("home") != F.col("shard")).cast("int"))
    homes = max(1, sum(n for *_, n in shards))
    with arrow_rows(spark, 1):
        walked = sent.repartition(homes, "home").sortWithinPartitions("home", "visits", "shard").mapInArrow(_walked(threshold), "node long, links long, root long")
        links = stage.write(walked, "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(stage, links.select(F.col("node").alias("a"), F.col("root").alias("b")), "roots")
    placed = nodes.select("node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    salt = F.pmod("node", F.lit(SALTS))
    lowest = placed.groupBy("root").agg(F.min("low").alias("least"))
    components_of = _with_values(placed, lowest, "root", salt).select("node", "least")
    found = nodes.select("node", "n", "low").join(counts, "node", "left").join(components_of, "node", "left")
    found = found.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "low").alias("least"))
    result = _with_values(rows, found, "node", F.pmod(F.xxhash64("key", F.spark_partition_id()), F.lit(SALTS)))
    own = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("least"))
    result = stage.write(result.select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), own.eqNullSafe(F.col("key")).alias("kept")), "result")
    for name in ("nodes", "rows", "index", "links"):
        stage.drop(name)
    return result
