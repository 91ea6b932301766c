"""Linked vectors against all pairs: trees alone, then tables over one and many shards and cells."""

import numpy as np

from fundlens.llm import cover_tree as C


def families(rng, n, dim, groups, noise):
    base = rng.normal(size=(groups, dim))
    return base[rng.integers(groups, size=n)] + rng.normal(size=(n, dim)) * noise


def test_walks_equal_all_pairs():
    rng = np.random.default_rng(0)
    for trial in range(30):
        n, dim, threshold = int(rng.integers(1, 500)), int(rng.choice([2, 3, 8, 64])), float(rng.choice([0.5, 0.9, 0.99, 1.0]))
        x = families(rng, n, dim, max(1, n // int(rng.integers(1, 40))), rng.choice([0.0, 0.01, 0.1, 0.3]))
        y = np.vstack([families(rng, n // 2 + 1, dim, 3, 0.1), x[: n // 3]])
        one, two = (C.CoverTree(v, rng.integers(1, 5, len(v))) for v in (x, y))
        for tree in (one, two):
            assert all((low[: len(up)] == up).all() for up, low in zip(tree.places, tree.places[1:]))  # nested
            assert all(radius.max() <= 2 * C.RADII[i] + 1e-3 for i, radius in enumerate(tree.radius) if i < len(C.RADII))
        cos = np.array([[float(C.cosine(a[None], b[None])[0]) for b in y] for a in x]) if n < 40 else (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        if threshold == 1.0 or (np.abs(cos - threshold) < 1e-12).any():
            continue  # rounding decides
        found = C.walk(one, two, threshold).spread()
        assert (found[0] == (cos >= threshold) @ two.count).all() and (found[1] == one.count @ (cos >= threshold)).all()
        links = C.walk(one, one, threshold)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, True)
        assert (links.spread()[0] == near @ one.count).all()
        label = np.arange(n)
        while (low := np.where(near, label, n).min(axis=1)).tolist() != label.tolist():
            label = low
        assert len(set(zip(links.label.tolist(), label.tolist()))) == len(set(label.tolist())) == len(set(links.label.tolist()))


def test_scaling_keeps_extremes():
    assert all(C.scaled(v) is None for v in (None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0]))
    big, small = C.scaled([1e300, 1e300]), C.scaled([1e-310, 1e-310])
    assert abs(C.cosine(big[None], small[None])[0] - 1) < 1e-12


def expected(rows, threshold=0.9):
    usable = [(i, C.scaled(v)) for i, (_, v) in enumerate(rows) if C.scaled(v) is not None]
    links, label = [0] * len(rows), list(range(len(rows)))
    pairs = []
    for a, (i, x) in enumerate(usable):
        for j, y in usable[a + 1 :]:
            if len(x) == len(y) and C.cosine(x[None], y[None])[0] >= threshold:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (key, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None)
        least = least if links[i] else key
        out.append((key, links[i], least, least == key))
    return sorted(out, key=repr)


def linked(spark, rows, kind="double", **more):
    table = spark.createDataFrame([(*r, 1, "own") for r in rows], f"vec_id long, embedding array<{kind}>, node int, dim string").repartition(6)
    return sorted((tuple(r) for r in C.linked_vectors(table, **more).collect()), key=repr)


def test_linked_vectors_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(families(rng, 150, 6, 12, 0.12))]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [(300, [2 * x for x in rows[7][1]])]  # a hot vector
    rows += [(400, None), (401, []), (402, [0.0] * 6), (403, [1.0, None]), (404, [float("nan")] * 6), (405, [float("inf"), 1.0]), (None, None)]
    rows += [(500, [1e200, 1e200]), (501, [1e200, 1.0]), (502, [1e-200, 1e-200]), (503, [3.0]), (504, [-3.0]), (505, [4.0])]
    rows += [(5, rows[20][1]), (5, rows[5][1]), (None, rows[9][1]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 1.0, 0.0])]
    want = expected(rows)
    assert linked(spark, rows) == want
    assert linked(spark, rows, shard_rows=8) == want  # many cells and shards
    assert linked(spark, [], shard_rows=8) == [] and linked(spark, rows[211:218]) == expected(rows[211:218])


def test_cells_far_apart_are_left_out():
    rng = np.random.default_rng(5)
    pivots = {4: C._unit(rng.normal(size=(9, 4)))}
    cells = [type("Cell", (), {"dim": 4, "cell": i, "n": 10 + 100 * (i == 3), "away": 0.1}) for i in range(9)]
    shards, pairs = C._near_cells(cells, pivots, 0.99, 20)
    near = np.linalg.norm(pivots[4][:, None] - pivots[4], axis=2) <= np.sqrt(0.02) + 0.2 + 1e-6
    assert sum(n for *_, n in shards) == 8 + 6 and len(pairs) == np.triu(near).sum() < 45
