"""Ranked search against a plain count of every item and document."""

import math
import random
import re
from collections import Counter

import numpy as np

from fundlens.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(items, docs, k):
    found = [(key, Counter(plain_terms(text))) for key, text in docs]
    n = sum(bool(c) for _, c in found)
    length = sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        hits = []
        for key, c in found:
            score = 0
            for t in set(plain_terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * c.total() * n // length)))
            if score > 0:
                hits.append((-score, key is None, key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


def ranked(spark, items, docs, **more):
    items = spark.createDataFrame([(*x, 1, "own") for x in items], "item_id long, text string, doc_id int, item string")
    docs = spark.createDataFrame([(*x, 2, "own") for x in docs], "doc_id long, text string, item_id int, part string").repartition(5)
    return sorted((tuple(r) for r in search.ranked_search(items, docs, **more).collect()), key=repr)


def test_terms():
    for text in (None, "", " ", "Ab1-c_d É☺x\x7fÀy \ud800z", "ÄÖ ABC D", "\x00a\x80b"):
        assert [t.decode("utf-8", "surrogatepass") for t in search.terms(text)] == plain_terms(text)


def test_the_graph_stands_for_the_queries():
    rng = random.Random(4)
    words = [f"w{i}".encode() for i in range(60)]
    for n in (0, 1, 2, 12, 40):
        sets = [set(rng.sample(words, rng.choice([0, 1, 5, 30]))) | set(words[: rng.choice([0, 8])]) for _ in range(n)]
        graph = search.share(sets)
        assert [graph.terms_of(i) for i in range(n)] == sets
        assert all(a < graph.atoms + i and b < graph.atoms + i for i, (a, b) in enumerate(graph.pairs))
        listed = [pair for own in graph.queries for pair in set(zip(own, own[1:]))]
        assert len(listed) == len(set(listed))  # nothing that two queries share is left
    equal = search.share([{b"a", b"b", b"c"}] * 5)
    assert equal.atoms == 1 and equal.pairs == [] and equal.queries == [[0]] * 5
    shared = search.share([{b"a", b"b", b"x"}, {b"a", b"b", b"y"}, {b"a", b"z"}])
    assert len(shared.pairs) == 1 and sum(map(len, shared.queries)) == 6


def test_search_equals_a_plain_count(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"{'éÉaB'[i % 4]}w{i}" for i in range(40)]

    def said(n):
        return rng.choice([" ", "-", "\n"]).join(words[min(int(rng.expovariate(0.12)), 39)] for _ in range(n))

    items = [(i, said(rng.randint(1, 25))) for i in range(15)] + [(15, None), (16, ""), (17, "nowhere 2"), (3, "AW0 aw4"), (None, said(6)), (18, ".,;")]
    items.append((19, " ".join(f"x{i}" for i in range(2 * search.SLICE))))  # sums of several slices
    docs = [(i, said(rng.randint(0, 60))) for i in range(150)] + [(7, "aw4 bw3"), (7, "aw4 bw3"), (200, None), (None, said(30)), (None, "aw4 bw3"), (201, "aw4 " * 30000), (202, "x1 x4096 x8000"), (203, "x8000 x8000")]
    docs += [(300 + i, "aw4 aw8 cw2") for i in range(60)]  # ties beyond the limit
    want = plain(items, docs, 10)
    assert ranked(spark, items, docs, k=10) == want
    assert ranked(spark, items, docs) == plain(items, docs, 50)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 4)  # several blocks
    assert ranked(spark, items, docs, k=10) == want


def test_best_documents_keep_ties():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 5, 4000)
    docs = rng.permutation(4000).tolist()
    best = search._Best(7)
    for at in range(0, 4000, 300):
        best.offer(scores[at : at + 300], docs[at : at + 300])
    assert [(-s, d) for s, _, d in best.cut()] == [(s, d) for s, d in sorted(zip(scores.tolist(), docs), key=lambda x: (-x[0], x[1]))[:7]]


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, "a")], [(1, None), (2, "..")]) == []
