import math
import re
from collections import Counter, defaultdict

import pytest

from fundlens.llm import kneser_ney as K

SCHEMA = "doc_id long, text string, lang string"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [None]


def brute(train, every):
    """The same model with dictionaries."""
    words, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        words.update(w)
        pairs.update(zip(["<start>", *w], w))
    n, v = sum(words.values()), len(words)
    of = lambda c: [sum(1 for x in c.values() if x == i) for i in (1, 2, 3, 4)]
    before = Counter(b for _, b in pairs)
    d2, d1 = K.discounts(*of(pairs)), K.discounts(*of(before))
    left = sum(d1[min(c, 3)] for c in before.values()) / sum(before.values()) if before else 1.0
    followers = defaultdict(list)
    for (a, _), c in pairs.items():
        followers[a].append(c)

    def word(w):
        c = before[w]
        return max(c - d1[min(c, 3)], 0) / max(sum(before.values()), 1) + left / (v + 1)

    def chance(a, b):
        c, own = pairs[a, b], followers.get(a, [])
        if not own:
            return word(b)
        spare = sum(d2[min(x, 3)] for x in own) / sum(own)
        return max(c - d2[min(c, 3)], 0) / sum(own) + spare * word(b)

    out = []
    for t in every:
        w = tokens(t)
        out.append((len(w), sum(1 for x in w if x in words), sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(chance(a, b)) for a, b in zip(["<start>", *w], w))))
    return n, out, chance, words


TEXTS = [
    "The cat sat on the mat", "the dog sat on the log", "A cat and a dog", "the the the the", "", None, "  \t\n ", "x", "mat mat", "the cat sat on the mat",
    "on and on and on", "é É über Über", "sat the cat", "log " * 300,
]


def test_equals_dictionaries(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], SCHEMA)
    n, expected, chance, words = brute(TEXTS[:9], TEXTS)
    model = K.train(docs.filter("doc_id < 9"))
    assert model.tokens == n and model.distinct == len(words)
    found = {r.doc_id: r for r in K.score(model, docs).collect()}
    for i, (size, known, base, score) in enumerate(expected):
        assert (found[i].n_tokens, found[i].n_known) == (size, known)
        assert found[i].base_score == pytest.approx(base, rel=1e-12)
        assert found[i].score == pytest.approx(score, rel=1e-9)
    for a in ("the", "<start>", "nowhere"):  # the chances of all words and the unknown one are 1
        assert sum(chance(a, b) for b in [*words, "unknown"]) == pytest.approx(1)


def test_empty_tables_null_keys_and_repeats(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(None, "a b", None), (1, "a b", None), (1, "a b", None)], SCHEMA)
    empty = K.train(none)
    assert empty.tokens == 0 and K.score(empty, none).count() == 0
    rows = K.score(empty, docs).collect()
    assert len(rows) == 3 and all(r.n_known == 0 and r.score == pytest.approx(0) for r in rows)
    assert [r.doc_id for r in K.score(K.train(docs), docs).collect()].count(1) == 2


def test_pairs_unmix(spark):
    import numpy as np

    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (K._unmix(K.mix(x)) == x).all()
