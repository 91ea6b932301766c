"""Held-out accuracy on the given tables, and the edge cases of both classifiers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.llm import langid, queries, toxicity

DIR = "/root/testdata/sf0.1"


def test_codewords_differ_widely():
    assert langid.codewords(0).shape[0] == 0 and langid.codewords(1).shape == (1, 1)
    for n in (2, 3, 4, 7, 12):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= code.shape[1] // 4 and len(code) == n


def test_language_of_held_out_documents(spark):
    docs = queries.table(spark, DIR, "documents")
    found = queries.QUERIES["op1_language_id"][0](spark, DIR).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n, low, high = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 3000 and right > 0.99 and 0 <= low and high <= 1


def test_language_edge_cases(spark):
    rows = [(i, t, lang) for i in range(8) for t, lang in (("der die und nicht " * 3, "de"), ("the and of with " * 3, "en"))]
    train = spark.createDataFrame([(10 * i + (lang == "en"), t, lang) for i, t, lang in rows] + [(None, "the", "en"), (500, None, "en"), (501, "the", None)], "k long, t string, lang string")
    model = langid.fit_languages(train, "t", "lang", "k")
    assert model.languages == ["de", "en"]
    asked = spark.createDataFrame([("und nicht die",), ("THE and OF!!",), (None,), ("",), ("123 %% !",), ("the " * 200_000,), ("the and",), ("the and",)], "t string")
    found = asked.withColumn("score", F.lit("own")).withColumn("f", langid.identify_language(model, F.col("t"))).collect()
    assert [r.f.lang for r in found] == ["de", "en", "und", "und", "und", "en", "en", "en"]
    assert found[2].f.score == 0 and found[0].score == "own" and found[6].f == found[7].f
    none = langid.fit_languages(train.limit(0), "t", "lang", "k")
    assert {r.f.lang for r in asked.select(langid.identify_language(none, F.col("t")).alias("f")).collect()} == {"und"}
    one = langid.fit_languages(train.filter("lang = 'de'"), "t", "lang", "k")
    assert asked.select(langid.identify_language(one, F.col("t")).alias("f")).first().f.lang == "de"


def test_long_texts_count_whole():
    text = "wörter und worte " * 60_000
    short = langid.features("wörter und worte " * 1000)
    assert np.abs(langid.features(text) - short).max() < 0.01
    assert set(toxicity._present(text, (4,), 20)) >= set(toxicity._present("wörter und worte und", (4,), 20)) - set(toxicity._present("te und ", (4,), 20))


def test_toxicity_of_held_out_documents(spark):
    labels = queries.table(spark, DIR, "labels")
    found = queries.QUERIES["op4_toxicity"][0](spark, DIR).join(labels, "doc_id").filter("held_out")
    rates = {r.toxic: r.p for r in found.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.75 and rates[0] < 0.02


def test_toxicity_edge_cases(spark):
    rows = [(i, ("you awful creature " if i % 2 else "a pleasant day ") + f"number {i}", i % 2) for i in range(60)]
    rows += [(None, "awful", 1), (900, None, 0), (901, "awful", None), (902, "", 0)]
    train = spark.createDataFrame(rows, "k long, t string, y int")
    model = toxicity.fit_toxicity(train, "t", "y", "k")
    asked = spark.createDataFrame([("what an AWFUL creature",), ("a pleasant day",), (None,), ("",), ("fine " * 300_000 + "awful creature",)], "t string")
    score = [r.s for r in asked.select(toxicity.toxicity_score(model, F.col("t")).alias("s")).collect()]
    assert score[0] > 0.5 > score[1] and score[2] == score[3] and score[4] > 0.5
    for part, expected in (("y = 9", 0.5), ("y = 0", None)):
        model = toxicity.fit_toxicity(train.filter(part), "t", "y", "k")
        score = [r.s for r in asked.select(toxicity.toxicity_score(model, F.col("t")).alias("s")).collect()]
        assert len(set(score)) == 1 and (expected is None or score[0] == pytest.approx(expected)) and 0 <= score[0] <= 1


# ---- plain versions --------------------------------------------------------------------


def plain_bucket(values, bits):
    """Bucket of one n-gram, with whole numbers of Python."""
    code = 0
    for v in values:
        code = (code * 0xA0761D6478BD642F + v + 1) % 2**64
    return ((code + len(values) * 0x9E3779B97F4A7C15) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def plain_grams(values, sizes, bits):
    return [plain_bucket(values[i : i + n], bits) for n in sizes for i in range(len(values) - n + 1)]


def plain_language(model, text):
    """(language, score): nearest codeword by the trusted losses, one n-gram and one bit after the other."""
    raw = f" {(text or '').lower()} ".encode()
    kept = bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in raw)
    while b"  " in kept:
        kept = kept.replace(b"  ", b" ")
    counts = {}
    for g in plain_grams(list(kept), langid.SIZES, langid.BITS):
        counts[g] = counts.get(g, 0) + 1
    total = sum(counts.values())
    losses = []
    for word in model.code:
        loss = 0.0
        for bit, sign in enumerate(word):
            margin = model.bias[bit] + sum((n / total) ** 0.5 * float(model.weights[g, bit]) for g, n in counts.items())
            loss += float(model.trust[bit]) * math.log1p(math.exp(-float(sign) * margin))
        losses.append(loss)
    best = losses.index(min(losses))
    return model.languages[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_languages_equal_the_plain_decoding(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang")
    model = queries.language_model(docs)
    found = {r.doc_id: r for r in queries.QUERIES["op1_language_id"][0](spark, "/root/testdata/sf0.001").collect()}
    texts = [r for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert len(found) == docs.count()
    for r in texts[:: max(1, len(texts) // 25)]:  # the plain version takes a while
        lang, score = plain_language(model, r.text)
        assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == (lang, pytest.approx(score, abs=1e-3))


def plain_toxicity(rows, sizes, bits, least_ratio=1.0, least_texts=3, penalty=1e-3, steps=80, rate=0.05):
    """(bias, {bucket: weight}) of (set of buckets, label) rows, with dictionaries."""
    n, ones = len(rows), sum(y for _, y in rows)
    ratios = {}
    for g in set().union(*(s for s, _ in rows)):
        a, b = (sum(g in s for s, y in rows if y == label) for label in (1, 0))
        r = math.log((a + 1) / (ones + 2)) - math.log((b + 1) / (n - ones + 2))
        if abs(r) >= least_ratio and a + b >= least_texts:
            ratios[g] = r
    weight = dict.fromkeys(ratios, 0.0) | {"bias": math.log((ones + 1) / (n - ones + 1))}
    mean, square = dict.fromkeys(weight, 0.0), dict.fromkeys(weight, 0.0)
    for step in range(1, steps + 1):
        gradient = {g: penalty * w for g, w in weight.items()} | {"bias": 0.0}
        for s, y in rows:
            hit = [g for g in s if g in ratios]
            off = (1 / (1 + math.exp(-weight["bias"] - sum(ratios[g] * weight[g] for g in hit))) - y) / n
            gradient["bias"] += off
            for g in hit:
                gradient[g] += ratios[g] * off
        for g, d in gradient.items():
            mean[g] = 0.9 * mean[g] + 0.1 * d
            square[g] = 0.99 * square[g] + 0.01 * d * d
            weight[g] -= rate * (mean[g] / (1 - 0.9**step)) / ((square[g] / (1 - 0.99**step)) ** 0.5 + 1e-8)
    return weight["bias"], {g: weight[g] * ratios[g] for g in ratios}


def test_toxicity_equals_the_plain_fit(spark):
    words = "you awful stupid day rain sun pleasant creature walk garden".split()
    rows = [(i, " ".join(words[(i * k) % (5 if i % 3 == 0 else 10)] for k in range(1, 7)), int(i % 3 == 0)) for i in range(60)] + [(99, "", 0), (98, None, 1)]
    train = spark.createDataFrame(rows, "k long, t string, y int")
    model = toxicity.fit_toxicity(train, "t", "y", "k")

    def grams(text):
        joined = " ".join((text or "").lower().split())
        return set(plain_grams([ord(c) for c in f" {joined} "], toxicity.SIZES, toxicity.BITS))

    bias, weights = plain_toxicity([(grams(t), y) for _, t, y in rows], toxicity.SIZES, toxicity.BITS)
    assert set(model.buckets.tolist()) == set(weights) and model.bias == pytest.approx(bias, abs=1e-6)
    assert dict(zip(model.buckets.tolist(), model.weights.tolist())) == pytest.approx(weights, abs=1e-6)
    for r in train.withColumn("s", toxicity.toxicity_score(model, F.col("t"))).collect():
        z = bias + sum(weights.get(g, 0.0) for g in grams(r.t))
        assert r.s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
