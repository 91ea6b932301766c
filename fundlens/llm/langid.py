"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. One binary classifier for each position of the code
(logistic regression over byte n-grams of a text's letters) predicts that bit. A text gets the language
whose codeword costs least: the logistic loss of each bit, weighted by how well its classifier did in
training. Two codewords of nearly the same cost mark the text as ambiguous.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import gram_codes, hash_sample, small_batches

SIZES = (1, 2, 3)
BITS = 13
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss, 1 on average


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords: all different splits of the languages up to seven of them, beyond that the random
    code, of some tried, whose nearest two words are farthest apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, dtype=float).T
    bits, rng = int(np.ceil(15 * np.log2(n))), np.random.default_rng(seed)
    tried = []
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        near = code @ code.T - 2 * bits * np.eye(n)
        tried.append((near.max(), len(tried), code))
    return min(tried)[2]


def _letters(text: str | None) -> np.ndarray:
    """The letters of the lower-cased text in UTF-8, one space for each run of anything else."""
    data = np.frombuffer(f" {(text or '').lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letter = _LETTER[data]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    return np.where(letter, data, 32).astype(np.uint8)[kept]


def features(text: str | None, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> np.ndarray:
    """Square roots of the n-gram counts, scaled to length 1."""
    counts = np.zeros(1 << bits)
    for codes in gram_codes(_letters(text), sizes, bits):
        counts += np.bincount(codes, minlength=1 << bits)
    root = np.sqrt(counts)
    return (root / max(np.sqrt(counts.sum()), 1.0)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_rows(x: np.ndarray, language: np.ndarray, n: int, steps: int = 150, rate: float = 0.1, penalty: float = 1e-6) -> tuple[np.ndarray, ...]:
    """Code, weights, bias and trust for rows of features and the number of each row's language. All bits
    are fitted at once; rows count inversely to how many their language has."""
    code = codewords(n)
    sign = code[language].astype(np.float32)
    size = np.bincount(language, minlength=n)
    share = (1.0 / (n * size[language])).astype(np.float32)[:, None]
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = sign * (x @ w)
        gradient = x.T @ (-sign * share / (1 + np.exp(np.clip(margin, -30, 30)))) + penalty * w
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    right = ((sign * (x @ w) > 0) * share).sum(axis=0)
    trust = np.maximum(2 * right - 1, 0.01)
    return code, w[:-1], w[-1], trust / trust.mean()


def fit_languages(rows: DataFrame, text: str, label: str, key: str, per_label: int = 600, most_rows: int = 4800) -> LanguageModel:
    """Trains on at most ``per_label`` rows of each language and ``most_rows`` in all, chosen by a hash of the key.

    Texts without a letter, and rows without label or key, do not train. One task fits the features that
    others have made; only the model comes to the driver.
    """
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(key).alias("k"), F.col(label).alias("y"), F.col(text).alias("t")).filter("y is not null and t is not null")
    n = rows.select("y").distinct().count()
    per_label = max(1, min(per_label, most_rows // max(n, 1)))
    sample = hash_sample(rows, "y", "k", per_label)

    def make(batches):
        for batch in batches:
            unit, y, t = (batch.column(x).to_pylist() for x in ("unit", "y", "t"))
            kept = [i for i, x in enumerate(t) if has_letter(x)]
            yield pa.RecordBatch.from_pydict({
                "unit": pa.array([unit[i] for i in kept], pa.float64()), "y": pa.array([y[i] for i in kept], pa.string()),
                "x": pa.array([features(t[i]).astype(np.float16).tobytes() for i in kept], pa.binary()),
            })

    def train(batches):
        rows = sorted(row for b in batches for row in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist()))
        kept = [x for _, group in itertools.groupby(rows, lambda r: r[0]) for x in itertools.islice(group, per_label)]
        names = sorted({r[0] for r in kept})
        if names:
            x = np.stack([np.frombuffer(r[2], np.float16) for r in kept]).astype(np.float32)
            parts = fit_rows(x, np.searchsorted(names, [r[0] for r in kept]), len(names))
            yield pa.RecordBatch.from_pydict({"names": pa.array([names], pa.list_(pa.string()))} | {
                f"p{i}": pa.array([np.asarray(p, dtype=np.float32).tobytes()], pa.binary()) for i, p in enumerate(parts)})

    row = (
        sample.mapInArrow(make, "unit double, y string, x binary").repartition(1)
        .mapInArrow(train, "names array<string>, p0 binary, p1 binary, p2 binary, p3 binary").collect()
    )
    if not row:
        return LanguageModel([], *(np.zeros((0, 0), np.float32) for _ in range(4)))
    names, parts = row[0].names, [np.frombuffer(bytes(row[0][f"p{i}"]), np.float32) for i in range(4)]
    return LanguageModel(list(names), parts[0].reshape(len(names), -1), parts[1].reshape(1 << BITS, -1), parts[2], parts[3])


def decode(model: LanguageModel, x: np.ndarray) -> np.ndarray:
    """Probability of each language for rows of features, from the weighted losses of its codeword."""
    margin = np.clip(x @ model.weights + model.bias, -30, 30)
    plus, minus = np.log1p(np.exp(-margin)) * model.trust, np.log1p(np.exp(margin)) * model.trust
    loss = plus @ (model.code.T > 0) + minus @ (model.code.T < 0)
    chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return chance / chance.sum(axis=1, keepdims=True)


def identify_language(model: LanguageModel, text: Column, margin: float = 0.1) -> Column:
    """Struct (lang, score, ambiguous). Null texts, texts without a letter and a model without languages give
    (und, 0.0, false). ``ambiguous``: the two nearest codewords differ by less than ``margin`` in probability.
    The language first in order wins a tie."""

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def identify(texts: pd.Series) -> pd.DataFrame:
        lang, score, near = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
        for at in range(0, len(known), 256):
            rows = known[at : at + 256]
            chance = decode(model, np.stack([features(texts.iloc[i]) for i in rows]))
            best = chance.argmax(axis=1)
            score[rows] = np.minimum(chance.max(axis=1), 1.0)
            if chance.shape[1] > 1:
                near[rows] = np.diff(np.sort(chance, axis=1)[:, -2:], axis=1)[:, 0] < margin
            for i, b in zip(rows, best):
                lang[i] = model.languages[b]
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": near})

    return identify(text)
