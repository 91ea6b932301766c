"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Which n-grams a text has (not how often) counts. Each n-gram bucket j has the ratio
r_j = log(share of toxic training texts with j / share of the others with j), smoothed; a logistic
regression is trained on the features r_j * [text has j], so that its penalty bears little on telling n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import gram_codes, hash_sample, small_batches

SIZES = (4, 5, 6)
BITS = 20
PER_LABEL = 3000


@dataclass(frozen=True)
class ToxicityModel:
    """Weights by n-gram bucket (the ratio is folded in); all other buckets weigh nothing."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS


def _characters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with one space for each run of white space and at both ends."""
    joined = " ".join((text or "").lower().split())
    return np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _present(text: str | None, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    found = [np.unique(codes) for codes in gram_codes(_characters(text), sizes, bits)]
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


def fit_rows(present: list[np.ndarray], toxic: np.ndarray, bits: int, least_ratio: float = 1.0, least_texts: int = 3,
             penalty: float = 1e-3, steps: int = 80, rate: float = 0.05) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, buckets and weights from the buckets that each training text has.

    Buckets whose ratio is near 0 or that few texts have are left at weight 0. With one class only,
    or none, there are no weights and the bias is the smoothed share of toxic texts.
    """
    n, ones = len(toxic), float(toxic.sum())
    bias = float(np.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return bias, np.zeros(0, np.int32), np.zeros(0)
    bucket = np.concatenate(present)
    row = np.repeat(np.arange(n), [len(x) for x in present])
    with_one = np.bincount(bucket[toxic[row] == 1], minlength=1 << bits) + 1.0
    with_zero = np.bincount(bucket[toxic[row] == 0], minlength=1 << bits) + 1.0
    ratio = np.log(with_one / (ones + 2)) - np.log(with_zero / (n - ones + 2))
    kept = np.flatnonzero((np.abs(ratio) >= least_ratio) & (with_one + with_zero - 2 >= least_texts))
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    column = place[bucket]
    row, column = row[column >= 0], column[column >= 0]
    value = ratio[kept][column]
    weight = np.zeros(len(kept) + 1)  # the last is the bias
    weight[-1] = bias
    mean, square = np.zeros_like(weight), np.zeros_like(weight)
    for step in range(1, steps + 1):  # full-batch Adam
        z = np.bincount(row, weights=value * weight[column], minlength=n) + weight[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic) / n
        gradient = np.append(np.bincount(column, weights=value * off[row], minlength=len(kept)) + penalty * weight[:-1], off.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weight -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return float(weight[-1]), kept.astype(np.int32), weight[:-1] * ratio[kept]


def fit_toxicity(rows: DataFrame, text: str, label: str, key: str, per_label: int = PER_LABEL, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> ToxicityModel:
    """Trains on at most ``per_label`` rows of label 1 and as many of label 0, chosen by a hash of the key.

    The features are made where the rows are; one task fits them, and only the weights come to the driver.
    Rows without label or key do not train; null texts count as empty. Repeated rows train as often as they occur.
    """
    small_batches(rows.sparkSession)
    sample = hash_sample(rows.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.col(text).alias("t")).filter("y in (0, 1)"), "y", "k", per_label)

    def features(batches):
        for batch in batches:
            unit, y, t = (batch.column(x).to_pylist() for x in ("unit", "y", "t"))
            found = [_present(x, sizes, bits).tobytes() for x in t]
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.float64()), pa.array(y, pa.int32()), pa.array(found, pa.binary())], ["unit", "y", "present"])

    def train(batches):
        rows = sorted(row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        rows = [x for y in (0, 1) for x in [r for r in rows if r[1] == y][:per_label]]
        bias, buckets, weights = fit_rows([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], dtype=float), bits)
        yield pa.RecordBatch.from_pydict({"bias": [bias], "buckets": pa.array([buckets.tobytes()], pa.binary()), "weights": pa.array([weights.tobytes()], pa.binary())})

    row = (
        sample.mapInArrow(features, "unit double, y int, present binary").repartition(1)
        .mapInArrow(train, "bias double, buckets binary, weights binary").collect()
    )
    if not row:
        return ToxicityModel(0.0, np.zeros(0, np.int32), np.zeros(0), sizes, bits)
    return ToxicityModel(row[0].bias, np.frombuffer(bytes(row[0].buckets), np.int32), np.frombuffer(bytes(row[0].weights)), sizes, bits)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Probability (0 to 1) that a text is toxic. Null and empty texts score what an empty text scores;
    the whole text counts, however long."""

    table: list[np.ndarray] = []

    def score(text: str | None) -> float:
        if not table:
            table.append(np.zeros(1 << model.bits, dtype=np.float32))
            table[0][model.buckets] = model.weights
        hit = [np.unique(codes[table[0][codes] != 0]) for codes in gram_codes(_characters(text), model.sizes, model.bits)]
        z = model.bias + float(table[0][np.unique(np.concatenate(hit))].sum(dtype=np.float64)) if hit else model.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return texts.map(score, na_action=None).astype(float)

    return scores(text)
