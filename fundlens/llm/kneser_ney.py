"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Three passes over blocks of numpy arrays, each shuffled as few rows of packed numbers:

1. words: tasks count word hashes and send one block per hash range; a range becomes a file of sorted hashes, and a
   word's number is its place in them;
2. pairs: tasks count pairs of numbers and send blocks per range of the mixed pair (a bijection, so pairs never
   collide); a range becomes files of sorted pair hashes and counts, and sends on what it adds to its first words
   (how often, with how many partners once, twice, more) and second words (how many different words precede);
3. these sums become one file per word range.

Files lie in the shared folder under names of their range, written beside and renamed, so that a repeated task
replaces its own file by an equal one. Scoring maps the files and reads only the pages it needs. Nothing but names
and totals comes to the driver. Ranges grow in number with the text, so their size is bounded.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Stage, arrow_rows, mix, small_batches, word_hashes

END = np.uint64(0x5B1C_3A77_90E4_D20F)  # the end of a text, a word of its own
RANGE_BYTES = 64 << 20
LEAST_RANGES = 64
FLUSH = 1 << 21


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int  # 2**bits ranges
    words: np.ndarray  # number of words before each range, and of all
    tokens: int
    pairs_discount: np.ndarray
    words_discount: np.ndarray
    preceding: int  # sum of the words' numbers of preceding words
    counts: tuple[int, int, int]  # words that 1, 2, more different words precede

    @property
    def distinct(self) -> int:
        return int(self.words[-1])


def _local(folder: str) -> str:
    return urlparse(folder).path


def _put(folder: str, name: str, array: np.ndarray) -> None:
    """Writes an array so that its file is whole or absent."""
    path = f"{_local(folder)}/{name}"
    part = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(part, "wb") as out:
        out.write(array.tobytes())
    os.replace(part, path)


class _Files:
    """Maps the files of a model, each when it is first needed."""

    def __init__(self, folder: str):
        self.folder, self.open = _local(folder), {}

    def __call__(self, name: str, dtype) -> np.ndarray:
        if name not in self.open:
            path = f"{self.folder}/{name}"
            self.open[name] = np.memmap(path, dtype=dtype, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, dtype)
        return self.open[name]


def _ranges(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(keys: np.ndarray, values: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """One row per range that the sorted keys reach."""
    at = np.searchsorted(_ranges(keys, bits), np.arange((1 << bits) + 1))
    used = np.flatnonzero(np.diff(at))
    cut = lambda x: pa.array([x[at[r] : at[r + 1]].tobytes() for r in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), cut(keys), *map(cut, values)], ["range", "keys", *(f"v{i}" for i in range(len(values)))])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    return keys, counts.astype(np.uint32)


def _tokens(texts) -> list[np.ndarray]:
    return [np.append(words, END) for _, words in word_hashes(texts)]


def _count_words(bits: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for words in _tokens(batch.column(0).to_pylist()):
                held.append(words)
                size += len(words)
            if size > FLUSH:
                keys, counts = _counted(held)
                yield _blocks(keys, [counts], bits)
                held, size = [], 0
        if held:
            keys, counts = _counted(held)
            yield _blocks(keys, [counts], bits)

    return run


def _column(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _store_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        keys, counts = _summed(_column(table, "keys", np.uint64), _column(table, "v0", np.uint32).astype(np.int64))
        _put(folder, f"words-{r}", keys)
        _put(folder, f"counts-{r}", counts)
        return pa.table({"range": [r], "words": [len(keys)], "tokens": [int(counts.sum())]}, schema=pa.schema([("range", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64())]))

    return run


class _Words:
    """Numbers of words: a word's place among the sorted hashes of all ranges; -1 if it is unknown."""

    def __init__(self, files: _Files, bits: int, before: np.ndarray):
        self.files, self.bits, self.before = files, bits, before

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """For sorted hashes."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        at = np.searchsorted(_ranges(hashes, self.bits), np.arange((1 << self.bits) + 1))
        for r in np.flatnonzero(np.diff(at)):
            part, known = hashes[at[r] : at[r + 1]], self.files(f"words-{r}", np.uint64)
            if len(known):
                place = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[at[r] : at[r + 1]] = np.where(known[place] == part, place + self.before[r], -1)
        return out

    def looked_up(self, name: str, dtype, numbers: np.ndarray) -> np.ndarray:
        """Values of a file of each range for sorted numbers."""
        out = np.zeros(len(numbers), dtype=dtype)
        at = np.searchsorted(numbers, self.before)
        for r in np.flatnonzero(np.diff(at)):
            out[at[r] : at[r + 1]] = self.files(f"{name}-{r}", dtype)[numbers[at[r] : at[r + 1]] - self.before[r]]
        return out


def _numbered(texts, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens of the texts, and how many each text has."""
    tokens = _tokens(texts)
    every = np.concatenate(tokens)
    distinct, place = np.unique(every, return_inverse=True)
    return words.numbers(distinct)[place], np.array([len(x) for x in tokens])


def _before(numbers: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The token before each; ``start`` at the beginning of a text."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[np.r_[0, np.cumsum(sizes)[:-1]]] = start
    return out


_BACK = pow(int(0xBF58476D1CE4E5B9), -1, 1 << 64), pow(int(0x94D049BB133111EB), -1, 1 << 64)


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = x.copy()
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(_BACK[1])
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(_BACK[0])
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))


def _count_pairs(folder: str, bits: int, before: np.ndarray):
    def run(batches):
        words = _Words(_Files(folder), bits, before)
        held, size = [], 0
        for batch in batches:
            if len(batch):
                numbers, sizes = _numbered(batch.column(0).to_pylist(), words)
                held.append(_pair(_before(numbers, sizes, int(before[-1])), numbers))
                size += len(numbers)
            if size > FLUSH:
                keys, counts = _counted(held)
                yield _blocks(keys, [counts], bits)
                held, size = [], 0
        if held:
            keys, counts = _counted(held)
            yield _blocks(keys, [counts], bits)

    return run


def _store_pairs(folder: str, bits: int, before: np.ndarray):
    """Files of a range of pairs; rows are what the range adds to words (kind 0: as the first, 1: as the second)
    by word range, and the range's counts of counts (kind 2)."""

    def rows(kind, numbers, columns):
        at = np.searchsorted(numbers, before)
        used = np.flatnonzero(np.diff(at))
        for r in used:
            part = np.vstack([numbers[at[r] : at[r + 1]] - before[r], *(c[at[r] : at[r + 1]] for c in columns)]).astype(np.int64)
            yield {"kind": kind, "range": int(r), "body": part.astype(np.uint32).tobytes() if part.max(initial=0) < 1 << 32 else b"wide" + part.tobytes()}

    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        keys, counts = _summed(_column(table, "keys", np.uint64), _column(table, "v0", np.uint32).astype(np.int64))
        _put(folder, f"pairs-{r}", keys)
        _put(folder, f"times-{r}", counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)
        both = _unmix(keys)
        first, second = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(first, kind="stable")
        f, c = first[order], counts[order]
        start = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        sums = [np.add.reduceat(x, start) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))]
        found = list(rows(0, np.minimum(f[start], before[-1]), sums)) if before[-1] else []
        begin = f[start] == before[-1]  # the start of a text has a range of its own
        if begin.any():
            found.append({"kind": 0, "range": len(before) - 1, "body": b"wide" + np.vstack([np.zeros(1, np.int64), *(s[begin] for s in sums)]).astype(np.int64).tobytes()})
        found += rows(1, *(lambda n, k: (n, [k]))(*np.unique(second, return_counts=True)))
        of = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
        found.append({"kind": 2, "range": r, "body": of.astype(np.int64).tobytes()})
        return pa.Table.from_pylist(found, schema=pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("body", pa.binary())]))

    return run


def _part(body: bytes, height: int) -> np.ndarray:
    wide = body[:4] == b"wide" and (len(body) - 4) % (8 * height) == 0
    return np.frombuffer(body[4:] if wide else body, np.int64 if wide else np.uint32).astype(np.int64).reshape(height, -1)


def _store_sums(folder: str, before: np.ndarray):
    """Files of a word range: per word how often it is first (total), its partners met once, twice, more, and how
    many words precede it. Returns the range's counts of counts of the last."""

    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        size = 1 if r == len(before) - 1 else int(before[r + 1] - before[r])
        first, preceding = np.zeros((4, size)), np.zeros(size)
        for kind, body in zip(table.column("kind").to_pylist(), table.column("body").to_pylist()):
            if kind == 0:
                part = _part(body, 5)
                for i in range(4):
                    first[i] += np.bincount(part[0], weights=part[i + 1], minlength=size)
            else:
                part = _part(body, 2)
                preceding += np.bincount(part[0], weights=part[1], minlength=size)
        for name, values in zip(("total", "once", "twice", "more"), first):
            _put(folder, f"{name}-{r}", values)
        _put(folder, f"preceding-{r}", preceding)
        of = np.bincount(np.minimum(preceding, 5).astype(int), minlength=6)
        out = {"c1": of[1], "c2": of[2], "c3": of[3], "c4": of[4], "words": int((preceding > 0).sum()), "total": int(preceding.sum())}
        return pa.table({k: pa.array([int(v)], pa.int64()) for k, v in out.items()})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The three discounts of counts 1, 2 and above from the numbers of counts 1 to 4; half a count where a number
    that they divide by is 0, and within 0 and the count in any case."""
    if min(n1, n2, n3) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(float(np.clip(d, 0.05, k - 0.05)) for d, k in zip(found, (1, 2, 3)))])


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all texts of docs (null: empty, a text of no words has its end only). An empty table gives a model
    that knows no words and scores every token alike."""
    spark = docs.sparkSession
    stage = Stage(spark, "kneser-ney")
    folder = f"{stage.folder}/files"
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError("the shared folder must be mounted on the workers: they map the model's files")
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(LEAST_RANGES, -(-size // RANGE_BYTES)) - 1).bit_length()
    with arrow_rows(spark, 1000):
        blocks = texts.mapInArrow(_count_words(bits), "range int, keys binary, v0 binary")
        rows = blocks.groupBy("range").applyInArrow(_store_words(folder), "range int, words long, tokens long").collect()
        sizes = np.zeros(1 << bits, dtype=np.int64)
        for row in rows:
            sizes[row.range] = row.words
        before = np.r_[0, np.cumsum(sizes)]
        if before[-1] >= (1 << 32) - 1:
            raise ValueError("more than 2**32 distinct words")
        pairs = texts.mapInArrow(_count_pairs(folder, bits, before), "range int, keys binary, v0 binary")
        sums = stage.write(pairs.groupBy("range").applyInArrow(_store_pairs(folder, bits, before), "kind int, range int, body binary"), "sums")
    of = np.sum([np.frombuffer(bytes(r.body), np.int64) for r in sums.filter("kind = 2").collect()], axis=0) if len(rows) else np.zeros(4)
    with arrow_rows(spark, 200):
        ends = sums.filter("kind < 2").groupBy("range").applyInArrow(_store_sums(folder, before), "c1 long, c2 long, c3 long, c4 long, words long, total long")
        c = ends.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("c1", "c2", "c3", "c4", "words", "total"))).first()
    stage.drop("sums")
    return Model(folder, bits, before, sum(r.tokens for r in rows), discounts(*map(int, of)), discounts(c.c1, c.c2, c.c3, c.c4), c.total, (c.c1, c.c2, c.words - c.c1 - c.c2))


def _score(model: Model):
    def run(batches):
        files = _Files(model.folder)
        words = _Words(files, model.bits, model.words)
        v, start = model.distinct, model.distinct
        base_of_unknown = -np.log10(model.tokens + (v + 1.0))
        d2, d1 = model.pairs_discount, model.words_discount
        left = float(np.dot(d1[1:], model.counts)) / model.preceding if model.preceding else 1.0
        begin = [float(files(f"{x}-{len(model.words) - 1}", np.float64).sum()) for x in ("total", "once", "twice", "more")]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if not texts:
                continue
            numbers, sizes = _numbered(texts, words)
            first = _before(numbers, sizes, start)
            known = np.unique(np.r_[numbers[numbers >= 0], first[(first >= 0) & (first < start)]])
            look = lambda name, dtype: words.looked_up(name, dtype, known)
            place, place1 = np.searchsorted(known, numbers), np.searchsorted(known, first)
            pad = lambda x, last=0.0: np.append(x, [last, 0.0])  # noqa: E731  the start of a text, unknown words
            place[numbers < 0], place1[first < 0], place1[first == start] = len(known) + 1, len(known) + 1, len(known)
            base = pad(np.log10(look("counts", np.int64) + 1.0) + base_of_unknown)
            base[-1] = base_of_unknown
            preceding = pad(look("preceding", np.float64))
            word = np.maximum(preceding - d1[np.minimum(preceding, 3).astype(int)], 0) / max(model.preceding, 1) + left / (v + 1)
            total, once, twice, more = (pad(look(x, np.float64), b) for x, b in zip(("total", "once", "twice", "more"), begin))
            spare = np.where(total > 0, (d2[1] * once + d2[2] * twice + d2[3] * more) / np.maximum(total, 1), 1.0)
            pairs, back = np.unique(_pair(np.maximum(first, 0), np.maximum(numbers, 0)), return_inverse=True)
            times = np.zeros(len(pairs))
            at = np.searchsorted(_ranges(pairs, model.bits), np.arange((1 << model.bits) + 1))
            for r in np.flatnonzero(np.diff(at)):
                part, keys = pairs[at[r] : at[r + 1]], files(f"pairs-{r}", np.uint64)
                if len(keys):
                    spot = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                    raw = files(f"times-{r}", np.uint32)
                    raw = raw if len(raw) == len(keys) else raw.view(np.int64)
                    times[at[r] : at[r + 1]] = np.where(keys[spot] == part, raw[spot], 0)
            seen = np.where((numbers >= 0) & (first >= 0), times[back], 0.0)
            chance = np.maximum(seen - d2[np.minimum(seen, 3).astype(int)], 0) / np.maximum(total[place1], 1) + spare[place1] * word[place]
            cut = np.r_[0, np.cumsum(sizes)[:-1]]
            total_of = lambda x: np.add.reduceat(x, cut)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes.astype(np.int64)), pa.array(total_of((numbers >= 0).astype(np.int64))), pa.array(total_of(base[place])), pa.array(total_of(np.log10(chance)))],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(model: Model, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, n_known, base_score, score): log10 probabilities of each whole text and its end under the
    smoothed word frequencies (base) and under the model. Null texts are empty; repeated rows keep a row each.
    10 ** (-score / n_tokens) is the perplexity."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("doc_id", key)


def perplexity(score: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / tokens)
