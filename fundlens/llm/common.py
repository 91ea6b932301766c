"""Helpers that the operators of this package share: staged tables, splits, byte n-grams, word hashes."""

from __future__ import annotations

import contextlib
import gc
import hashlib
import os
import pathlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reachable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, besides their own path: a session that was
    started elsewhere need not have it in PYTHONPATH. On a cluster the package is installed or added as ever."""
    root, known = str(pathlib.Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    folders = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in folders:
        known["PYTHONPATH"] = os.pathsep.join([*folders, root])


# ---- staged tables ----------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named (local mode, tests), a new folder is named once."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("a cluster needs a folder that all its machines see: set spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="fundlens-llm-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Stage:
    """A folder of one run in the shared folder. ``write`` stores a table and scans it back, which
    cuts its lineage: after a lost executor only the work behind the last stored table is repeated."""

    def __init__(self, spark: SparkSession, name: str):
        reachable(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes a table of this run, or all of it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are stored: it does so when the driver has collected
    the frames that made them, which may otherwise be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch for the jobs that run inside; long texts need small batches."""
    reachable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For results that run later: whole texts go to Python in batches of so many rows."""
    reachable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def hash_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """Little more than ``per_label`` rows of each label: those with the smallest hash of the key, which
    column ``unit`` (0 to 1) holds. The labels are counted first, so the sample needs no sort of all rows.
    Rows without label or key are left out."""
    rows = rows.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    rows = rows.withColumn("unit", (F.xxhash64(F.lit("sample"), F.col(key)) / F.lit(float(1 << 63)) + 1) / 2)
    share = F.lit(0.0)
    for value, n in rows.groupBy(label).count().collect():
        share = F.when(F.col(label) == F.lit(value), F.lit((1.3 * per_label + 20) / n)).otherwise(share)
    return rows.filter(F.col("unit") <= share)


# ---- bytes and words ---------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWER = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_SPAN = 1 << 20
_LONG_WORD = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class _Tables:
    def __init__(self):
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(_SPAN + _LONG_WORD, _POWER, dtype=np.uint64)])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(_SPAN + _LONG_WORD, pow(_POWER, -1, 1 << 64), dtype=np.uint64)])


_tables: _Tables | None = None


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of byte codes times powers."""
    global _tables
    if _tables is None:
        _tables = _Tables()
    out = np.empty(len(starts), dtype=np.uint64)
    long = ends - starts > _LONG_WORD
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(starts, starts[at] + _SPAN, "left"))
        base, last = int(starts[at]), int(min(ends[to - 1], starts[to - 1] + _LONG_WORD))
        sums = np.zeros(last - base + 1, dtype=np.uint64)
        np.cumsum(_tables.byte[data[base:last]] * _tables.up[: last - base], out=sums[1:])
        s, e = starts[at:to] - base, np.minimum(ends[at:to], last) - base
        out[at:to] = mix((sums[e] - sums[s]) * _tables.down[s] + (e - s).astype(np.uint64) * _MUL)
        at = to
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(texts: Iterable[str | None], chunk: int = 1 << 21) -> Iterator[tuple[int, np.ndarray]]:
    """For groups of texts: how many texts, and the hashes of their words with the count of each text.

    Yields (index of text, hashes of its words): words are runs of characters other than white space
    (0x20, 0x09-0x0D), A-Z lower-cased. Texts are joined to blocks of ``chunk`` bytes, so that the
    work is done in few array operations.
    """
    group: list[bytes] = []
    first, held = 0, 0
    at = -1
    for at, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if group and held + len(raw) > chunk:
            yield from _group_hashes(group, first)
            group, first, held = [], at, 0
        group.append(raw)
        held += len(raw) + 1
    if group:
        yield from _group_hashes(group, first)


def _group_hashes(group: list[bytes], first: int) -> Iterator[tuple[int, np.ndarray]]:
    data = _LOWER[np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    hashes = _hash_spans(data, starts, ends)
    stops = np.cumsum([len(x) + 1 for x in group])
    cut = np.searchsorted(starts, stops)
    begin = 0
    for i, end in enumerate(cut):
        yield first + i, hashes[begin:end]
        begin = end


# ---- character n-grams ---------------------------------------------------------


_BASE = np.uint64(0xA0761D6478BD642F)


def gram_codes(data: np.ndarray, sizes: tuple[int, ...], bits: int, span: int = 1 << 19) -> Iterator[np.ndarray]:
    """Buckets (of 2**bits) of all n-grams of the sizes in bytes or code points, with repeats, for ``span`` start positions at a time."""
    shift, most = np.uint64(64 - bits), max(sizes)
    for begin in range(0, len(data), span):
        wide = data[begin : begin + span + most - 1].astype(np.uint64) + np.uint64(1)
        code = np.zeros(len(wide), dtype=np.uint64)
        for n in range(1, min(most, len(wide)) + 1):
            code = code[: len(wide) - n + 1] * _BASE + wide[n - 1 :]
            if n in sizes:
                seed = np.uint64(n * int(_MUL) % (1 << 64))
                yield (((code[:span] + seed) * _MUL) >> shift).astype(np.int64)
