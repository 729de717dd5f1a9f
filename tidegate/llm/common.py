"""Helpers shared by the operators: reading batches, folds, byte-level words and fingerprints."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import tune

# rows handed to Python at once: bounds the memory of a task, not the work
ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS = "1000"
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# one random-looking 64-bit value per byte
_x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) ^ np.uint64(0x2545F4914F6CDD1D)
_x = (_x ^ (_x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
BYTE_CODE = _x ^ (_x >> np.uint64(29))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings every operator relies on."""
    tune(spark)
    # workers started from another folder find the package too; a cluster gets it with --py-files
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    # workers live on from stage to stage: what they free goes back to the system (one thread each, no pool of Arrow's own)
    spark.sparkContext.environment.update({"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1"})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and nothing else unless named."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


def fold(column: str = "doc_id"):
    """The crc32 of an id as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        _powers = tuple(
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums S with S[e] - S[s] depending on bytes s..e-1 and the offset s only."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of the bytes between two offsets, wherever they lie."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of lower-cased texts, one after another, and the first word of each text (n + 1)."""
    joined = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(joined.translate(LOWER), np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    first = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, first)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of n consecutive words and the text of each; a text of fewer words gives its whole sequence."""
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= n:
        acc = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            acc = mix(acc * np.uint64(3)) + h[k: len(h) - n + 1 + k]
        inside = doc[: len(h) - n + 1] == doc[n - 1:]
        out, owner = mix(acc[inside]), doc[: len(h) - n + 1][inside]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = count[short].astype(np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            at = first[:-1][short[has]] + k
            whole[has] = mix(whole[has] * np.uint64(5) + h[at])
        out, owner = np.concatenate([out, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def release() -> None:
    """Give freed memory back to the system: a worker lives on from stage to stage."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES):
    """Cut batches to runs of rows with about ``size`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]
        at, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > size:
                yield batch.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(t) + 1
        if at < len(texts):
            yield batch.slice(at), texts[at:]
    release()
