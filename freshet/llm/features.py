"""Hashed byte n-gram counts of whole texts, and bounded labelled samples to fit models on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, mix

#: Rows that are turned into vectors at a time: short texts need memory by rows, not by bytes.
VECTORS = 512


def shapes(data: np.ndarray) -> np.ndarray:
    """Bytes with letters down to 'a' or 'A', digits to '0'; bytes of other than ASCII characters count as 'a'."""
    table = np.arange(256, dtype=np.uint8)
    table[97:123], table[65:91], table[48:58], table[128:] = 97, 65, 48, 97
    return table[data]


def ngram_counts(data: np.ndarray, offsets: np.ndarray, n: int, dims: int, salt: int = 0) -> np.ndarray:
    """(rows, dims) counts of the n-grams of bytes, hashed into dims (a power of two) bins; none crosses rows."""
    rows = len(offsets) - 1
    if len(data) < n:
        return np.zeros((rows, dims), np.float32)
    code = data[: len(data) - n + 1].astype(np.uint64)
    for i in range(1, n):
        code = (code << np.uint64(8)) | data[i : len(data) - n + 1 + i]
    bins = (mix(code + np.uint64(salt)) >> np.uint64(40)).astype(np.int64) & (dims - 1)
    row = np.repeat(np.arange(rows), np.diff(offsets))[: len(code)]
    whole = np.arange(len(code)) + n <= offsets[row + 1]
    return np.bincount(row[whole] * dims + bins[whole], minlength=rows * dims).reshape(rows, dims).astype(np.float32)


def language_vectors(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Unit vectors of damped 2-, 3- and 4-gram counts (dims bins each third of them)."""
    low = ascii_lower(data)
    x = np.log1p(sum(ngram_counts(low, offsets, n, dims, n) for n in (2, 3, 4)))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def quality_vectors(data: np.ndarray, offsets: np.ndarray, dims: int) -> np.ndarray:
    """Damped shares of shape 1- to 4-grams and of letter 3-grams, half of dims each."""
    s, low = shapes(data), ascii_lower(data)
    n = np.maximum(np.diff(offsets), 1)[:, None]
    a = sum(ngram_counts(s, offsets, k, dims // 2, k) for k in (1, 2, 3, 4))
    b = ngram_counts(low, offsets, 3, dims // 2, 9)
    return np.concatenate([2 * np.log1p(a * (1000.0 / n)), 0.5 * np.log1p(b * (1000.0 / n))], axis=1).astype(np.float32)


def bounded_sample(df: DataFrame, label: Column, key: Column, per_label: int) -> DataFrame:
    """Rows with a label, about per_label of each (all, if there are fewer), by a hash of key: the same in every run.

    The labels are counted first, so the share that is kept falls as the table grows; the caller trims to the bound.
    """
    counts = [r for r in df.groupBy(label.alias("l")).count().collect() if r["l"] is not None]
    if not counts:
        return df.where(F.lit(False)).withColumn("__u", F.lit(0.0))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(7), key.cast("string")), 12) / float(1 << 52)
    keep = F.lit(False)
    for r in counts:
        keep = keep | ((label == F.lit(r["l"])) & (u < min(1.0, 1.2 * per_label / r["count"])))
    return df.where(keep).withColumn("__u", u)
