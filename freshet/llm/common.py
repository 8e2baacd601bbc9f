"""Shared pieces of the corpus operators: scratch tables in the shared folder, column handling, text views for numpy."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on; temporary arrays are some dozens of times as large.
STEP_BYTES = 256 << 10
#: Side tables up to this many bytes (measured, not estimated) are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; a local one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="freshet-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


class Scratch:
    """Tables of one operator run, written under the shared folder and removed when dropped or when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/freshet-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        """Cuts the lineage: whoever loses an executor later rereads the table."""
        w = df.write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def size(self, name: str) -> int:
        fs, p = self._fs(self.path(name))
        return fs.getContentSummary(p).getLength()

    def drop(self, name: str) -> None:
        fs, p = self._fs(self.path(name))
        fs.delete(p, True)

    def close(self) -> None:
        try:
            fs, p = self._fs(self.root)
            fs.delete(p, True)
        except Exception:  # the JVM may have gone before
            pass


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int | None = None):
    """While jobs run in it, Python gets batches of so many rows, and so many bytes, at most: its memory, and what a batch settles by itself, grow with them."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, most in limits.items():
        had = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[name] or "0")
        spark.conf.set(name, str(min(most, had) if had > 0 else most))
    try:
        yield
    finally:
        for name, had in before.items():
            spark.conf.set(name, had) if had is not None else spark.conf.unset(name)


def small(df: DataFrame, scratch: Scratch, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a scratch table called name, marked for broadcast if its files (compressed, so a quarter of limit) are small."""
    return F.broadcast(df) if scratch.size(name) * 4 <= limit else df


def pick(df: DataFrame, name: str, kind: str | None = None) -> Column:
    """The column called exactly name, as kind; a null of that kind where there is none."""
    if name in df.columns:
        c = F.col(f"`{name}`")
        return c.cast(kind) if kind else c
    return F.lit(None).cast(kind or "string")


def others(df: DataFrame, *made: str) -> list[Column]:
    """df's columns but for those whose names the operator makes itself: its results win over input columns of the same name."""
    taken = {m.lower() for m in made}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def aliased(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, Column]]:
    """df with its columns called __c0, __c1, ... but for those in names, and for each old name the column that gives it back: so no name meets an operator's, and no text travels twice."""
    new = {c: c if c in names else f"__c{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), {c: F.col(f"`{n}`").alias(c) for c, n in new.items()}


def let(value: Column, body) -> Column:
    """body(value), with value worked out once per row even where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def trim() -> None:
    """Gives back to the system what numpy and Arrow have freed, so that a reused Python worker starts small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(1), t)]


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    n = len(array)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, np.int64)[array.offset : array.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], flat[offsets[0] : offsets[-1]]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES, rows: int = 1 << 62):
    """Cuts rows into runs (first, last) of about limit bytes and rows at most; a longer row stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, first + rows, max(last, first + 1))
        yield first, last
        first = last


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


#: splitmix64's constants (fixed values).
MIX_ADD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values over all 64-bit values, one to one."""
    x = x + np.uint64(MIX_ADD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9DDFEA08EB382D69  # odd, so it has an inverse
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        ups = [np.ones(size, np.uint64), np.ones(size, np.uint64)]
        for a, base in zip(ups, (_BASE, pow(_BASE, -1, 1 << 64))):
            a[1:] = np.uint64(base)
            np.multiply.accumulate(a, out=a)
        _POWERS[size] = tuple(ups)
    return _POWERS[size]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes wherever they stand."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((mix(np.arange(256, dtype=np.uint64))[data]) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other than ASCII white space) in rows that lie behind one another, and each word's row."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    rows_at = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows_at] = inside[rows_at]
    stops = inside.copy()
    stops[:-1] &= space[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stops[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles_of(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles (ASCII lower case; a row with fewer words has one of all its words) and their rows, in order, repeats included."""
    data = ascii_lower(data)
    starts, ends, row = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = spans_hash(data, starts, ends)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    full = np.maximum(count - width + 1, 0)
    at = np.repeat(first - (np.cumsum(full) - full), full) + np.arange(full.sum())
    out = np.full(len(at), np.uint64(width))
    for i in range(width):
        out = mix(out ^ words[at + i] if len(at) else out)
    rows = np.repeat(np.arange(n), full)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        one = np.full(len(short), np.uint64(0))
        for i in range(width - 1):
            has = count[short] > i
            one[has] = mix(one[has] ^ words[first[short[has]] + i])
        one = mix(one ^ count[short].astype(np.uint64))
        out, rows = np.concatenate([out, one]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows
