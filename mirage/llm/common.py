"""Helpers shared by the training-data operators.

* ``stash`` / ``discard``: written intermediate tables in the shared checkpoint
  folder. A table is discarded once everything computed from it is written.
* ``chunks`` / ``Words``: an Arrow string column as flat byte arrays with word
  boundaries and 64-bit word hashes, all in numpy (no loop over words).

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` everywhere here,
which is what ``bytes.split()`` cuts at.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.session import checkpoint_dir

SPACES = r"[\x20\x09-\x0D]+"
CHUNK_BYTES = 2 << 20
_STASHED: list[tuple[str, SparkSession]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    _STASHED.append((path, spark))
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables whose readers are all written."""
    for t in tables:
        _delete(t.sparkSession, t._stash_path)


def discard_unused(docs: DataFrame) -> None:
    """Delete stashed tables of this session that ``docs`` does not read: called
    where everything made before is written (between pipeline stages)."""
    spark = docs.sparkSession
    files = " ".join(docs.inputFiles()) if _STASHED else ""
    for path, s in list(_STASHED):
        if s is spark and os.path.basename(path) not in files:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _STASHED[:] = [x for x in _STASHED if x[0] != path]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_array(text):
    """Words of a text column as an array, JVM-side; null and empty give []."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


# --- numpy kernels ------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
PRIME = (1 << 61) - 1
_HASH_WORDS = 400_000
_HASH_WORD_BYTES = 64
_KNOWN: dict[bytes, bytes] = {}
_POW = {}


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo ``PRIME`` of numbers below it, in 64-bit halves."""
    low, mid_bits = np.uint64((1 << 31) - 1), np.uint64(30)
    ah, al, bh, bl = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    mid = al * bh + ah * bl
    out = (ah * bh << np.uint64(1)) + (mid >> mid_bits) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + al * bl
    return reduced(out)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo ``PRIME`` of any 64-bit numbers."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo ``PRIME``, kept and grown per process."""
    p = _POW.get(base)
    if p is None or len(p) < n:
        m = max(n, 1 << 16)
        p = np.ones(m, dtype=np.uint64)
        k = 1
        while k < m:
            p[k:2 * k] = mulmod(p[:min(k, m - k)], np.uint64(pow(base, k, PRIME)))
            k *= 2
        if m <= 4 * CHUNK_BYTES:  # a very long text gets its own, not kept
            _POW[base] = p
    return p[:n]


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0 .. len(x) numbers modulo ``PRIME``, of numbers below it."""
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    high, low = np.cumsum(x >> np.uint64(31)), np.cumsum(x & np.uint64((1 << 31) - 1))
    out[1:] = reduced(mulmod(reduced(high), np.uint64(1 << 31)) + reduced(low))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), a bijection."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chunks(column, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of an Arrow string array: (first row, end row, bytes, offsets).

    A slice has about ``max_bytes`` of text, more only for one longer text.
    Null rows are empty."""
    import pyarrow as pa
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


class Words:
    """Word boundaries of a slice: ``start``/``end`` byte positions, ``first[d]``
    = index of document d's first word (len = documents + 1)."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off = raw, off
        n = len(raw)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.first = np.zeros(len(off), np.int64)
            return
        sp = _SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        before = np.empty(n, dtype=bool)
        before[0] = True
        np.logical_or(sp[:-1], edge[1:n], out=before[1:])
        after = np.empty(n, dtype=bool)
        after[-1] = True
        np.logical_or(sp[1:], edge[1:n], out=after[:-1])
        word = ~sp
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.start, off)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64 bits of a cryptographic digest of every word's bytes (A-Z lower-cased
        if asked), remembered in a bounded table of the process."""
        data = self.raw.tobytes()
        if lower:
            data = data.lower()  # ASCII letters only
        words = [data[s:e] for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)]
        new = set(words).difference(_KNOWN)
        if len(_KNOWN) + len(new) > _HASH_WORDS:
            _KNOWN.clear()
            new = set(words)
        for w in new:
            _KNOWN[w] = hashlib.blake2b(w, digest_size=8).digest()
        out = np.frombuffer(b"".join(map(_KNOWN.__getitem__, words)), dtype=np.uint64)
        for w in new:
            if len(w) > _HASH_WORD_BYTES:
                del _KNOWN[w]
        return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (len(a) - w + 1 of them)."""
    if len(a) < w:
        return a[:0]
    size, m = 1, a
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[:len(m) - (w - size)], m[w - size:])
    return m


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes (over document edges too;
    the caller masks those)."""
    if len(h) < k:
        return h[:0]
    n = len(h) - k + 1
    out = np.zeros(n, dtype=np.uint64)
    c = np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for j in range(k):
        out += h[j:j + n] * c[j]
        out = (out << np.uint64(23)) | (out >> np.uint64(41))
    return mix(out)
