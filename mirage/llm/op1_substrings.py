"""Substring dedup by super-k-mer partitioning (operator 1).

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the
least hash of its ``GRAM``-word grams; a super-k-mer is a run of consecutive
windows with one minimiser, so equal windows are always in super-k-mers of the
same minimiser. A word is removed if a window over it also starts in a document
of smaller id.

1. Every document gives its super-k-mers as narrow rows: minimiser, a 128-bit
   fingerprint of its words, document, first word, number of windows.
2. Minimisers seen in one document only are dropped (partial sums per
   minimiser); nothing in them can repeat.
3. Equal super-k-mers (same minimiser and fingerprint) are one class. In every
   document but the class's first all its windows repeat an earlier document.
4. Only the first occurrence of each class whose minimiser has other classes
   travels as a packed string of its words to its bucket, where the windows are
   sorted and equal ones get their first document. Windows are ranked exactly by
   doubling: numbers for words, then for pairs of equal numbers, and so on. For a
   minimiser of more than ``BUCKET_WINDOWS`` windows (a very common passage, or
   one word over and over) each window travels alone as its 128-bit cryptographic
   digest, with the least document per digest summed before the shuffle, so no
   bucket grows with it.
5. The spans go back to their documents, which drop the covered words.

Defined cases: null and empty texts have no words. doc_id names a text: repeated
rows of one doc_id are one document (never removed by each other); each row is
returned. Rows without doc_id take no part in the comparison (kept whole). An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import (PRIME, Words, chunks, discard, grams, mix, mulmod, partitions, powers, prefix_sums, reduced, sliding_min, stash,
                               table)

WINDOW = 50
GRAM = 8
BUCKET_WINDOWS = 1 << 19
_P1, _P2 = 0xA0761D6478BD642F % PRIME, 0xE7037ED1A0B428DB % PRIME
_I1, _I2 = pow(_P1, -1, PRIME), pow(_P2, -1, PRIME)
_SALT = np.uint64(0x8EBC6AF09C88C6E3)


def _span_hash(h: np.ndarray, begin: np.ndarray, stop: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Polynomial over the field of 2**61 - 1 elements of the words of every span."""
    n = len(h)
    acc = prefix_sums(mulmod(reduced(h), powers(base, n)))
    return mulmod(reduced(acc[stop] + np.uint64(PRIME) - acc[begin]), powers(inverse, n)[begin])


def super_kmers(raw: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Super-k-mers of a slice of documents: document index, first word in the
    document, windows, minimiser and two fingerprint halves."""
    w = Words(raw, off)
    h = w.hashes()
    n = len(h)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "start", "windows", "mini", "fp1", "fp2")}
    if n < window:
        return empty
    mini = sliding_min(grams(h, gram, 1), window - gram + 1)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
    valid = doc[:n - window + 1] == doc[window - 1:]
    same = valid[1:] & valid[:-1] & (mini[1:] == mini[:-1])
    # Windows at a document's edge are not valid, so runs never cross documents.
    begin = np.flatnonzero(valid & np.concatenate([[True], ~same]))
    if not len(begin):
        return empty
    ends = np.flatnonzero(valid & np.concatenate([~same, [True]])) + 1
    stop = ends + window - 1
    size = (ends - begin).astype(np.uint64)
    fp1 = mix(_span_hash(h, begin, stop, _P1, _I1) + size)
    fp2 = mix(_span_hash(mix(h ^ _SALT), begin, stop, _P2, _I2) + size)
    d = doc[begin]
    return {"doc": d, "start": begin - w.first[d], "windows": ends - begin,
            "mini": mini[begin].view(np.int64), "fp1": fp1.view(np.int64), "fp2": fp2.view(np.int64)}


def _occurrences(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for i, j, raw, off in chunks(b.column(1)):
                s = super_kmers(raw, off, window, gram)
                ids = b.column(0).slice(i, j - i).take(pa.array(s["doc"]))
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(s[k].astype(np.int32 if k in ("start", "windows") else np.int64, copy=False))
                            for k in ("start", "windows", "mini", "fp1", "fp2")]],
                    names=["doc_id", "start", "windows", "mini", "fp1", "fp2"])

    return docs.filter(F.col("doc_id").isNotNull()).mapInArrow(
        run, "doc_id long, start int, windows int, mini long, fp1 long, fp2 long")


def _spans_of(wanted: DataFrame, *fields: str) -> DataFrame:
    return wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", *fields)).alias("spans"))


def _packed(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Wanted super-k-mers with their words: (hot, key, doc_id, start, words).

    A cold one is one packed string, its key the minimiser; a hot one comes as
    single windows, ``words`` being a digest of the window."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        names = ["hot", "key", "doc_id", "start", "words"]
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            rows = []
            for text, d, spans in zip(b.column(1), b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                for s in spans:
                    part = words[s["start"]:s["start"] + s["windows"] + window - 1]
                    if s["hot"]:
                        rows += [(True, 0, d, s["start"] + k, hashlib.blake2b(b" ".join(part[k:k + window]), digest_size=16).digest())
                                 for k in range(s["windows"])]
                    else:
                        rows.append((False, s["mini"], d, s["start"], b" ".join(part)))
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").join(_spans_of(wanted, "mini", "hot"), "doc_id").mapInArrow(
        run, "hot boolean, key long, doc_id long, start int, words binary")


def window_ranks(ids: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal runs of ``window`` ids, in sorted order of the runs."""
    size, rank = 1, ids
    while size * 2 <= window:
        rank = _rank_pairs(rank[:-size], rank[size:])
        size *= 2
    return rank if size == window else _rank_pairs(rank[:len(rank) - (window - size)], rank[window - size:])


def _rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1].astype(np.int64)


def sort_bucket(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(document, first word, windows): runs of windows in a bucket that a
    smaller document of it has too."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in s.split()] for s in strings]
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate([np.array(w, dtype=np.int64) for w in words])
    rank = window_ranks(flat, window)
    # Windows over the edge of two strings are ranked too and left out here.
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(strings)), counts)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = rank[begin[owner] + k]
    least = np.full(int(rank.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, docs[owner])
    hit = np.flatnonzero(least[rank] < docs[owner])
    if not len(hit):
        return []
    new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0)])
    first = hit[new]
    runs = np.diff(np.append(np.flatnonzero(new), len(hit)))
    o = owner[first]
    return list(zip(docs[o].tolist(), (starts[o] + k[first]).tolist(), runs.tolist(), strict=True))


def _buckets(packed: DataFrame, window: int) -> DataFrame:
    """Sorts every bucket; rows (doc_id, start, windows) to remove."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        held: list[tuple[bytes, int, int]] = []
        key = None
        found: list[tuple[int, int, int]] = []

        def close():
            if len(held) > 1:
                docs = np.array([h[1] for h in held])
                starts = np.array([h[2] for h in held])
                found.extend(sort_bucket([h[0] for h in held], docs, starts, window))
            held.clear()

        def batch():
            r = pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32()),
                                            pa.array([f[2] for f in found], pa.int32())], names=["doc_id", "start", "windows"])
            found.clear()
            return r

        for b in batches:
            for k, d, s, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    close()
                    key = k
                held.append((words, d, s))
            if len(found) > 8192:
                yield batch()
        close()
        yield batch()

    n = partitions(packed.sparkSession)
    cold = packed.filter(~F.col("hot")).select("key", "doc_id", "start", "words")
    return cold.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, start int, windows int")


def _hot_windows(packed: DataFrame) -> DataFrame:
    one = packed.filter("hot").select("words", "doc_id", "start")
    first = one.groupBy("words").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).filter("_first < _last")
    return one.join(first, "words").filter("doc_id > _first").select("doc_id", "start", F.lit(1).alias("windows"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """(doc_id, start, windows): windows that a document of smaller id has too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = stash(_occurrences(docs, window, gram))
    shared = every.groupBy("mini").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).filter("_a < _b").select("mini")
    occ = stash(every.join(shared, "mini", "left_semi"))
    discard(every)
    classes = stash(occ.groupBy("mini", "fp1", "fp2").agg(F.min(F.struct("doc_id", "start", "windows")).alias("f"),
                                                         F.max("doc_id").alias("last")))
    later = occ.join(classes.filter("f.doc_id < last").select("mini", "fp1", "fp2", F.col("f.doc_id").alias("_first")),
                     ["mini", "fp1", "fp2"]).filter("doc_id > _first").select("doc_id", "start", "windows")
    many = classes.groupBy("mini").agg(F.count(F.lit(1)).alias("n"), F.sum("f.windows").alias("w"),
                                      F.min("f.doc_id").alias("_a"), F.max("f.doc_id").alias("_b")).filter("n > 1 and _a < _b")
    many = many.select("mini", (F.col("w") > bucket_windows).alias("hot"))
    first = classes.join(many, "mini").select("f.doc_id", "f.start", "f.windows", "mini", "hot")
    packed = stash(_packed(docs, first, window))
    inside = stash(_buckets(packed, window).unionByName(_hot_windows(packed)))
    discard(packed)
    # Within one document a class may occur again: it has the windows of its
    # first occurrence, so what was found there holds for all its occurrences.
    own = occ.join(classes.select("mini", "fp1", "fp2", F.col("f.doc_id").alias("doc_id"), F.col("f.start").alias("_s")),
                   ["mini", "fp1", "fp2", "doc_id"]).filter(F.col("start") != F.col("_s")).select(
                       "doc_id", F.col("start").alias("_at"), "_s", F.col("windows").alias("_n"))
    lo, hi = F.greatest("start", "_s"), F.least(F.col("start") + F.col("windows"), F.col("_s") + F.col("_n"))
    again = inside.join(own, "doc_id").filter(lo < hi).select(
        "doc_id", (F.col("_at") + lo - F.col("_s")).cast("int").alias("start"), (hi - lo).cast("int").alias("windows"))
    return later.unionByName(inside).unionByName(again)


def remove_repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed``, ``kept_text``
    (kept words joined by one space) and ``kept_sha256``."""
    spans = repeated_spans(docs, window, gram, bucket_windows).groupBy(F.col("doc_id").alias("__op1_id")).agg(
        F.collect_list(F.struct("start", "windows")).alias("__op1_spans"))
    rows = docs.join(spans, F.col("doc_id") == F.col("__op1_id"), "left").drop("__op1_id")

    def run(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            kept, counts, removed, digests = [], [], [], []
            for text, spans_ in zip(b.column(at["text"]), b.column(at["__op1_spans"]), strict=True):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                if spans_.is_valid:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    v = spans_.values
                    s = v.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                    e = s + v.field("windows").to_numpy(zero_copy_only=False) + window - 1
                    np.add.at(edge, np.minimum(s, len(words)), 1)
                    np.add.at(edge, np.minimum(e, len(words)), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(counts[-1] - len(words))
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(at[n]) for n in names], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(digests, pa.string())],
                names=[*names, "n_words", "n_removed", "kept_text", "kept_sha256"])

    names = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_text", "kept_sha256")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    return rows.mapInArrow(run, ddl + ", n_words long, n_removed long, kept_text string, kept_sha256 string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
