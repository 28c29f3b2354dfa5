"""Exact dedup by a tree merge of sorted digest runs (operator 12).

1. Every task turns its texts into keys: SHA-256 of the text without white space,
   its length in bytes and a second, independent 64-bit digest. Two texts are taken
   as equal only where all 48 bytes agree. The slim rows are written once; a task's
   rows are its run.
2. A run is sorted by key and reduced: per key the row that stays (most code points,
   least doc_id, first row) and the number of rows. Runs meet in rounds, as in a
   binomial tree of ``fan_in`` children: in round j the runs of ``fan_in ** j`` tasks
   exchange parts, every partner taking one range of the keys, and each part is
   merged from its sorted runs. So no round has fewer, larger parts than the one
   before, none goes to a root, and a text that a third of the rows share is at most
   one entry a run in every merge.
3. What stayed of groups of two and more goes back down the tree: to the runs that
   have the key, then to their rows, by (run, key).

Defined cases: null text is empty; empty and white-space texts are one group.
Texts are read whole at any length. A null doc_id comes after every other one; among
equal rows the first read stays, so of each group exactly one row is kept. Rows
without doc_id keep it null, and ``keep_id`` is null if such a row stays. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import chunks, stash, table

FAN_IN = 16
RUN_ENTRIES = 1 << 18  # entries sorted at once; also aimed at for a part
KEY = 48
ENTRY = np.dtype([("key", f"S{KEY}"), ("short", "<i8"), ("unnamed", "u1"), ("doc_id", "<i8"), ("row", "<i8"), ("n", "<i8")])
_SPACES = bytes([9, 10, 11, 12, 13, 32])
SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY chars DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def text_key(text: bytes) -> bytes:
    bare = text.translate(None, _SPACES)
    return hashlib.sha256(bare).digest() + len(bare).to_bytes(8, "big") + hashlib.blake2b(bare, digest_size=8).digest()


def digest_rows(docs: DataFrame) -> DataFrame:
    """(run, row, doc_id, chars, key) of every row; ``row`` is unique."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        own = TaskContext.get().partitionId()
        at = own << 40
        for b in batches:
            keys = []
            for _, _, raw, off in chunks(b.column(1)):
                data = raw.tobytes()
                keys += [text_key(data[off[k]:off[k + 1]]) for k in range(len(off) - 1)]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, own, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64)), b.column(0),
                 pc.utf8_length(b.column(1).fill_null("")).cast(pa.int64()), pa.array(keys, pa.binary())],
                names=["run", "row", "doc_id", "chars", "key"])
            at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "run long, row long, doc_id long, chars long, key binary")


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """One sorted run with one entry per key. The stable sort finds the runs that
    are sorted already and merges them."""
    e = np.concatenate(runs) if len(runs) > 1 else runs[0]
    e = e[np.argsort(e["key"], kind="stable")]
    head = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]])) if len(e) else np.zeros(0, np.int64)
    if len(head) == len(e):
        return e
    n = np.add.reduceat(e["n"], head)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(e))))
    shared = np.flatnonzero(np.diff(np.append(head, len(e)))[group] > 1)
    s = e[shared]
    shared = shared[np.lexsort((s["row"], s["doc_id"], s["unnamed"], s["short"], group[shared]))]
    first = np.concatenate([[True], group[shared][1:] != group[shared][:-1]])
    best = head.copy()
    best[group[shared[first]]] = shared[first]
    out = e[best]
    out["n"] = n
    return out


def _prefix(e: np.ndarray) -> np.ndarray:
    """The first 32 bits of every key."""
    raw = np.ascontiguousarray(e["key"]).view(np.uint8).reshape(len(e), KEY)
    return np.ascontiguousarray(raw[:, :4]).view(">u4").ravel().astype(np.uint64)


def _parts(e: np.ndarray, cells: int) -> Iterator[tuple[int, bytes]]:
    """The run cut into the ranges of ``cells`` equal key ranges."""
    cell = (_prefix(e) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(e) else []
    for s, t in zip(cut, [*cut[1:], len(e)], strict=True):
        yield int(cell[s]), e[s:t].tobytes()


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """(key, stays, keep_id, group_size) of the keys that two rows and more have."""
    import pyarrow as pa
    size = rows.agg(F.count(F.lit(1)).alias("n"), (F.coalesce(F.max("run"), F.lit(0)) + 1).alias("runs")).first()
    rounds = 1
    while fan_in ** rounds < size["runs"]:
        rounds += 1
    parts = max(size["runs"], -(-size["n"] // run_entries))
    fan_out = 2
    while fan_out ** rounds < parts:
        fan_out += 1
    part_schema = pa.schema([("g", pa.int64()), ("d", pa.int64()), ("run", pa.binary())])

    def sorted_runs(batches) -> Iterator:
        held, n = [], 0

        def flush():
            out = {"g": [], "d": [], "run": []}
            own = np.concatenate([h[0] for h in held])
            every = np.concatenate([h[1] for h in held])
            for r in np.unique(own):
                for d, data in _parts(merge_runs([every[own == r]]), fan_out):
                    out["g"].append(int(r) // fan_in)
                    out["d"].append(d)
                    out["run"].append(data)
            return pa.RecordBatch.from_pydict(out, schema=part_schema)

        for b in batches:
            e = np.zeros(b.num_rows, ENTRY)
            e["key"] = np.frombuffer(b"".join(b.column("key").to_pylist()), dtype=f"S{KEY}")
            e["short"] = -b.column("chars").to_numpy(zero_copy_only=False)
            e["unnamed"] = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            e["doc_id"] = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            e["row"] = b.column("row").to_numpy(zero_copy_only=False)
            e["n"] = 1
            held.append((b.column("run").to_numpy(zero_copy_only=False), e))
            n += len(e)
            if n >= run_entries:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def exchange(j: int):
        def run(key, group):
            e = merge_runs([np.frombuffer(x.as_buffer(), dtype=ENTRY) for x in group.column("run")])
            got = list(_parts(e, fan_out ** (j + 1)))
            return pa.Table.from_pydict({"g": [key[0].as_py() // fan_in] * len(got), "d": [d for d, _ in got], "run": [x for _, x in got]},
                                        schema=part_schema)
        return run

    def last(key, group):
        e = merge_runs([np.frombuffer(x.as_buffer(), dtype=ENTRY) for x in group.column("run")])
        e = e[e["n"] > 1]
        raw = np.ascontiguousarray(e["key"]).tobytes()
        return pa.Table.from_arrays(
            [pa.array([raw[i:i + KEY] for i in range(0, len(raw), KEY)], pa.binary()), pa.array(e["row"]),
             pa.array(e["doc_id"], mask=e["unnamed"].astype(bool)), pa.array(e["n"])], names=["key", "stays", "keep_id", "group_size"])

    ddl = "g long, d long, run binary"
    level = rows.mapInArrow(sorted_runs, ddl)
    for j in range(1, rounds):
        level = level.groupBy("g", "d").applyInArrow(exchange(j), ddl)
    return level.groupBy("g", "d").applyInArrow(last, "key binary, stays long, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, fan_in: int = FAN_IN, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    rows = stash(digest_rows(docs))
    found = tree_merge(rows, fan_in, run_entries)
    held = rows.select("run", "key").distinct().join(found, "key")
    every = rows.join(held, ["run", "key"], "left")
    alone = F.col("stays").isNull()
    return every.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("row") == F.col("stays"))).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def op12_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))
