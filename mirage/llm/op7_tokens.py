"""Token counts by rank-synchronous array merging (operator 7).

Texts are cut into pre-tokens by the byte-level splitting pattern; the symbols
of many different pre-tokens lie in one flat array. In each round every
sequence's adjacent pairs are looked up in the merge table at once, every
sequence's lowest rank is applied to all its occurrences at once, and the array
is compacted; sequences without a pair of the table are finished. The number of
symbols left is the number of tokens. No merge makes a pair of lower rank, so
this equals merging one occurrence after the other.

A space before a non-space always begins a pre-token, so counts are remembered
per space-separated part in a bounded table of the task.

Defined cases: null or empty text has no tokens. Special strings inside a text
count one token each (the library's default). Repeated rows are counted each.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import table

LIMIT = 1024
CACHE_PARTS = 300_000
CACHE_PART_CHARS = 64
# Fixed value: the splitting pattern of byte-level BPE.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# A space that may be inside a pre-token of white space.
_LOOSE = re.compile(r" (?:\s|$)")
_SPLIT = re.compile(r"(?= [^\s])")


class MergeTable:
    """Merges of a byte-level BPE file as sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(plain)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.byte_id = np.array([vocab[letter[b]] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys))


def count_symbols(table_: MergeTable, pre: list[bytes]) -> np.ndarray:
    """Tokens of every pre-token, merged together as one ragged array."""
    counts = np.array([len(p) for p in pre], dtype=np.int64)
    sym = table_.byte_id[np.frombuffer(b"".join(pre), dtype=np.uint8)]
    seq = np.repeat(np.arange(len(pre)), counts)
    none = len(table_.keys)
    while len(sym) > 1:
        inside = seq[1:] == seq[:-1]
        rank = np.where(inside, table_.ranks(sym[:-1], sym[1:]), none)
        best = np.full(len(pre), none, dtype=np.int64)
        np.minimum.at(best, seq[:-1], rank)
        hit = (rank < none) & (rank == best[seq[:-1]])
        if not hit.any():
            break
        at = np.flatnonzero(hit)
        # Of occurrences that overlap (x x x) every second is taken, from the left.
        run = np.concatenate([[True], (np.diff(at) != 1) | (seq[at[1:]] != seq[at[:-1]])])
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        sym[at] = table_.merged[rank[at]]
        counts -= np.bincount(seq[at], minlength=len(pre))
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        keep &= best[seq] < none  # finished sequences leave the array
        sym, seq = sym[keep], seq[keep]
    return counts


class TokenCounter:
    def __init__(self, path: str):
        import regex
        self.merges = MergeTable(path)
        self.pattern = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, self.merges.special))) if self.merges.special else None
        self.after_space: dict[str, int] = {}
        self.plain: dict[str, int] = {}

    def _learn(self, known: dict[str, int], parts: set[str], prefix: str) -> None:
        new = [p for p in parts if p not in known]
        for i in range(0, len(new), 8192):
            part = new[i:i + 8192]
            pre = [self.pattern.findall(prefix + p) for p in part]
            sizes = np.array([len(x) for x in pre])
            flat = {}
            index = np.array([flat.setdefault(t, len(flat)) for x in pre for t in x], dtype=np.int64)
            n = count_symbols(self.merges, [t.encode() for t in flat]) if flat else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(part)), sizes)
            total = np.bincount(owner, weights=n[index], minlength=len(part)) if len(index) else np.zeros(len(part))
            known.update(zip(part, total.astype(int).tolist(), strict=True))

    def count_many(self, texts: list[str]) -> list[int]:
        if len(self.after_space) + len(self.plain) > CACHE_PARTS:
            self.after_space.clear()
            self.plain.clear()
        todo, extra = [], []  # (document, first part, parts after a space)
        for d, t in enumerate(texts):
            segments = [t]
            if self.special is not None and "<" in t:
                segments = self.special.split(t)
            extra.append(len(segments) - 1)
            for s in segments:
                if s:
                    parts = s.split(" ") if _LOOSE.search(s) is None else [x[1:] if k else x for k, x in enumerate(_SPLIT.split(s))]
                    todo.append((d, parts))
        heads, tails = set(), set()
        for _, p in todo:
            heads.add(p[0])
            tails.update(p[1:])
        heads.discard("")
        self.plain.setdefault("", 0)
        self._learn(self.plain, heads, "")
        self._learn(self.after_space, tails, " ")
        get = self.after_space.__getitem__
        for d, p in todo:
            extra[d] += self.plain[p[0]] + sum(map(get, p[1:]))
        for known, parts in ((self.plain, heads), (self.after_space, tails)):
            for x in parts:
                if len(x) > CACHE_PART_CHARS:
                    del known[x]
        return extra


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        from mirage.llm.common import chunks
        counter = TokenCounter(tokenizer_path)
        for b in batches:
            sizes, tokens = [], []
            for i, j, raw, off in chunks(b.column(1)):
                data = raw.tobytes()
                tokens += counter.count_many([data[off[k]:off[k + 1]].decode() for k in range(j - i)])
                sizes += np.diff(off).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
