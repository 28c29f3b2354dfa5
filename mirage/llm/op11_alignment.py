"""Cross-tokenizer alignment with an identity-map fast path (operator 11).

Tokenizer A is byte-level BPE, B has pieces with byte fallback; both cover the
bytes of a space and the text. Byte offsets where both end a token cut the tokens
into groups. ``identity`` is an array from every A id to the B id of the same bytes
(-1: none), made once from the vocabularies. A group of one A and one B token that
the array names is counted in a vector as long as A's vocabulary, summed by task;
only the pairs of all other groups go through the pair shuffle.

1. Texts are cut at single spaces between other characters: there a token of each
   tokenizer begins (checked on the files, else a text is one part). The result of a
   part is remembered in a bounded table of the task. A slice (about
   ``SLICE_BYTES`` of text) writes one row per document with its parts by number,
   and one row with the parts' identity ids and irregular pairs, distinct pairs
   counted. The task's identity vector is written at its end.
2. Pair counts are summed by pair. The highest count of every B id and the counts of
   the identity pairs are vectors as long as a vocabulary; they go to the tasks.
3. The distinct irregular pairs of every slice get their counts by a join on the
   pair: a pair that all texts have is one row a slice. Slice by slice, the counts
   meet the documents' rows.

In a group of i A and j B tokens no inner ends meet, so i + j - 1 pairs overlap.

Defined cases: texts that are null, empty, or that the tokens of A or B do not spell
out byte for byte have no tokens: zeros and an empty groups_sha256. Special strings
are plain text. Texts are encoded whole at any length; one without spaces is one
part. Repeated rows count each. Null doc_id stays null. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import chunks, stash, table

SLICE_BYTES = 4 << 20
CACHE_PARTS = 250_000
CACHE_PART_CHARS = 64
# A space that is not between two other characters.
_LOOSE = re.compile(r"\s | \s| $")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Aligner:
    """Groups of the tokens that two tokenizers cut a text into."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_bytes = _bytes_of_letters(self.a)
        self.b_bytes = _bytes_of_pieces(self.b)
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        first = {}
        for by_byte in (False, True):  # a byte's own piece only where no other spells it
            for i, x in enumerate(self.b_bytes):
                if x and self.b.is_byte(i) == by_byte:
                    first.setdefault(x, i)
        self.identity = np.array([first.get(x, -1) for x in self.a_bytes], dtype=np.int64)
        self.cuts = _splits_at_spaces(path_a) and not any(
            "▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.known: dict[str, tuple] = {}
        self.ranked = _by_rank(path_a, self.a_bytes) if self.cuts else None
        number = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.spell_len = np.array([len(x) + 1 for x in number], dtype=np.int64)
        self.spell = {}
        for sign in ",|;":
            self.spell[sign] = np.array([x + sign.encode() for x in number], dtype=object)

    def parts(self, text: str) -> list[str]:
        """``" " + text`` is every part after a space, joined."""
        if not self.cuts:
            return [text]
        if not text[0].isspace() and _LOOSE.search(text) is None:
            return text.split(" ")
        first, *rest = _CUT.split(" " + text)
        return [first[1:], *rest]

    def learn(self, parts: list[str]) -> None:
        """(a, b, groups, links, spelled groups, identity ids, pairs) of parts, each
        after a space; None where the tokens don't spell it. Parts that begin and end
        with other characters are encoded in one text."""
        plain, other = [], []
        for p in parts:
            (plain if self.cuts and p and not p[0].isspace() and not p[-1].isspace() else other).append(p)
        for i in range(0, len(plain), 2048):
            some = plain[i:i + 2048]
            text = " ".join(some)
            if not self._aligned(some, self._ids(text)):
                other += some
        for p in other:
            if not self._aligned([p], self._ids(p)):
                self.known[p] = None

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.ranked is not None:
            a = self.ranked.encode_ordinary(" " + text)
        else:
            a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return np.array(a, dtype=np.int64), np.array(self.b.encode(text), dtype=np.int64)

    def _aligned(self, parts: list[str], ids: tuple[np.ndarray, np.ndarray]) -> bool:
        """Whether the ids spell the parts and cut at their ends; then they are known."""
        raw = [(" " + p).encode() for p in parts]
        whole = b"".join(raw)
        if any(b"".join(map(spelled.__getitem__, x.tolist())) != whole for spelled, x in zip((self.a_bytes, self.b_bytes), ids, strict=True)):
            return False
        ends = np.cumsum([len(t) for t in raw])
        n = [np.searchsorted(np.cumsum(length[x]), ends) + 1 for length, x in zip((self.a_len, self.b_len), ids, strict=True)]
        if any((np.cumsum(length[x])[k - 1] != ends).any() for length, x, k in zip((self.a_len, self.b_len), ids, n, strict=True)):
            return False
        self._align(parts, *ids, *n)
        return True

    def _align(self, parts: list[str], ids_a: np.ndarray, ids_b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> None:
        """All parts at once: bytes are numbered through, so every part's end is an
        end in both and a group never crosses it."""
        ends_a, ends_b = np.cumsum(self.a_len[ids_a]), np.cumsum(self.b_len[ids_b])
        shared = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b  # both end at the last byte
        both = ends_b[shared]
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        size_a, size_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        # Between two neighbouring ends of either lies exactly one overlapping pair.
        ends = np.sort(np.concatenate([ends_a, ends_b[~shared]]), kind="stable")
        link_a, link_b = ids_a[np.searchsorted(ends_a, ends)], ids_b[np.searchsorted(ends_b, ends)]
        group = np.searchsorted(both, ends)
        same = (size_a + size_b == 2)[group] & (self.identity[link_a] == link_b)
        part_end = ends_a[to_a - 1]
        link_to, group_to = np.searchsorted(ends, part_end) + 1, np.searchsorted(both, part_end) + 1
        same_to = np.cumsum(same)[link_to - 1]
        ids, pairs = link_a[same].tobytes(), ((link_a << 32) | link_b)[~same].tobytes()
        # Spelled out: every id with the sign after it, the tokens of B behind those of A.
        text = np.empty(len(ids_a) + len(ids_b), dtype=object)
        before_a, before_b = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        text[np.arange(len(ids_a)) + before_a[group_a]] = np.where(last_a, self.spell["|"][ids_a], self.spell[","][ids_a])
        text[np.arange(len(ids_b)) + before_b[group_b]] = np.where(last_b, self.spell[";"][ids_b], self.spell[","][ids_b])
        text = b"".join(text.tolist())
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        text_to = (np.cumsum(self.spell_len[ids_a])[to_a - 1] + np.cumsum(self.spell_len[ids_b])[to_b - 1]).tolist()
        t = g = k = m = 0
        for p, x, y, t2, g2, k2, m2 in zip(parts, n_a.tolist(), n_b.tolist(), text_to, group_to.tolist(), link_to.tolist(), same_to.tolist(), strict=True):
            self.known[p] = (x, y, g2 - g, k2 - k, text[t:t2 - 1], ids[8 * m:8 * m2], pairs[8 * (k - m):8 * (k2 - m2)])
            t, g, k, m = t2, g2, k2, m2

    def forget(self, parts) -> None:
        for p in parts:
            if len(p) > CACHE_PART_CHARS:
                self.known.pop(p, None)
        if len(self.known) > CACHE_PARTS:
            self.known.clear()


def _splits_at_spaces(path: str) -> bool:
    """Whether A is byte-level BPE with its own splitting pattern and no prefix."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True))


def _by_rank(path: str, spelled: list[bytes]):
    """The same tokens from a library that merges by the rank of the bytes, several
    times faster; None unless the file's merges are in the order of their ids."""
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if model.get("ignore_merges") or any(model["vocab"][x + y] != 256 + k for k, (x, y) in enumerate(pairs)):
        return None
    ranks = {spelled[i]: i for i in model["vocab"].values() if spelled[i] and i < 256 + len(pairs)}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bytes_of_letters(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = bytes(byte[ch] for ch in token) if all(ch in byte for ch in token) else token.encode()
    return out


def _bytes_of_pieces(model) -> list[bytes]:
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i)
                   else piece.replace("▁", " ").encode())
    return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


class _Slice:
    """Documents and distinct parts of a slice."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows = number, 0, 0
        self.local: dict[str, int] = {}
        self.results: list[tuple[bytes, bytes]] = []
        self.spelled: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.uses = np.zeros(0, np.int64)

    def add(self, parts, known) -> None:
        new = [p for p in parts if p not in self.local]
        self.local.update(zip(new, range(len(self.local), len(self.local) + len(new)), strict=True))
        found = [known[p] for p in new]
        self.results += [(b"", b"") if r is None else r[5:] for r in found]
        self.spelled += [b"" if r is None else r[4] for r in found]
        self.counts = np.concatenate([self.counts, np.array([r[:4] if r else (-1, 0, 0, 0) for r in found], np.int64).reshape(-1, 4)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def tables(self):
        """(identity ptr, identity ids, pair ptr, pair index, pairs, their counts)."""
        ids, pairs = ([r[k] for r in self.results] for k in (0, 1))
        ptr_i, ptr_p = (np.concatenate([[0], np.cumsum([len(x) // 8 for x in y], dtype=np.int64)]) for y in (ids, pairs))
        flat_i, flat_p = (np.frombuffer(b"".join(y), dtype=np.int64) for y in (ids, pairs))
        distinct, index = np.unique(flat_p, return_inverse=True)
        n = np.bincount(index, weights=np.repeat(self.uses, np.diff(ptr_p)), minlength=len(distinct)).astype(np.int64)
        return ptr_i, flat_i, ptr_p, index.astype(np.int64), distinct, n


_ROWS = ("kind int, slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, parts binary, "
         "identity_ptr binary, identity binary, pair_ptr binary, pair_index binary, pairs array<long>, pair_n array<long>")
DOCUMENT, SLICE, VECTOR = 0, 1, 2


def aligned_rows(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows of documents, of slices and of the tasks' identity vectors."""
    import pyarrow as pa
    whole = [("kind", pa.int32()), ("slice", pa.int64()), *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
             ("groups_sha256", pa.string()), *[(c, pa.binary()) for c in ("parts", "identity_ptr", "identity", "pair_ptr", "pair_index")],
             ("pairs", pa.list_(pa.int64())), ("pair_n", pa.list_(pa.int64()))]
    schema = pa.schema(whole)

    def rows(n, **columns):
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches) -> Iterator:
        from pyspark import TaskContext
        aligner = _aligner(path_a, path_b)
        vector = np.zeros(len(aligner.a_bytes), np.int64)
        own = TaskContext.get().partitionId() << 32
        now = _Slice(own)

        def close():
            ptr_i, ids, ptr_p, index, pairs, n = now.tables()
            np.add.at(vector, ids, np.repeat(now.uses, np.diff(ptr_i)))
            binary = {k: [v.astype(np.int32).tobytes()] for k, v in
                      (("identity_ptr", ptr_i), ("identity", ids), ("pair_ptr", ptr_p), ("pair_index", index))}
            return rows(1, kind=[SLICE], slice=[now.number], pairs=[pairs], pair_n=[n], **binary)

        for b in batches:
            for i, j, raw, off in chunks(b.column(1)):
                data = raw.tobytes()
                cut = [aligner.parts(data[off[k]:off[k + 1]].decode()) if off[k + 1] > off[k] else [] for k in range(j - i)]
                distinct = set().union(*cut)
                aligner.learn([p for p in distinct if p not in aligner.known])
                now.add(distinct, aligner.known)
                got = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "parts")}
                for parts in cut:
                    own_parts = list(map(now.local.__getitem__, parts))
                    at = np.array(own_parts, dtype=np.int32)
                    sums = now.counts[at]
                    if not len(at) or (sums[:, 0] < 0).any():
                        sums, sha, at = np.zeros(4, np.int64), "", at[:0]
                    else:
                        sums = sums.sum(0)
                        sha = hashlib.sha256(b";".join(map(now.spelled.__getitem__, own_parts))).hexdigest()
                        np.add.at(now.uses, at, 1)
                    for c, v in zip(got, [*sums.tolist(), sha, at.tobytes()], strict=True):
                        got[c].append(v)
                yield rows(j - i, kind=[DOCUMENT] * (j - i), slice=[now.number] * (j - i), doc_id=b.column(0).slice(i, j - i), **got)
                aligner.forget(distinct)
                now.bytes += len(raw)
                now.rows += j - i
                if now.bytes >= slice_bytes:
                    yield close()
                    now = _Slice(now.number + 1)
        if now.rows:
            yield close()
        if vector.any():
            at = np.flatnonzero(vector)
            yield rows(1, kind=[VECTOR], slice=[now.number], pairs=[(at << 32) | aligner.identity[at]], pair_n=[vector[at]])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ROWS)


def alignment(docs: DataFrame, path_a: str, path_b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    import pyarrow as pa
    rows = stash(aligned_rows(docs, path_a, path_b, slice_bytes))
    counted = rows.filter(F.col("kind") > DOCUMENT).select("kind", "slice", F.explode(F.arrays_zip("pairs", "pair_n")).alias("x"))
    counts = stash(counted.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.pair_n").alias("n"), F.max(F.col("kind") == VECTOR).alias("identity")))
    # One row per id of a vocabulary at most.
    highest = counts.groupBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).agg(F.max("n").alias("n")).collect()
    same = counts.filter("identity").select(F.shiftright("pair", 32).alias("a"), "n", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")).collect()
    top = np.zeros(max((r["b"] for r in highest), default=0) + 1, np.int64)
    for r in highest:
        top[r["b"]] = r["n"]
    same_n, same_best = (np.zeros(max((r["a"] for r in same), default=0) + 1, np.int64) for _ in range(2))
    for r in same:
        same_n[r["a"]], same_best[r["a"]] = r["n"], r["n"] == top[r["b"]]
    irregular = counted.filter(F.col("kind") == SLICE).select("slice", F.col("x.pairs").alias("pair"))
    priced = irregular.join(counts.select("pair", "n"), "pair").select(F.col("slice").alias("_slice"), "pair", "n")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def per_part(values, ptr):
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[ptr[1:]] - sums[ptr[:-1]]

    def run(left, right):
        kind = left.column("kind").to_numpy()
        s = left.filter(pa.array(kind == SLICE))
        d = left.filter(pa.array(kind == DOCUMENT))
        ptr_i, ids, ptr_p, index = (np.frombuffer(s.column(c)[0].as_py(), np.int32) for c in ("identity_ptr", "identity", "pair_ptr", "pair_index"))
        pair, n = right.column("pair").to_numpy(), right.column("n").to_numpy()
        order = np.argsort(pair)  # the slice's distinct pairs are numbered in this order
        n, best = n[order], n[order] == top[pair[order] & ((1 << 32) - 1)] if len(pair) else np.zeros(0, bool)
        cost = per_part(same_n[ids], ptr_i) + per_part(n[index], ptr_p)
        good = per_part(same_best[ids], ptr_i) + per_part(best[index].astype(np.int64), ptr_p)
        parts = [np.frombuffer(x.as_buffer(), np.int32) for x in d.column("parts")]
        n_best = pa.array([int(good[x].sum()) for x in parts], pa.int64())
        count_sum = pa.array([int(cost[x].sum()) for x in parts], pa.int64())
        cols = {"n_best": n_best, "count_sum": count_sum}
        return pa.table([cols[c] if c in cols else d.column(c) for c in names], names=names)

    # A slice is bounded: its documents' rows, one row of its parts, its distinct pairs.
    held = rows.filter(F.col("kind") < VECTOR).drop("pairs", "pair_n")
    return held.groupBy("slice").cogroup(priced.groupBy("_slice")).applyInArrow(
        run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
