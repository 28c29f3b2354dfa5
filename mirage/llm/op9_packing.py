"""Best-two-fit packing of tokenised documents into sequences (operator 9).

Documents are tokenised where they are read; only lengths and checksums travel.
A document over the sequence length is cut into full pieces and a rest. Pieces
are dealt evenly over packing groups (about ``GROUP_PIECES`` each, so the last,
half-empty sequences of a group are a vanishing share); each group is packed by
best-two-fit on a table of unpacked lengths: fill a sequence with the longest
piece that fits, again and again; then, if it has a gap, take its shortest piece
out and put in the two unpacked pieces that fill the wider gap best, if those
are longer together than the piece they replace.

White space never joins two tokens of the word-level tokenizer (its normaliser
and splitter act inside runs of other characters), so words are encoded once
per task and remembered in a bounded table.

Defined cases: null or empty text is one piece [0]. Repeated rows are packed
each. Null doc_id is kept as null. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import chunks, stash, table

SEQUENCE_TOKENS = 2048
GROUP_PIECES = 1 << 16
CACHE_WORDS = 400_000
CACHE_WORD_BYTES = 64
# The splitting pattern of the word-level tokenizer, over lower-cased
# printable ASCII and Latin-1 letters, and where bytes have no letter of their own.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _is_word_level(path: str) -> bool:
    """Whether the file splits and normalises as ``_PARTS`` does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == _PATTERN
            and [r["type"] for r in rest] == ["ByteLevel"] and not rest[0]["use_regex"] and not rest[0]["add_prefix_space"])


class WordEncoder:
    """Token ids of a text as little-endian 32-bit bytes, by remembered words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = _is_word_level(path)
        self.ids: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token by the library's model."""
        got = self.parts.get(part)
        if got is None:
            symbols = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
            got = self.parts[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()
        return got

    def _learn(self, words: list[bytes]) -> None:
        """Words of printable ASCII and Latin-1 letters are lower-cased and split
        here as the library would; any others go through all of its steps."""
        other = []
        for w in words:
            text = w.decode()
            if self.plain and w.isalpha():  # ASCII letters only
                self.ids[w] = self._part(text.lower())
            elif self.plain and _PLAIN.fullmatch(text) and not (b"<" in w and any(m in w for m in self.special)):
                self.ids[w] = b"".join(map(self._part, _PARTS.findall(text.lower())))
            else:
                other.append(w)
        for w, e in zip(other, self.tokenizer.encode_batch([x.decode() for x in other], add_special_tokens=False), strict=True):
            self.ids[w] = array("I", e.ids).tobytes()

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        words = [t.split() for t in texts]
        new = list(set().union(*words).difference(self.ids))
        if new:
            self._learn(new)
        get = self.ids.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for w in new:
            if len(w) > CACHE_WORD_BYTES:
                del self.ids[w]
                self.parts.clear()  # it may hold long parts too
        return out


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = SEQUENCE_TOKENS, id_col: str = "doc_id",
                    text_col: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids binary]) of every document."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        enc = WordEncoder(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        step = 4 * max_tokens
        for b in batches:
            for i, j, raw, off in chunks(b.column(1)):
                data = raw.tobytes()
                texts = [data[off[k]:off[k + 1]] for k in range(j - i)]
                ids = b.column(0).slice(i, j - i).to_pylist()
                rows = defaultdict(list)
                for d, x in zip(ids, enc.encode_many(texts), strict=True):
                    x += end
                    for p, s in enumerate(range(0, len(x), step)):
                        y = x[s:s + step]
                        rows["doc_id"].append(d)
                        rows["piece"].append(p)
                        rows["start"].append(s // 4)
                        rows["length"].append(len(y) // 4)
                        rows["ids_crc32"].append(zlib.crc32(y))
                        if keep_ids:
                            rows["ids"].append(y)
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)

    import pyarrow as pa
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema(fields + ([("ids", pa.binary())] if keep_ids else []))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)


def best_two_fit(lengths, capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths``. The unpacked lengths are bits of one
    integer (and mirrored in another), so "longest that fits" is a bit length
    and "two that sum to s" an and of both."""
    free: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        free[int(n)].append(i)
    mask = mirror = 0
    for n in free:
        mask |= 1 << n
        mirror |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal mask, mirror
        i = free[n].pop()
        if not free[n]:
            mask &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))
        return i

    bins = []
    while mask:
        gap, own = capacity, []
        while gap and (fit := mask & ((2 << gap) - 1)):
            n = fit.bit_length() - 1
            own.append((n, take(n)))
            gap -= n
        if gap and mask:
            least, at = own[-1]
            room = gap + least
            for s in range(min(room, capacity), least, -1):
                both = mask & (mirror >> (capacity - s)) & ((1 << s) - 1)
                if both and not (s % 2 == 0 and both == 1 << s // 2 and len(free[s // 2]) < 2):
                    a = both.bit_length() - 1
                    pair = [(a, take(a)), (s - a, take(s - a))]
                    own[-1:] = pair
                    free[least].append(at)
                    mask |= 1 << least
                    mirror |= 1 << (capacity - least)
                    break
        bins.append([i for _, i in own])
    return bins


def pack(pieces: DataFrame, max_tokens: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds (sequence_id, offset) to rows with ``length`` between 1 and ``max_tokens``."""
    # The dealing number is written with the rows: a repeated task deals alike,
    # and repeated rows are spread like any others.
    rows = stash(pieces.withColumn("_deal", F.monotonically_increasing_id()))
    n = max(1, -(-rows.count() // group_pieces))

    def run(pdf):
        import numpy as np
        pdf = pdf.sort_values("_deal", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        seq, off = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        for b, own in enumerate(best_two_fit(lengths, max_tokens)):
            at = 0
            for i in own:
                seq[i], off[i] = b, at
                at += lengths[i]
        pdf["sequence_id"] = (pdf["_group"].to_numpy(np.int64) << 32) + seq
        pdf["offset"] = off
        return pdf[out]

    out = [*pieces.columns, "sequence_id", "offset"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return rows.withColumn("_group", F.pmod(F.xxhash64("_deal"), F.lit(n))).groupBy("_group").applyInPandas(run, ddl)


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = SEQUENCE_TOKENS,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    return pack(tokenize_pieces(docs, tokenizer_path, max_tokens), max_tokens, group_pieces)


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
