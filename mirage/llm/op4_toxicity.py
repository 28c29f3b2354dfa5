"""Toxicity by noisy-channel deobfuscation (operator 4).

1. Character language model: letter trigrams of the words of all documents,
   counted in every task and summed by key. Letters are a-z, 37 classes of other
   letters, and the word edge, so the table has at most 64**3 counts.
2. Restoring a token: every character is a column of a lattice - a letter stands
   for itself, a leet sign for its letters (at a cost), a mark inside a word for
   a vowel or nothing, a letter after the same one for itself or nothing (at a
   cost, less in a run of three or more). Every sign of a token of leet signs only
   stands for a letter. Viterbi finds the best path under the language model.
   Tokens of one or two signs in a row, three or more of them of one, are one
   lattice with an optional word edge before each token, mark-only tokens left out;
   all its words count. Tokens with a single path need no search. Results are
   remembered in a bounded table.
3. Score: a logistic model over the restored words and their 4- and 5-letter
   beginnings (presence in the text, weights not negative), fitted to at most
   ``TRAIN_ROWS`` labelled rows, the first by hash of the id. Rows whose
   crc32(doc_id as text) mod 3 is 1 are never used for fitting.

Defined cases: null or empty text has no words and gets the model's base score.
Labels without doc_id or value are left out; a doc_id labelled twice counts as
toxic if one label says so. Without any labelled row of either kind all scores
are the base score 0.05. Repeated rows are scored alike. A row without doc_id is
scored, not held out. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import chunks, stash, table

TRAIN_ROWS = 16_000
THRESHOLD = 0.7
CACHE_TOKENS = 200_000
FEATURE_BITS = 20
LEAST_USES, LEAST_RATIO = 3, 5  # of a feature in toxic rows
SYMBOLS = 64
# What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
VOWELS = "aeiou"
SIGN_COST, DROP_COST, END_COST, RUN_COST, DOUBLE_COST, GUESS_COST = 1.0, 5.0, 1.5, 0.5, 2.0, 2.5
_EDGE_RUN = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")
_DOUBLED = re.compile(r"(.)\1")
_RUN = re.compile("[12m]*1[12m]*")
_EDGES = "\"'.,;:?)]}[{<>«»“”„…-_*%&#~^=/\\"


def _letter_codes() -> np.ndarray:
    """Code of every code point: 0 no letter, 1-26 a-z, 27-63 other letters."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x30000):
        if chr(cp).isalpha():
            out[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % 37
    return out


_CODES: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    if not _CODES:
        _CODES.append(_letter_codes())
    return _CODES[0]


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(trigram, n) over all words of the column ``text``."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        codes = letter_codes()
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for b in batches:
            for _, _, raw, off in chunks(b.column(0)):
                data = raw.tobytes()
                text = "\n\n".join(data[off[k]:off[k + 1]].decode() for k in range(len(off) - 1)).lower()
                c = codes[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
                c = np.concatenate([[0, 0], c, [0, 0]])
                # Between two words lie two edges or more: one gap sign is doubled.
                single = np.flatnonzero((c[1:-1] == 0) & (c[:-2] > 0) & (c[2:] > 0)) + 1
                c = np.insert(c, single, 0)
                t = (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]
                total += np.bincount(t[(c[1:-1] > 0) | (c[2:] > 0)], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["trigram", "n"])

    return texts.select("text").mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b), smoothed with the bigram and unigram, [64, 64, 64]."""
    n = np.zeros(SYMBOLS ** 3)
    for r in trigram_counts(docs).collect():  # at most 64**3 rows
        n[r["trigram"]] = r["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    bi, uni = n.sum(0), n.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def signs_only(token: str) -> bool:
    return len(token) > 1 and all(ch in LEET for ch in token)


def columns(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a lower-cased token: per character (letter or '', cost)."""
    out = []
    n = len(token)
    signs = signs_only(token)
    for i, ch in enumerate(token):
        if ch.isalpha():
            run = i and token[i - 1] == ch and (i + 1 < n and token[i + 1] == ch or i > 1 and token[i - 2] == ch)
            twice = i and token[i - 1] == ch
            out.append([(ch, 0.0), ("", RUN_COST if run else DOUBLE_COST)] if twice else [(ch, 0.0)])
        elif ch in LEET:
            drop = [] if signs else [("", DROP_COST if 0 < i < n - 1 else END_COST)]
            out.append([(x, SIGN_COST) for x in LEET[ch]] + drop)
        elif ch == "*" and 0 < i < n - 1:
            out.append([(x, GUESS_COST) for x in VOWELS] + [("", DROP_COST)])
        else:
            out.append([("", 0.0)])
    return out


def restore(token: str, model: np.ndarray | list[float], edges: frozenset[int] = frozenset()) -> str:
    """Viterbi over the lattice; a state is the last two letters a, b, numbered as
    64 a + b. At the positions ``edges`` a word may end and another begin; words are
    joined by a space. ``model``: log P(c | a, b) at 64 (64 a + b) + c."""
    codes = letter_codes()
    model = model if isinstance(model, list) else model.ravel().tolist()
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for i, options in enumerate(columns(token)):
        if i in edges:
            ends = [(s + model[state << 6], path) for state, (s, path) in best.items() if state & 63]
            if ends:
                s, path = max(ends, key=lambda e: e[0])
                if 0 not in best or s > best[0][0]:
                    best[0] = (s, (path, " "))
        coded = [(letter, int(codes[ord(letter)]) if letter else 0, cost) for letter, cost in options]
        nxt: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in best.items():
            for letter, c, cost in coded:
                if letter:
                    to, s, t = (state & 63) << 6 | c, score + model[state << 6 | c] - cost, (path, letter)
                else:
                    to, s, t = state, score - cost, path
                old = nxt.get(to)
                if old is None or s > old[0]:
                    nxt[to] = (s, t)
        best = nxt
    path = max(((s + model[state << 6], t) for state, (s, t) in best.items()), key=lambda e: e[0])[1]
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def core(token: str) -> str:
    """A token without punctuation and long runs of one sign at its ends."""
    before = None
    while token != before:
        before = token
        token = _EDGE_RUN.sub("", token).strip(_EDGES)
    return token.rstrip("!+|(") if len(token) > 1 and token[-1] in "!+|(" and token[:-1].isalpha() else token


class Restorer:
    """Restored words of a text."""

    def __init__(self, model: np.ndarray):
        self.model = model.ravel().tolist()
        self.known: dict[str, tuple[str, str, str]] = {}
        self.runs: dict[str, str] = {}

    def word(self, token: str) -> str:
        return self._token(token)[0]

    def _token(self, token: str) -> tuple[str, str, str]:
        """(restored word, kind, core); kind: "m" a mark alone, "1" one sign, "2" two
        signs, "w" any other word. Short tokens are remembered."""
        got = self.known.get(token)
        if got is None:
            t = core(token)
            plain = t.isalpha() and not _DOUBLED.search(t)
            word = t if plain else restore(t, self.model) if signs_only(t) or any(ch.isalpha() for ch in t) else ""
            kind = "w"
            if not any(ch.isalnum() or ch in LEET for ch in token):
                kind = "m"
            elif 0 < len(t) <= 2 and all(ch.isalpha() or ch in LEET for ch in t):
                kind = str(len(t))
            got = word, kind, t
            if len(token) <= 64:
                if len(self.known) >= CACHE_TOKENS:
                    self.known.clear()
                self.known[token] = got
        return got

    def spaced(self, run: list[str]) -> list[str]:
        """Words of a run of short tokens."""
        key = " ".join(run)
        got = self.runs.get(key)
        if got is None:
            starts = np.cumsum([len(t) for t in run]).tolist()
            got = restore("".join(run), self.model, frozenset(starts[:-1]))
            if len(key) <= 64:
                if len(self.runs) >= CACHE_TOKENS:
                    self.runs.clear()
                self.runs[key] = got
        return got.split()

    def words(self, text: str) -> set[str]:
        tokens = text.lower().split()
        own = {t: self._token(t) for t in set(tokens)}  # one lookup per distinct token
        out = {w for w, _, _ in own.values()}
        kinds = "".join([own[t][1] for t in tokens])
        for m in _RUN.finditer(kinds):
            if m.group().count("1") > 2:
                out.update(self.spaced([own[t][2] for t in tokens[m.start():m.end()] if own[t][1] != "m"]))
        out.discard("")
        return out


_RESTORERS: dict[bytes, Restorer] = {}


def restorer(model: np.ndarray) -> Restorer:
    """One for all tasks of a Python worker that use the same model."""
    key = hashlib.blake2b(model.tobytes()).digest()
    if key not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[key] = Restorer(model)
    return _RESTORERS[key]


def features(word: str) -> list[str]:
    return [word] + [f"{k} {word[:k]}" for k in (4, 5) if len(word) > k]


def feature_id(f: str) -> int:
    return zlib.crc32(f.encode()) & ((1 << FEATURE_BITS) - 1)


def fit(rows: list[tuple[np.ndarray, int]]) -> tuple[dict[int, float], float]:
    """Logistic weights (none negative) of presence features, and the base."""
    y = np.array([t for _, t in rows], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return {}, float(np.log(0.05 / 0.95))
    doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feat = np.concatenate([f for f, _ in rows]).astype(np.int64)
    size = 1 << FEATURE_BITS
    pos = np.bincount(feat, weights=y[doc], minlength=size)
    neg = np.bincount(feat, weights=1 - y[doc], minlength=size)
    use = (pos >= LEAST_USES) & (pos / y.sum() > LEAST_RATIO * neg / (1 - y).sum())
    keep = use[feat]
    doc, feat = doc[keep], feat[keep]
    names, col = np.unique(feat, return_inverse=True)
    w, bias = np.zeros(len(names)), -2.0
    rows_weight = np.where(y > 0, (1 - y).sum() / y.sum(), 1.0)  # both classes weigh the same
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, 401):  # Adam, projected to non-negative weights
        z = bias + np.bincount(doc, weights=w[col], minlength=len(y))
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * rows_weight
        g = np.append(np.bincount(col, weights=r[doc], minlength=len(names)) + 0.1 * w, r.sum() + 0.01 * bias)
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        move = 0.05 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
        w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]
    return {int(k): float(v) for k, v in zip(names, w, strict=True) if v > 1e-3}, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, model: np.ndarray, rows: int) -> list[tuple[np.ndarray, int]]:
    """(feature ids, toxic) of the labelled rows, with the features that ``fit`` may
    use: they are counted in Spark, and only those are collected."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches) -> Iterator:
        import pyarrow as pa
        r = restorer(model)
        for b in batches:
            ids = [sorted({feature_id(f) for w in r.words(t or "") for f in features(w)}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), b.column(1)], names=["ids", "toxic"])

    # ``some`` has at most ``rows`` rows of two numbers.
    picked = stash(docs.join(F.broadcast(some), "doc_id").select("text", "toxic").mapInArrow(run, "ids array<int>, toxic int"))
    size = picked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not size["pos"] or size["pos"] == size["n"]:
        return [(np.zeros(0, np.int32), r["toxic"]) for r in picked.select("toxic").collect()]
    counts = picked.select("toxic", F.explode("ids").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    # At most 2 ** FEATURE_BITS ids; the rule is that of ``fit``.
    used = counts.filter((F.col("pos") >= LEAST_USES) & (
        F.col("pos") / F.lit(float(size["pos"])) > LEAST_RATIO * (F.col("n") - F.col("pos")) / F.lit(float(size["n"] - size["pos"])))).select("f")
    use = np.zeros(1 << FEATURE_BITS, dtype=bool)
    use[[r["f"] for r in used.collect()]] = True

    def only_used(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            ids = [np.array(x, dtype=np.int32) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[use[x]].tobytes() for x in ids], pa.binary()), b.column(1)], names=["ids", "toxic"])

    got = sorted((bytes(x["ids"]), x["toxic"]) for x in picked.mapInArrow(only_used, "ids binary, toxic int").collect())
    return [(np.frombuffer(i, dtype=np.int32), t) for i, t in got]


def held_out(c: str):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = language_model(docs)
    weights, bias = fit(training_rows(docs, labels, model, train_rows))

    def run(batches) -> Iterator:
        import pyarrow as pa
        r = restorer(model)
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            scores = []
            for i, j, raw, off in chunks(b.column(1)):
                data = raw.tobytes()
                for k in range(j - i):
                    hit: set[int] = set()
                    for w in r.words(data[off[k]:off[k + 1]].decode()):
                        f = known.get(w)
                        if f is None:
                            if len(known) >= CACHE_TOKENS:
                                known.clear()
                            f = known[w] = tuple(x for x in map(feature_id, features(w)) if x in weights)
                        if f:
                            hit.update(f)
                    z = bias + sum(weights[x] for x in sorted(hit))
                    scores.append(1 / (1 + float(np.exp(-max(min(z, 40.0), -40.0)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
