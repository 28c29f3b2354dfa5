"""N-gram Jaccard self-join with a token-group matrix (operator 5).

A document's set is its distinct 5-word shingles (64-bit hashes); two documents
link when their sets' Jaccard similarity is 0.8 or more. The result is exact: one
component per document, no list of all copies or pairs.

1. ``signatures``: size and 128-bit fingerprint of every set. Documents of equal
   sets are one class; its smallest document represents it.
2. ``may_link``: with the tokens of a set in hash order and l(n) = 1 + n // 25,
   linked sets of sizes m <= n share at least l(m) tokens within their first
   n - ceil(0.8 n) + l(n) ones. Only these prefixes travel, cut to five bytes, in
   blocks by bucket; a document seeing fewer shared ones has no partner. Tokens
   frequent in one block travel from it once. (A collision of two cut tokens can
   only keep a document that a later step drops.)
3. Sets of the rest, tokens ordered by how many of them have each: a document's
   prefix is its n - ceil(0.8 n) + 1 rarest tokens, of which those nobody else
   has are already used up, so a common passage is rarely in a prefix.
4. Similar documents form groups: each takes as leader the document with the
   fewest unshared tokens that shares a prefix token, and one exact comparison
   with it decides the link. The linked ones of a component, and the others of a
   leader, are groups, cut to about ``GROUP`` members.
5. Token-group matrix: each group's union of tokens. A document queries a group
   with other components only through a common prefix token, the group opens only
   if the document's overlap with its union reaches 0.8 of the document's size,
   and only then are its members' overlaps counted. Pairs are compared where group
   and queries meet; only links that join components leave. Per token the documents of its
   largest component don't query: the others query that component's groups.
6. Components of all links.

Defined cases: documents without words have an empty set and are their own
component. Fewer than five words are one shingle. Repeated rows are classes like
other copies; every row is returned. Rows without doc_id are returned with a null
component. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import Words, chunks, discard, grams, mix, partitions, stash, table

SHINGLE = 5
GROUP = 64
QUERIES = 1024
_FP = np.uint64(0x2545F4914F6CDD1D)
_CUT = np.uint64((1 << 40) - 1)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a slice."""
    w = Words(raw, off)
    h = w.hashes(lower=True)
    g = grams(h, k, 5)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(g[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(grams(h[a:b], b - a, 100 + b - a) if b > a else h[:0])
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set; (0, 0) for the empty one."""
    if not len(s):
        return 0, 0
    a = int(mix(s ^ _FP).sum(dtype=np.uint64).view(np.int64))
    return a or 1, int(np.bitwise_xor.reduce(mix(s + _FP)).view(np.int64))


def least_overlap(n):
    """ceil(0.8 n): what a set of size n shares with a linked one at least."""
    return (4 * n + 4) // 5


def _lead(n):
    return 1 + n // 25


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, fp1, fp2) of every row."""
    def run(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            n, f1, f2 = [], [], []
            for _, _, raw, off in chunks(b.column(1)):
                for s in shingle_sets(raw, off):
                    a, c = fingerprint(s)
                    n.append(len(s))
                    f1.append(a)
                    f2.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())],
                                             names=["doc_id", "n", "fp1", "fp2"])

    return _docs(docs).mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long")


def may_link(docs: DataFrame) -> DataFrame:
    """(fp1, seen): tokens of each set's first ones (step 2) that other sets'
    first ones have. Never too few: copies of a set add theirs up."""
    n_buckets = 4 * partitions(docs.sparkSession)

    def post(batches) -> Iterator:
        import pyarrow as pa
        names = ["bucket", "ids", "counts", "tokens"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for b in batches:
            for i, j, raw, off in chunks(b.column(1)):
                own_sets: dict[int, np.ndarray] = {}
                for s in shingle_sets(raw, off):
                    if len(s):  # equal sets of a slice post once
                        own_sets.setdefault(fingerprint(s)[0], s)
                ids = np.array(list(own_sets), dtype=np.int64)
                sets = list(own_sets.values())
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                first = sizes - least_overlap(sizes) + _lead(sizes)
                tok = np.concatenate([s[:p] for s, p in zip(sets, first.tolist(), strict=True)])
                own = np.repeat(np.arange(len(sets)), first)
                order = np.argsort(tok, kind="stable")
                tok, own = tok[order], own[order]
                start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])[:len(tok)])
                times = np.diff(np.append(start, len(tok)))
                # Tokens met twice here are shared for their documents; one
                # posting without owner tells the others.
                here = np.repeat(times > 1, times)
                seen = np.bincount(own[here], minlength=len(sets))
                rows = [(0, ids[seen > 0].tobytes(), seen[seen > 0].astype(np.int32).tobytes(), b"")]
                own = own[start]
                tok, who = tok[start], np.where(times > 1, 0, ids[own])
                bucket = ((tok >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
                order = np.lexsort((who, bucket))  # by owner: an owner is written once per bucket
                tok, who, bucket = tok[order] & _CUT, who[order], bucket[order]
                edge = np.searchsorted(bucket, np.arange(n_buckets + 1))
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    w, t = who[edge[k]:edge[k + 1]], tok[edge[k]:edge[k + 1]]
                    s = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                    rows.append((k, w[s].tobytes(), np.diff(np.append(s, len(w))).astype(np.int32).tobytes(),
                                 np.ascontiguousarray(t.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def meet(batches) -> Iterator:
        import pyarrow as pa
        held: list[tuple[np.ndarray, np.ndarray]] = []
        key = None

        def out(ids, n):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["fp1", "seen"])

        def close():
            tok = np.concatenate([h[0] for h in held])
            who = np.concatenate([h[1] for h in held])
            held.clear()
            order = np.lexsort((who, tok))
            tok, who = tok[order], who[order]
            # One row per token and owner: copies elsewhere have the same owner.
            once = np.concatenate([[True], (tok[1:] != tok[:-1]) | (who[1:] != who[:-1])])
            tok, who = tok[once], who[once]
            start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            times = np.diff(np.append(start, len(tok)))
            # Owner 0 stands for several sets of one slice.
            shared = np.repeat((times > 1) | (who[start] == 0), times)
            return out(*np.unique(who[shared & (who != 0)], return_counts=True))

        for b in batches:
            for k, ids, counts, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, counts = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)
                if not tokens:
                    if len(ids):
                        yield out(ids, counts.astype(np.int64))
                    continue
                if k != key and held:
                    yield close()
                key = k
                t = np.zeros((len(tokens) // 5, 8), np.uint8)
                t[:, :5] = np.frombuffer(tokens, np.uint8).reshape(-1, 5)
                held.append((t.view(np.uint64).ravel(), np.repeat(ids, counts)))
        if held:
            yield close()

    posted = _docs(docs).filter("doc_id is not null").mapInArrow(post, "bucket int, ids binary, counts binary, tokens binary")
    met = posted.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "fp1 long, seen long")
    return met.groupBy("fp1").agg(F.sum("seen").alias("seen"))


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for i, j, raw, off in chunks(b.column(1)):
                sets = shingle_sets(raw, off)
                sizes = [len(s) for s in sets]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes, pa.int64()),
                                                  pa.ListArray.from_arrays(at, pa.array(flat))], names=["doc_id", "n", "tokens"])

    return _docs(docs).mapInArrow(run, "doc_id long, n long, tokens array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link; exact, on whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ta", "tb")))
    return both.filter(100 * F.col("o") >= 80 * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, comp): the smallest document reachable over ``links`` (a, b).

    Every round hooks each component to the smallest neighbouring one and then
    follows the pointers; the tables are written each round."""
    edges = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    label = stash(edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().withColumn("comp", F.col("doc_id")))
    while True:
        la = label.select(F.col("doc_id").alias("a"), F.col("comp").alias("ca"))
        lb = label.select(F.col("doc_id").alias("b"), F.col("comp").alias("cb"))
        open_ = stash(edges.join(la, "a").join(lb, "b").filter("ca <> cb").select("ca", "cb").distinct())
        if open_.isEmpty():
            return label
        # comp -> smallest comp next to it (a forest: always to a smaller one)
        hook = open_.select(F.greatest("ca", "cb").alias("comp"), F.least("ca", "cb").alias("to")).groupBy("comp").agg(F.min("to").alias("to"))
        hook = stash(hook)
        while True:  # pointer jumping
            up = hook.select(F.col("comp").alias("to"), F.col("to").alias("up"))
            jumped = hook.join(up, "to", "left").select("comp", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved"))
            jumped = stash(jumped)
            discard(hook)
            hook = jumped.select("comp", "to")
            hook._stash_path = jumped._stash_path
            if jumped.filter("moved").isEmpty():
                break
        new = stash(label.join(hook, "comp", "left").select("doc_id", F.coalesce("to", "comp").alias("comp")))
        discard(label, open_, hook)
        label = new


def group_links(q_ids, q_comps, q_tokens, ids, comps, tokens) -> list[tuple[int, int]]:
    """Links between queries and a group's members of other components, as far as
    they join documents that the links before them don't.

    The group's matrix has a row per token of its union: the members with it."""
    sizes = np.array([len(t) for t in tokens])
    union, row = np.unique(np.concatenate(tokens), return_inverse=True)
    who = np.repeat(np.arange(len(ids)), sizes)[np.argsort(row, kind="stable")]
    edge = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(union)))])
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, ca, q in zip(q_ids, q_comps, q_tokens, strict=True):
        at = np.searchsorted(union, q)
        at[at == len(union)] = 0
        at = at[union[at] == q]
        if len(at) < least_overlap(len(q)):  # the union can't reach the threshold
            continue
        n = edge[at + 1] - edge[at]
        cells = np.repeat(edge[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(who[cells], minlength=len(ids))
        for k in np.flatnonzero(100 * both >= 80 * (len(q) + sizes - both)).tolist():
            if comps[k] != ca and find(comps[k]) != find(ca):
                up[find(comps[k])] = find(ca)
                out.append((int(a), int(ids[k])))
    return out


def _open_groups(ask: DataFrame, member: DataFrame, sets: DataFrame, key: list[str], queries: int = QUERIES) -> DataFrame:
    """Links (a, b) of the asked (document, group) pairs. Each group's members
    meet its queries in parts of about ``queries``."""
    parts = ask.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / queries).alias("parts"))
    asked = ask.join(parts, key).join(sets.select(F.col("doc_id").alias("a"), "tokens"), "a").select(
        *key, F.pmod(F.xxhash64("a"), "parts").alias("q"), "a", "ca", F.col("tokens").alias("asked"))
    members = member.join(parts, key).join(sets.select("doc_id", "tokens"), "doc_id").select(
        *key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"), "doc_id", "comp", F.col("tokens").alias("held"))

    def run(left, right):
        import pandas as pd
        found = group_links(left["a"], left["ca"], left["asked"], right["doc_id"].tolist(), right["comp"].tolist(),
                            right["held"].tolist()) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return asked.groupBy(*key, "q").cogroup(members.groupBy(*key, "q")).applyInPandas(run, "a long, b long")


def link_representatives(docs: DataFrame, reps: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, comp) of the representatives that link (steps 3 to 6)."""
    sets = stash(_sets(docs.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"])))
    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = tokens.join(shared, "token").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("own"))
    ranked = ranked.withColumn("take", F.col("n") - least_overlap_col("n") + 1 - F.col("alone")).filter("take > 0")
    prefix = stash(ranked.select("doc_id", "n", "alone", F.explode(F.slice("own", F.lit(1), F.col("take").cast("int"))).alias("t"))
                   .select("doc_id", "n", "alone", "t.token"))
    # Leaders: fewest unshared tokens for their size, then the smallest id.
    rank = F.struct((F.col("alone") / F.col("n")).alias("r"), F.col("doc_id").alias("d"))
    lead = prefix.groupBy("token").agg(F.min(rank).alias("lead"))
    chosen = prefix.join(lead, "token").groupBy("doc_id").agg(F.min("lead").alias("lead")).select(
        F.col("doc_id").alias("a"), F.col("lead.d").alias("b")).filter("a <> b")
    star = stash(_linked(chosen, sets))
    comp = components(star)
    # Groups of at most about ``group`` documents: of one component, or of
    # documents without a link yet that have the same leader.
    lone = F.col("comp").isNull()
    every = prefix.select("doc_id", "n").distinct().join(comp, "doc_id", "left").join(
        chosen.select(F.col("a").alias("doc_id"), F.col("b").alias("leader")), "doc_id", "left")
    every = every.select("doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"), lone.alias("lone"),
                         F.when(lone, F.coalesce("leader", "doc_id")).otherwise(F.col("comp")).alias("gid"))
    size = every.groupBy("lone", "gid").agg(F.count(F.lit(1)).alias("size"))
    member = stash(every.join(size, ["lone", "gid"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / group))).select(
        "doc_id", "n", "comp", "lone", "gid", "part"))
    key = ["lone", "gid", "part"]
    where = stash(prefix.select("token", "doc_id").join(member, "doc_id"))
    per = where.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    active = per.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("big"), F.count(F.lit(1)).alias("k")).filter("k > 1").select(
        "token", F.col("big.comp").alias("big"))
    queries = where.join(active, "token").filter("comp <> big").select("token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    groups = where.join(active.select("token"), "token", "left_semi").groupBy("token", *key).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    near = (((F.col("c0") != F.col("ca")) | (F.col("c1") != F.col("ca"))) & (F.col("hi") >= least_overlap_col("na"))
            & (F.col("na") >= least_overlap_col("lo")))
    g = groups.withColumnRenamed("token", "_token")
    ask = queries.join(g, (F.col("token") == F.col("_token")) & near).select("a", "na", "ca", *key).distinct()
    ask = stash(ask)
    links = star
    if not ask.isEmpty():
        links = star.unionByName(_open_groups(ask, member, sets, key))
    return components(links)


def least_overlap_col(n: str):
    return F.expr(f"(4 * {n} + 4) div 5")


def jaccard_components(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    sig = stash(signatures(docs))
    named = sig.filter("n > 0 and doc_id is not null")
    maybe = may_link(docs).select(F.col("fp1").alias("_f"), "seen")
    enough = F.col("seen") >= 1 + F.expr("((4 * n + 4) div 5) div 25")
    classes = stash(named.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
                    .join(maybe, F.col("fp1") == F.col("_f"), "left").withColumn("m", F.coalesce(enough, F.lit(False))).drop("_f", "seen"))
    comp = link_representatives(docs, classes.filter("m").select(F.col("rep").alias("doc_id")), group)
    # Classes of one document that links with nothing need no row here.
    moved = classes.join(comp, F.col("rep") == F.col("doc_id"), "left").select(
        "n", "fp1", "fp2", "size", "rep", F.coalesce("comp", "rep").alias("comp")).filter("size > 1 or comp <> rep").select("n", "fp1", "fp2", "comp")
    return sig.join(moved, ["n", "fp1", "fp2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
