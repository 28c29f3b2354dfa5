"""SimHash fingerprints and Hamming search (operator 10, DataFrame functions only).

Terms are pairs of neighbouring words (a text of one word: the word), weighted by
their length in characters (at most 40). Each term's 64-bit hash votes with its
weight on every bit; the fingerprint keeps the bits with more than half the votes.
The votes are summed as ordinary aggregates, two 32-bit counters in one long, so
they combine before the shuffle and hold up to 2**32 of weight in a text.

Search: a second fingerprint has the text's distinct words as terms, weighted the
same way: an edited word moves it by fewer bits than two word pairs do, and words
that every text repeats don't make texts alike. The 64 bits are cut into ``BLOCKS``
blocks; fingerprints that differ in at most ``RADIUS`` bits differ in at most
``RADIUS // BLOCKS`` bits of some block, so a query asks for each of its blocks with
that many bits flipped. Equal fingerprints are one class, represented by their
smallest doc_id (``representative``). Queries are the classes with a doc_id divisible
by ``QUERY_EVERY``, held against all classes: a query document has the
representatives within ``RADIUS`` (``near_ids``) and the number of other documents
within it (``near_docs``); every document has the least query doc_id of another
class within ``RADIUS`` (``near_query``). A pair is taken from the first block that
has it, and no pair of two documents that are not queries is made.

Defined cases: null text is empty; an empty text's fingerprint is 0. Texts are read
whole at any length, and every row is returned, repeated ones too. A row without
doc_id has no next document (its edited text is its own, near_next 0), is no query and
represents no class. Next is by distinct doc_id; if the next id has several texts the
least prefix counts. An empty table gives an empty result. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirage.llm.common import partitions, stash, table, word_array

RADIUS = 7
BLOCKS = 4
QUERY_EVERY = 20
MAX_WEIGHT = 40


def _no_terms():
    return F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("n")))


def _terms(text):
    """array<struct<h, n>> of a text's weighted terms."""
    def pairs(w):
        return F.transform(w, lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1)).alias("h"),
            F.least(F.length(x) + F.length(F.coalesce(F.get(w, i + 1), F.lit(""))), F.lit(MAX_WEIGHT)).alias("n")))

    out = F.transform(F.array(word_array(text)), lambda w: F.when(F.size(w) == 0, _no_terms()).when(
        F.size(w) == 1, pairs(w)).otherwise(F.slice(pairs(w), F.lit(1), F.size(w) - 1)))
    return out[0]


def _search_terms(text):
    """array<struct<h, n>> of a text's distinct words."""
    out = F.transform(F.array_distinct(word_array(text)), lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.least(F.length(x), F.lit(MAX_WEIGHT)).alias("n")))
    return F.when(F.size(out) == 0, _no_terms()).otherwise(out)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text", terms=_terms) -> DataFrame:
    """(keys, fp long, weight long) per distinct key, all of whose texts vote;
    ``weight`` is that of all terms."""
    votes = texts.select(*keys, F.explode(terms(F.col(text_col))).alias("t")).select(*keys, "t.h", F.col("t.n").cast("long").alias("n"))
    two = (1 << 32) + 1
    lanes = votes.groupBy(*keys).agg(F.sum("n").alias("_all"), *[
        F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(two)) * F.col("n")).alias(f"v{b}") for b in range(32)])
    bits = []
    for b in range(32):
        low, high = F.col(f"v{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{b}", 32)
        bits += [F.when(2 * low > F.col("_all"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long"),
                 F.when(2 * high > F.col("_all"), F.lit((1 << (b + 32)) - ((1 << 64) if b == 31 else 0))).otherwise(F.lit(0)).cast("long")]
    fp = bits[0]
    for x in bits[1:]:
        fp = fp.bitwiseOR(x)
    return lanes.select(*keys, fp.alias("fp"), F.col("_all").alias("weight"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) over the distinct, non-null doc_ids in ascending order,
    the last followed by the first. Partitions are ranges of ids; only each
    partition's first id meets in one small window."""
    n = partitions(ids.sparkSession)
    part = stash(ids.select("doc_id").filter("doc_id is not null").distinct().repartitionByRange(n, "doc_id")
                 .withColumn("_p", F.spark_partition_id()))
    first = part.groupBy("_p").agg(F.min("doc_id").alias("_first"))
    follow = first.select("_p", F.lead("_first").over(Window.orderBy("_p")).alias("_follow"), F.min("_first").over(Window.partitionBy()).alias("_least"))
    inside = F.lead("doc_id").over(Window.partitionBy("_p").orderBy("doc_id"))
    return part.withColumn("_in", inside).join(follow, "_p").select("doc_id", F.coalesce("_in", "_follow", "_least").alias("next_id"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, text, n_chars, edited): the last quarter replaced by the
    beginning of the next document."""
    every = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The same rows and columns in both joins: the texts are shuffled once.
    d = every.filter("doc_id is not null")
    size = d.select("doc_id", F.length("text").alias("n"))
    order = stash(next_ids(size))
    need = size.groupBy("doc_id").agg((F.max("n") / 4).cast("int").alias("k")).join(order, "doc_id")
    give = d.join(need.select(F.col("doc_id").alias("_to"), F.col("next_id").alias("doc_id"), "k"), "doc_id")
    prefix = give.groupBy(F.col("_to").alias("doc_id")).agg(F.min(F.expr("substring(text, 1, k)")).alias("_prefix"))
    keep = F.expr("substring(text, 1, length(text) - length(text) div 4)")
    got = F.expr("substring(_prefix, 1, cast(length(text) div 4 as int))")
    n = F.length("text").cast("long").alias("n_chars")
    out = d.join(prefix, "doc_id").join(order, "doc_id").select("doc_id", "next_id", "text", n, F.concat(keep, got).alias("edited"))
    alone = every.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("next_id"), "text", n, F.col("text").alias("edited"))
    return out.unionByName(alone)


def likeness(a, b):
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_fingerprints(queries: DataFrame, every: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (q, fp, n) of different fingerprints within ``radius`` bits.

    ``queries``: distinct (q). ``every``: distinct (fp, n)."""
    masks = _block_masks(blocks)
    flips = radius // blocks

    def keyed(col, most):
        asked = []
        for t, m in enumerate(masks):
            bits = [1 << b for b in range(64) if m >> b & 1]
            low = bits[0].bit_length() - 1
            asked += [(t, _signed(m), _signed(sum(c)), low) for k in range(most + 1) for c in combinations(bits, k)]
        e = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("m"), F.lit(x).cast("long").alias("x"),
                                         F.lit(low).alias("low")) for t, m, x, low in asked])).alias("e")
        return e, F.expr(f"shiftrightunsigned(({col} & e.m) ^ e.x, e.low) * {blocks} + e.t")

    ask, kq = keyed("q", flips)
    held, kf = keyed("fp", 0)
    a = queries.select("q", ask).select("q", kq.alias("kq"))
    b = every.select("fp", "n", held).select("fp", "n", kf.alias("kf"))
    x = F.col("q").bitwiseXOR(F.col("fp"))
    # The first block with the pair.
    first = F.coalesce(*[F.when(F.bit_count(x.bitwiseAND(F.lit(_signed(m)))) <= flips, F.lit(t)) for t, m in enumerate(masks)])
    return a.join(b, (F.col("kq") == F.col("kf")) & (F.col("q") != F.col("fp")) & (F.bit_count(x) <= radius)
                  & (first == F.col("kq") % blocks)).select("q", "fp", "n")


def simhash_report(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, every: int = QUERY_EVERY) -> DataFrame:
    """Fingerprints of texts and edited texts and their likeness, and what the search
    of the documents with ids divisible by ``every`` finds; one row per row."""
    e = edited_texts(docs).withColumn("edited_sha", F.unhex(F.sha2("edited", 256))).withColumn(
        "text_sha", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    keys = ["doc_id", "next_id", "n_chars", "text_sha", "edited_sha"]
    # The last are no text's terms: their weight is the number of equal rows.
    voted = [_terms(F.col("text")), _terms(F.col("edited")), _search_terms(F.col("text")),
             F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(1).alias("n")))]
    all_terms = e.select(*keys, F.explode(F.array(*[F.struct(F.lit(w).alias("w"), t.alias("x")) for w, t in enumerate(voted)])).alias("b"))
    fps = fingerprints(all_terms.select(*keys, F.col("b.w").alias("w"), F.col("b.x").alias("terms")), [*keys, "w"], "terms", lambda t: t)
    f = stash(fps.groupBy(*keys).agg(*[F.max(F.when(F.col("w") == w, F.col("fp"))).alias(c) for w, c in enumerate(("fp", "ef", "sf"))],
                                     F.max(F.when(F.col("w") == 3, F.col("weight"))).alias("copies")))
    nxt = f.groupBy(F.col("doc_id").alias("_n")).agg(F.min("fp").alias("nf"))
    asks = F.col("doc_id") % every == 0
    classes = stash(f.groupBy("sf").agg(F.sum("copies").alias("n"), F.min("doc_id").alias("rep"), F.min(F.when(asks, F.col("doc_id"))).alias("ask")))
    near = stash(near_fingerprints(classes.filter("ask is not null").select(F.col("sf").alias("q")),
                                   classes.select(F.col("sf").alias("fp"), F.struct("n", "rep").alias("n")), radius, blocks))
    partners = near.groupBy(F.col("q").alias("_q")).agg(F.sum("n.n").alias("m"), F.sort_array(F.collect_list("n.rep")).alias("ids"))
    asking = near.join(classes.select(F.col("sf").alias("_a"), "ask"), F.col("q") == F.col("_a")).groupBy(F.col("fp").alias("_f")).agg(
        F.min("ask").alias("near_query"))
    found = classes.join(partners, F.col("sf") == F.col("_q"), "left").join(asking, F.col("sf") == F.col("_f"), "left").select(
        F.col("sf").alias("_sf"), F.col("rep").alias("representative"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("near"),
        F.coalesce("ids", F.array().cast("array<long>")).alias("ids"), "near_query")
    known = f.join(found, F.col("sf") == F.col("_sf")).select(
        *keys, "fp", "ef", "sf", "copies", "representative", "near_query", F.when(asks, F.col("near")).alias("near_docs"),
        F.when(asks, F.col("ids")).alias("near_ids"))

    def text_of(c):
        return F.lpad(F.lower(F.hex(c)), 16, "0")

    return known.join(nxt, F.col("next_id") == F.col("_n"), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"), text_of("fp").alias("fingerprint"),
        text_of("ef").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("ef")).alias("near_edited"),
        F.coalesce(likeness(F.col("fp"), F.col("nf")), F.lit(0.0)).alias("near_next"), "near_docs",
        text_of("sf").alias("search_fingerprint"), "representative", "near_ids", "near_query")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(table(spark, sf_dir, "documents"))
