"""Temperature mixing of sources (operator 8, DataFrame functions only).

A source's weight is its token share to the power t, normalised; t = 1 keeps the
shares, t = 0 gives equal weights. t is bisected in [0, 1]: to the smallest t at
which no source is repeated more than ``max_repeats`` times, or (``entropy``) to
the largest t at which the weights' entropy reaches that part of its maximum. A
step is an aggregation over the table of sources; the next ``LEVELS`` steps of
the binary search are looked up in one job.

The budget of a source is its weight times the total. It is realised by blocks:
documents are dealt into blocks of about ``BLOCK`` rows by hash, blocks and the
documents in a block are put in a pseudo-random order (md5 of seed, source and
id). All documents are taken floor(budget / tokens) times; the rest of the budget
takes documents in permuted order while the tokens before them are under it. Only
block totals meet in one window, so no source passes through one task.

``total='tokens'`` keeps the corpus size; ``total='cover'`` is the smallest total
in which every source gets at least its own tokens (no document is left out).

Defined cases: tokens are words; null and empty texts have none. A source without
tokens is taken once, outside the weights. Null source is a source of its own,
null doc_id orders as an empty id. Repeated rows are dealt together and taken by
the same rule. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirage.llm.common import stash, table, word_array

SEED = 17
BLOCK = 4096
STEPS = 40
LEVELS = 5
MAX_REPEATS = 1.25


def _midpoints(lo: float, hi: float, depth: int) -> list[float]:
    if not depth:
        return []
    mid = (lo + hi) / 2
    return _midpoints(lo, mid, depth - 1) + [mid] + _midpoints(mid, hi, depth - 1)


def _grid(sources: DataFrame, points: list[float]) -> dict[float, dict[str, float]]:
    """t -> repeats of the most repeated source at the corpus size and at the
    covering size, entropy of the weights, number of sources."""
    at = F.explode(F.array(*[F.lit(t) for t in points])).alias("t")
    rows = sources.filter("tokens > 0").select("share", at).withColumn("p", F.pow("share", "t")).groupBy("t").agg(
        F.sum("p").alias("z"), F.sum(F.col("p") * F.log("share") * F.col("t")).alias("l"), F.count(F.lit(1)).alias("k"),
        F.max(F.col("p") / F.col("share")).alias("most"), F.min(F.col("p") / F.col("share")).alias("least")).collect()  # a row per point
    return {x["t"]: {"tokens": x["most"] / x["z"], "cover": x["most"] / x["least"],
                     "entropy": math.log(x["z"]) - x["l"] / x["z"], "k": x["k"]} for x in rows}


def temperature(sources: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
                total: str = "tokens", steps: int = STEPS, levels: int = LEVELS) -> float:
    """The exponent for ``sources`` (columns share, tokens)."""
    def flat_enough(x) -> bool:
        """Whether t may rise (entropy), or must (repeats)."""
        return x["entropy"] >= entropy * math.log(x["k"]) if entropy is not None else x[total] > max_repeats

    ends = _grid(sources, [0.0, 1.0])
    if not ends or flat_enough(ends[1.0]):
        return 1.0
    if not flat_enough(ends[0.0]):
        return 0.0
    lo, hi, done = 0.0, 1.0, 0
    while done < steps:
        grid = _grid(sources, _midpoints(lo, hi, levels))
        for _ in range(min(levels, steps - done)):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if flat_enough(grid[mid]) else (lo, mid)
            done += 1
    return lo if entropy is not None else hi


def source_table(rows: DataFrame) -> DataFrame:
    """(source, docs, tokens, share) of ``rows`` (source, doc_id, tokens)."""
    per = stash(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))
    total = per.agg(F.sum("tokens").alias("t")).collect()[0]["t"] or 1
    return per.withColumn("share", F.col("tokens") / F.lit(float(total)))


def budgets(sources: DataFrame, t: float, total: str = "tokens") -> DataFrame:
    """Adds whole passes ``q`` and the rest ``rem`` of each source's budget."""
    p = F.pow(F.col("share"), F.lit(t))
    z = sources.filter("tokens > 0").agg(F.sum(p).alias("z"), F.sum("tokens").alias("t"), F.max(F.col("tokens") / p).alias("c")).collect()[0]
    if z["z"] is None:
        return sources.withColumn("budget", F.lit(0).cast("long")).withColumn("q", F.lit(1).cast("long")).withColumn("rem", F.lit(0).cast("long"))
    size = float(z["t"]) / z["z"] if total == "tokens" else z["c"]
    out = sources.withColumn("budget", F.round(p * F.lit(size)).cast("long"))
    some = F.col("tokens") > 0
    return (out.withColumn("q", F.when(some, F.expr("budget div tokens")).otherwise(F.lit(1)))
            .withColumn("rem", F.when(some, F.expr("budget % tokens")).otherwise(F.lit(0))))


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, total: str = "tokens",
        seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, n_tokens, source_budget, copies) of every distinct
    (doc_id, source); ``copies`` is 0 where the mix leaves a document out."""
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                             F.size(word_array(F.col("text"))).cast("long").alias("tokens"))
                 .groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens")))
    sources = source_table(rows)
    planned = stash(budgets(sources, temperature(sources, max_repeats, entropy, total), total).select(
        F.col("source").alias("_s"), "docs", "budget", "q", "rem"))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = rows.withColumn("key", F.md5(key)).join(planned, F.col("source").eqNullSafe(F.col("_s")))
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("block", number % F.ceil(F.col("docs") / F.lit(block)))
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("_s", "block").agg(F.sum("tokens").alias("in_block")).withColumn(
        "key", F.md5(F.concat_ws("|", F.lit(f"{seed} block"), F.coalesce(F.col("_s"), F.lit("")), F.col("block").cast("string"))))
    totals = totals.withColumn("blocks_before", F.coalesce(F.sum("in_block").over(before.partitionBy("_s")), F.lit(0))).select(
        F.col("_s").alias("_t"), F.col("block").alias("_b"), "blocks_before")
    placed = keyed.withColumn("in_before", F.coalesce(F.sum("tokens").over(before.partitionBy("_s", "block")), F.lit(0))).join(
        totals, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b")))
    return placed.select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.col("budget").alias("source_budget"),
                         (F.col("q") + (F.col("blocks_before") + F.col("in_before") < F.col("rem")).cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    m = mix(docs, **how).filter("copies > 0").select(F.col("doc_id").alias("__op8_id"), F.col("source").alias("__op8_source"),
                                                    F.col("copies").cast("int").alias("__op8_copies"))
    taken = docs.join(m, F.col("doc_id").eqNullSafe(F.col("__op8_id")) & F.col("source").eqNullSafe(F.col("__op8_source")))
    return taken.withColumn("__op8_copy", F.explode(F.sequence(F.lit(1), F.col("__op8_copies")))).select(*docs.columns)


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = rf"""WITH RECURSIVE r AS (SELECT doc_id, source, sum(len(list_filter(string_split_regex(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> ''))) AS tokens
  FROM documents GROUP BY doc_id, source),
s AS (SELECT source, count(*) AS docs, sum(tokens) AS tokens, sum(tokens) / (SELECT sum(tokens) FROM r)::DOUBLE AS share FROM r GROUP BY source),
u AS (SELECT share FROM s WHERE tokens > 0),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END FROM (
    SELECT i, any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid,
      max(pow(share, (lo + hi) / 2) / share) / sum(pow(share, (lo + hi) / 2)) > {MAX_REPEATS} AS over FROM b, u WHERE i < {STEPS} GROUP BY i)),
e AS (SELECT max(1 / share) / count(*) > {MAX_REPEATS} AS over0 FROM u),
t AS (SELECT CASE WHEN (SELECT over0 FROM e) THEN (SELECT hi FROM b WHERE i = {STEPS}) ELSE 0.0 END AS t),
w AS (SELECT source, docs, tokens, CASE WHEN tokens > 0 THEN round(pow(share, (SELECT t FROM t)) * ((SELECT sum(tokens) FROM s)::DOUBLE
    / (SELECT sum(pow(share, (SELECT t FROM t))) FROM u)))::BIGINT ELSE 0 END AS budget FROM s),
k AS (SELECT r.*, docs, budget, CASE WHEN w.tokens > 0 THEN budget // w.tokens ELSE 1 END AS q,
    CASE WHEN w.tokens > 0 THEN budget % w.tokens ELSE 0 END AS rem,
    md5('{SEED}|' || coalesce(r.source, '') || '|' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM r JOIN w ON r.source IS NOT DISTINCT FROM w.source),
l AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % ceil(docs / {BLOCK}.0)::BIGINT AS block FROM k),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY md5('{SEED} block|' || coalesce(source, '') || '|' || block::VARCHAR), key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT doc_id, source, tokens::BIGINT AS n_tokens, budget AS source_budget, (q + CASE WHEN before < rem THEN 1 ELSE 0 END)::BIGINT AS copies FROM o"""
