"""Quality rules with adaptive thresholds (operator 3, DataFrame functions only).

Per document: word and symbol counts, repeated lines, words in repeated 3-word
windows. A base rule with fixed limits comes first; then four ratios are
compared with limits that follow the corpus. For every (lang, source) a mergeable
quantile sketch of each ratio gives its quartiles and its 99th percentile:

* mean word length lies within ``Q1 - 3 (Q3 - Q1) - slack`` and
  ``Q3 + 3 (Q3 - Q1) + slack``; symbols a word not above the latter;
* repeated lines and repeated words, which good texts have too, not above
  ``2 Q99 + slack``;
* upper limits but word length's are those of the whole language at most, so a
  source full of junk doesn't excuse itself.

The sketch is a table of counts per bucket: a ratio in thousandths keeps its
seven leading binary digits (relative error below 1/64), so sketches of parts
merge by adding counts, in any order, to the same result. A source's sketch is
merged with that of its language, which weighs as ``PRIOR_DOCS`` documents, and that
with the sketch of all documents by the same weight: limits of a small source are
those of its language, and they move without a jump as it grows.

Defined cases: null text is an empty text (no words: the base rule fails). Texts are
read whole at any length. Null lang or source is a group of its own. Repeated rows
are judged alike and all returned. An empty table gives an empty result. Extra
columns are ignored. Repeated windows are recognised by a 64-bit hash of their three
words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mirage.llm.common import stash, table, word_array

PRIOR_DOCS = 100
_UNIT = 1_000_000  # weights are counted in millionths of a document
SYMBOLS = "#*$%&|<>"  # fixed values
# ratio name -> slack in thousandths
SLACK = {"word_length": 500, "symbols": 100, "dup_lines": 10, "repeats": 10}
FENCED = ("word_length", "symbols")  # by quartiles, the others by the 99th percentile


def _let(value, body):
    """Bind ``value`` once for use in ``body`` (a lambda would re-evaluate it)."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words):
    """Words in 3-word windows found twice or more: the positions whose
    hash has an equal one, then the length of the union of their intervals."""
    def windows(h):
        return F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, h[i + 1], h[i + 2]))

    def sorted_positions(s):
        flagged = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
        return F.sort_array(F.transform(flagged, lambda e: e["i"]))

    def pairs(t):
        return F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

    def few_positions(t, d):
        at = F.transform(t, lambda x, i: F.when(F.array_contains(d, x), i))
        return F.filter(at, lambda i: i.isNotNull())

    def covered(p):
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(t):
        # d: the repeated hashes. Both ways give the same positions; a long d
        # would make looking up every window in it quadratic.
        return _let(_let(F.sort_array(t), lambda s: F.array_distinct(F.filter(s, lambda x, k: F.get(s, k - 1) == x))),
                    lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 32, _let(few_positions(t, d), covered)).otherwise(
                        _let(F.sort_array(pairs(t)), lambda s: _let(sorted_positions(s), covered))))

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        _let(hashes, lambda h: _let(windows(h), repeated))).cast("long")


def quality_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, lang, source, counts and ``base_failed``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(
        F.col(id_col).alias("doc_id"), F.col("lang"), F.col("source"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_l"),
        _let(word_array(F.col(text_col)),
             lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"),
                                _repeat_words(w).alias("rep"))).alias("_w"))
    out = out.select("doc_id", "lang", "source", F.col("_w.n").cast("long").alias("n_words"),
                     F.col("_w.chars").cast("long").alias("word_chars"), "n_symbols",
                     F.col("_l.dup").cast("long").alias("n_dup_lines"), F.col("_w.rep").alias("n_repeat_words"),
                     F.col("_l.n").cast("long").alias("n_lines"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratio(num: str, den: str):
    return F.when(F.col(den) > 0, F.expr(f"({num} * 1000) div {den}")).otherwise(F.lit(0)).cast("long")


RATIOS = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
          "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}


def _bucket(v: str):
    drop = f"greatest(length(bin({v})) - 7, 0)"
    return F.expr(f"shiftleft(shiftright({v}, {drop}), {drop})")


def adaptive_limits(metrics: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """(lang, source) -> ``lo_/hi_`` limits of every ratio, in thousandths.

    Works on sketches only: counts per (lang, source, ratio, bucket)."""
    long = metrics.filter(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(k).alias("ratio"), _ratio(*RATIOS[k]).alias("v")) for k in RATIOS])).alias("r"))
    sketch = stash(long.select("lang", "source", "r.ratio", _bucket("r.v").alias("b"))
                   .groupBy("lang", "source", "ratio", "b").agg(F.count(F.lit(1)).alias("n")))
    whole = F.lit(prior_docs * _UNIT).cast("long")
    per_lang = sketch.groupBy("lang", "ratio", "b").agg(F.sum("n").alias("n"))
    lang_docs = sketch.groupBy("lang", "ratio").agg(F.sum("n").alias("docs"))
    overall = sketch.groupBy("ratio", "b").agg(F.sum("n").alias("n"))
    all_docs = sketch.groupBy("ratio").agg(F.sum("n").alias("all_docs")).select(F.col("ratio").alias("_r"), "all_docs")
    # Prior of a language: its own sketch and, the less of it there is, that of all.
    of_lang = F.expr(f"({prior_docs * _UNIT} * docs) div (docs + {prior_docs})")
    weights = lang_docs.select("lang", "ratio", "docs", of_lang.alias("w"))
    spread = weights.join(overall.select(F.col("ratio").alias("_r"), "b", F.col("n").alias("n_all")), F.col("ratio") == F.col("_r")).drop("_r").join(
        all_docs, F.col("ratio") == F.col("_r")).drop("_r")
    own = per_lang.select(F.col("lang").alias("_l"), F.col("ratio").alias("_r"), F.col("b").alias("_b"), F.col("n").alias("n_lang"))
    same = F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ratio") == F.col("_r")) & (F.col("b") == F.col("_b"))
    prior = spread.withColumn("_whole", whole).join(own, same, "left").select(
        "lang", "ratio", "b", F.coalesce("n_lang", F.lit(0)).alias("n_lang"),
        (F.expr("(w * coalesce(n_lang, 0)) div docs") + F.expr("((_whole - w) * n_all) div all_docs")).alias("p"))
    prior = stash(prior)
    groups = sketch.select(F.col("lang").alias("_l"), "source", F.col("ratio").alias("_r")).distinct()
    n_own = sketch.select(F.col("lang").alias("_l2"), F.col("source").alias("_s2"), F.col("ratio").alias("_r2"), F.col("b").alias("_b2"), "n")
    fine = groups.join(prior, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("ratio") == F.col("_r"))).select("lang", "source", "ratio", "b", "p")
    fine = fine.join(n_own, F.col("lang").eqNullSafe(F.col("_l2")) & F.col("source").eqNullSafe(F.col("_s2")) & (F.col("ratio") == F.col("_r2"))
                     & (F.col("b") == F.col("_b2")), "left")
    merged = fine.select(F.lit(0).alias("level"), "lang", "source", "ratio", "b", (F.coalesce("n", F.lit(0)) * _UNIT + F.col("p")).alias("m")).unionByName(
        prior.select(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"), "ratio", "b", (F.col("n_lang") * _UNIT + F.col("p")).alias("m")))
    w = Window.partitionBy("level", "lang", "source", "ratio")
    cum = merged.withColumn("cum", F.sum("m").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))) \
                .withColumn("total", F.sum("m").over(w))

    def quantile(k):
        return F.min(F.when(100 * F.col("cum") >= k * F.col("total"), F.col("b")))

    quart = cum.groupBy("level", "lang", "source", "ratio").agg(quantile(25).alias("q1"), quantile(75).alias("q3"), quantile(99).alias("q99"))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])[F.col("ratio")]
    fence = 3 * (F.col("q3") - F.col("q1")) + slack
    lim = quart.select("level", "lang", "source", "ratio", (F.col("q1") - fence).alias("lo"),
                       F.when(F.col("ratio").isin(*FENCED), F.col("q3") + fence).otherwise(2 * F.col("q99") + slack).alias("hi"))
    names = [f"{s}_{k}" for k in RATIOS for s in ("lo", "hi")]
    wide = lim.groupBy("level", "lang", "source").agg(*[
        F.max(F.when(F.col("ratio") == k, F.col(s))).alias(f"{s}_{k}") for k in RATIOS for s in ("lo", "hi")])
    language = wide.filter("level = 1").select(F.col("lang").alias("_l"), *[F.col(c).alias(f"{c}_l") for c in names])
    joined = wide.filter("level = 0").join(language, F.col("lang").eqNullSafe(F.col("_l")))

    def bounded(c):
        return F.least(F.col(c), F.col(f"{c}_l")) if c.startswith("hi_") and c != "hi_word_length" else F.col(c)

    return joined.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[bounded(c).alias(c) for c in names])


def quality_verdicts(docs: DataFrame, prior_docs: int = PRIOR_DOCS) -> DataFrame:
    """Metrics of every document with ``kept``: not base_failed and inside every
    adaptive limit of its (lang, source)."""
    m = stash(quality_metrics(docs))
    j = m.join(adaptive_limits(m, prior_docs),
               F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    ok = ~F.col("base_failed") & (_ratio(*RATIOS["word_length"]) >= F.col("lo_word_length"))
    for k in RATIOS:
        ok = ok & (_ratio(*RATIOS[k]) <= F.col(f"hi_{k}"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    F.coalesce(ok, F.lit(False)).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def _sql_ratio(k: str) -> str:
    num, den = RATIOS[k]
    return f"CASE WHEN {den} > 0 THEN ({num} * 1000) // {den} ELSE 0 END"


def verdict_sql(src: str, prefix: str = "q") -> str:
    """CTEs over table ``src`` ending in ``{prefix}_out`` (DuckDB)."""
    p = prefix
    ratios = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS ratio, {_sql_ratio(k)} AS v FROM {p}_m WHERE NOT base_failed" for k in RATIOS)
    slack = "CASE ratio " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLACK.items()) + " END"
    names = [f"{s}_{k}" for k in RATIOS for s in ("lo", "hi")]
    wide = ", ".join(f"max(CASE WHEN ratio = '{k}' THEN {s} END) AS {s}_{k}" for k in RATIOS for s in ("lo", "hi"))
    pick = ", ".join(f"least(a.{c}, b.{c}) AS {c}" if c.startswith("hi_") and c != "hi_word_length" else f"a.{c}" for c in names)
    fenced = ", ".join(f"'{k}'" for k in FENCED)
    ok = " AND ".join([f"{_sql_ratio('word_length')} >= lo_word_length"] + [f"{_sql_ratio(k)} <= hi_{k}" for k in RATIOS])
    return rf"""{p}_t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {src}),
{p}_g AS (SELECT doc_id, i, w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM {p}_t)),
{p}_d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM {p}_g) WHERE n > 1),
{p}_r AS (SELECT doc_id, count(DISTINCT i + o) AS rep FROM {p}_d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
{p}_m0 AS (SELECT t.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(rep, 0) AS n_repeat_words, len(l) AS n_lines FROM {p}_t t LEFT JOIN {p}_r r ON t.doc_id = r.doc_id),
{p}_m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM {p}_m0),
{p}_v AS ({ratios}),
{p}_b AS (SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b FROM {p}_v),
{p}_s AS (SELECT lang, source, ratio, b, count(*) AS n FROM {p}_b GROUP BY ALL),
{p}_sl AS (SELECT lang, ratio, b, sum(n)::BIGINT AS n FROM {p}_s GROUP BY ALL),
{p}_sa AS (SELECT ratio, b, sum(n)::BIGINT AS n, sum(sum(n)::BIGINT) OVER (PARTITION BY ratio)::BIGINT AS all_docs FROM {p}_s GROUP BY ratio, b),
{p}_dl AS (SELECT lang, ratio, docs, ({PRIOR_DOCS * _UNIT} * docs) // (docs + {PRIOR_DOCS}) AS w
  FROM (SELECT lang, ratio, sum(n)::BIGINT AS docs FROM {p}_s GROUP BY ALL)),
{p}_pr AS (SELECT d.lang, d.ratio, a.b, coalesce(l.n, 0) AS n_lang,
  (d.w * coalesce(l.n, 0)) // d.docs + (({PRIOR_DOCS * _UNIT} - d.w) * a.n) // a.all_docs AS p
  FROM {p}_dl d JOIN {p}_sa a ON d.ratio = a.ratio
  LEFT JOIN {p}_sl l ON l.lang IS NOT DISTINCT FROM d.lang AND l.ratio = d.ratio AND l.b = a.b),
{p}_c AS (SELECT 0 AS level, g.lang, g.source, r.ratio, r.b, coalesce(s.n, 0) * {_UNIT} + r.p AS m
  FROM (SELECT DISTINCT lang, source, ratio FROM {p}_s) g JOIN {p}_pr r ON g.lang IS NOT DISTINCT FROM r.lang AND g.ratio = r.ratio
  LEFT JOIN {p}_s s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source AND s.ratio = r.ratio AND s.b = r.b
  UNION ALL SELECT 1, lang, NULL, ratio, b, n_lang * {_UNIT} + p FROM {p}_pr),
{p}_u AS (SELECT *, sum(m) OVER (PARTITION BY level, lang, source, ratio ORDER BY b) AS cum,
  sum(m) OVER (PARTITION BY level, lang, source, ratio) AS total FROM {p}_c),
{p}_q AS (SELECT level, lang, source, ratio, min(CASE WHEN 100 * cum >= 25 * total THEN b END) AS q1,
  min(CASE WHEN 100 * cum >= 75 * total THEN b END) AS q3, min(CASE WHEN 100 * cum >= 99 * total THEN b END) AS q99 FROM {p}_u GROUP BY ALL),
{p}_l AS (SELECT level, lang, source, ratio, q1 - 3 * (q3 - q1) - {slack} AS lo,
  CASE WHEN ratio IN ({fenced}) THEN q3 + 3 * (q3 - q1) + {slack} ELSE 2 * q99 + {slack} END AS hi FROM {p}_q),
{p}_w AS (SELECT level, lang, source, {wide} FROM {p}_l GROUP BY level, lang, source),
{p}_lim AS (SELECT a.lang, a.source, {pick} FROM (SELECT * FROM {p}_w WHERE level = 0) a
  JOIN (SELECT * FROM {p}_w WHERE level = 1) b ON a.lang IS NOT DISTINCT FROM b.lang),
{p}_out AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {ok}, false) AS kept FROM {p}_m m LEFT JOIN {p}_lim x
  ON m.lang IS NOT DISTINCT FROM x.lang AND m.source IS NOT DISTINCT FROM x.source)"""


SQL = f"WITH {verdict_sql('documents')} SELECT * FROM q_out"
