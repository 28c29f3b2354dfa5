"""A private tree of tables with a budget ledger.

Nothing exact about the table reaches the model; every step that reads it spends a
stated part of epsilon, and the ledger lists what each spent:

* ``rows``: the number of rows, by Laplace noise;
* ``edges``: ranges of numbers without a declared domain, from noisy counts over the
  powers of two (a public grid): the ends of the first and last power whose count is
  above what noise alone reaches;
* ``categories``: values of text columns without a declared list, those whose noisy
  count is above 1 + ln(1 / (2 delta)) noise scales, so that a value of one row is
  listed with probability of at most delta;
* ``tree``: every edge by the exponential mechanism (noisy maximum with Gumbel noise)
  on the mutual information between a column of the tree and one outside;
* ``tables``: noisy counts of the root and of each child given its parent. A row adds
  one to each column's table.

Values outside a range count at its ends, categories not listed don't count. Columns
of more than ``INLINE_CATEGORIES`` listed categories keep a marginal of their own.
What isn't needed (all declared, one column) is spent on the tables. One row per unit
is assumed, see ``bound_contribution``.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirage.functions.draws import fresh_seed
from mirage.operators import synth as Y
from mirage.operators.frequencies import feature_columns, to_long, value_key
from mirage.operators.prep import INTEGRAL, categorical_columns

SHARES = {"rows": 0.05, "edges": 0.1, "categories": 0.1, "tree": 0.25}
DELTA = 1e-6
LEAST_POWER, MOST_POWER = -40, 60  # the grid of magnitudes
FALSE_EDGE = 0.05                  # chance that any empty power passes
LEDGER_SCHEMA = "step string, detail string, epsilon double, delta double"


class Ledger:
    """What each step spent; steps on the same rows add up."""

    def __init__(self):
        self.entries: list = []

    def spend(self, step: str, detail: str, epsilon: float, delta: float = 0.0) -> None:
        self.entries.append((step, detail, float(epsilon), float(delta)))

    def total(self) -> tuple[float, float]:
        return sum(e[2] for e in self.entries), sum(e[3] for e in self.entries)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.entries, LEDGER_SCHEMA)


def _uniform(seed, tag: str, key: str, bits: int) -> float:
    """``draw`` of a driver-side number."""
    word = hashlib.md5(f"{seed}|{tag}|{key}".encode()).hexdigest()[:bits // 4]
    return (int(word, 16) + 0.5) / (1 << bits)


def _laplace(seed, key: str, scale: float, bits: int) -> float:
    u = _uniform(seed, "noise", key, bits)
    return -scale * math.copysign(1.0, u - 0.5) * math.log(1.0 - 2.0 * abs(u - 0.5))


def mutual_information_sensitivity(n: float) -> float:
    """How far one row of ``n`` can move the mutual information of two columns."""
    n = max(n, 2.0)
    return 2.0 / n * math.log((n + 1) / 2.0) + (n - 1) / n * math.log((n + 1) / (n - 1))


def _power(v: Column) -> Column:
    e = F.greatest(F.least(F.floor(F.log2(F.abs(v))), F.lit(MOST_POWER)), F.lit(LEAST_POWER)) - F.lit(LEAST_POWER - 1)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise((F.signum(v) * e).cast("long"))


def _power_ends(b: int) -> tuple[float, float]:
    if b == 0:
        return 0.0, 0.0
    e = abs(b) + LEAST_POWER - 1
    return (2.0 ** e, 2.0 ** (e + 1)) if b > 0 else (-2.0 ** (e + 1), -2.0 ** e)


def private_ranges(df: DataFrame, cols, epsilon: float, seed, bits: int = 52) -> dict:
    """Column -> (lo, hi) from noisy counts over the powers of two; (-1, 1) where no
    power passes."""
    cols, spark = list(cols), df.sparkSession
    top = MOST_POWER - LEAST_POWER + 1
    scale = len(cols) / epsilon
    least = scale * math.log(len(cols) * (2 * top + 1) / (2 * FALSE_EDGE))
    counts = to_long(df, cols).filter("v is not null and not isnan(v)").groupBy("column", _power(F.col("v")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(c,) for c in cols], "column string").withColumn("b", F.explode(F.sequence(F.lit(-top).cast("long"), F.lit(top).cast("long"))))
    noisy = Y.noise("laplace", F.coalesce("n", F.lit(0)), scale, seed, F.concat_ws("|", F.col("column"), F.lit("edge"), F.col("b").cast("string")), None, bits)
    seen = grid.join(counts, ["column", "b"], "left").withColumn("noisy", noisy).filter(F.col("noisy") > F.lit(least))
    ends = {r["column"]: (r["lo"], r["hi"]) for r in seen.groupBy("column").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).collect()}  # one row per column
    out = {}
    for c in cols:
        lo, hi = (_power_ends(ends[c][0])[0], _power_ends(ends[c][1])[1]) if c in ends else (-1.0, 1.0)
        out[c] = (lo, hi) if lo < hi else (lo - 1.0, hi + 1.0)
    return out


def private_categories(df: DataFrame, cols, epsilon: float, delta: float, seed, bits: int = 52) -> DataFrame:
    """(column, v): the values whose noisy count passes the threshold, as a written table."""
    from mirage.session import cut_lineage
    cols = list(cols)
    scale = len(cols) / epsilon
    least = 1.0 + scale * math.log(len(cols) / (2.0 * delta))
    counts = to_long(df, cols).filter("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("|", F.col("column"), F.lit("cat"), value_key(F.col("v")).cast("string"))
    return cut_lineage(counts.filter(Y.noise("laplace", F.col("n"), scale, seed, key, None, bits) > F.lit(least)).select("column", "v"))


def private_tree(mi: dict, cols: list, epsilon: float, n: float, seed, bits: int = 52) -> dict:
    """Child -> parent (None for the first column): edges one by one, each the noisy
    maximum of what the mutual information of tree and other columns offers."""
    cols = sorted(cols)
    parent: dict = {cols[0]: None}
    if len(cols) < 2:
        return parent
    weight = epsilon / (len(cols) - 1) / (2.0 * mutual_information_sensitivity(n))
    while len(parent) < len(cols):
        best = None
        for a in parent:
            for b in cols:
                if b not in parent:
                    u = _uniform(seed, "tree", f"{len(parent)}|{a}|{b}", bits)
                    score = weight * mi.get((a, b), mi.get((b, a), 0.0)) - math.log(-math.log(u))
                    best = max(best, (score, b, a)) if best else (score, b, a)
        parent[best[1]] = best[2]
    return parent


def private_fit(df: DataFrame, epsilon: float, seed=None, cols=None, domain: dict | None = None, categories: dict | None = None,
                delta: float = DELTA, n_bins: int = Y.N_BINS, family: str = "private") -> tuple[DataFrame, Ledger]:
    """(model table, ledger). ``domain``: column -> (lo, hi) of numbers known without
    the table; ``categories``: column -> values of a text column."""
    from mirage.session import cut_lineage
    spark, cols = df.sparkSession, list(cols or feature_columns(df))
    bits, seed = (52, fresh_seed()) if seed is None else (32, seed)
    text = [c for c in cols if c in set(categorical_columns(df)) or c in (categories or {})]
    numbers = [c for c in cols if c not in text]
    ledger, left = Ledger(), float(epsilon)

    def spend(step, detail, d=0.0):
        nonlocal left
        part = SHARES[step] * epsilon
        ledger.spend(step, detail, part, d)
        left -= part
        return part

    n = max(df.count() + _laplace(seed, "rows", 1.0 / spend("rows", "number of rows"), bits), 1.0)
    ranges = {c: tuple(map(float, (domain or {})[c])) for c in numbers if c in (domain or {})}
    open_numbers = [c for c in numbers if c not in ranges]
    if open_numbers:
        ranges |= private_ranges(df, open_numbers, spend("edges", ", ".join(open_numbers)), seed, bits)
    listed = spark.createDataFrame([(c, float(v)) for c in text for v in sorted(set((categories or {}).get(c, ())))], "column string, v double")
    open_text = [c for c in text if c not in (categories or {})]
    if open_text:
        listed = listed.unionByName(private_categories(df, open_text, spend("categories", ", ".join(open_text), delta), delta, seed, bits))
    sizes = {r["column"]: r["n"] for r in listed.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per column
    wide = [c for c in text if sizes.get(c, 0) > Y.INLINE_CATEGORIES]
    tree_cols = [c for c in cols if c not in wide and (c in numbers or sizes.get(c))]
    if not tree_cols and not wide:
        raise ValueError("no column has a range or a listed category")
    narrow = {}
    listed_narrow = listed.filter(~F.col("column").isin(wide)) if wide else listed
    for r in listed_narrow.select("column", "v", value_key(F.col("v")).alias("key")).collect():  # at most INLINE_CATEGORIES a column
        narrow.setdefault(r["column"], []).append((r["v"], r["key"]))

    def binned(c: str) -> Column:
        v = F.col(c).cast("double")
        if c in narrow:
            return F.when(v.isin([x for x, _ in narrow[c]]), value_key(v))
        lo, hi = ranges[c]
        inside = F.greatest(F.least(v, F.lit(hi)), F.lit(lo))
        return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.floor((inside - F.lit(lo)) * F.lit(float(n_bins)) / F.lit(hi - lo)), F.lit(n_bins - 1)).cast("long"))

    parent = {tree_cols[0]: None} if tree_cols else {}
    if len(tree_cols) > 1:
        bins = cut_lineage(df.select("row_id", *[binned(c).alias(c) for c in tree_cols]))  # read by the tree and the tables
        mi = {(r["a"], r["b"]): r["mi"] for r in Y.pair_information(bins, tree_cols).collect()}  # columns x columns
        parent = private_tree(mi, tree_cols, spend("tree", f"{len(tree_cols) - 1} edges"), n, seed, bits)
    elif tree_cols:
        bins = df.select("row_id", binned(tree_cols[0]).alias(tree_cols[0]))
    ledger.spend("tables", f"{len(tree_cols) + len(wide)} tables", left)
    scale = (len(tree_cols) + len(wide)) / left
    n_train = int(math.floor(n + 0.5))
    model = _tables(spark, bins, df, parent, narrow, ranges, n_bins, scale, seed, bits, family, n_train) if tree_cols else None
    for c in wide:
        kept = listed.filter(F.col("column") == c).select(F.col("v").alias(c))
        rows = df.select("row_id", F.col(c).cast("double").alias(c)).join(kept, c, "left_semi")
        key = F.concat_ws("|", F.col("column"), F.col("bin").cast("string"))
        part, _ = Y._wide_marginals(rows, [c], lambda count: Y.noise("laplace", count, scale, seed, key, None, bits),
                                    F.lit(isinstance(df.schema[c].dataType, INTEGRAL)), family)
        part = part.withColumn("n_train", F.lit(n_train).cast("long")).select(*Y.MODEL_COLUMNS)
        model = part if model is None else model.unionByName(part)
    return model, ledger


def _tables(spark, bins: DataFrame, df: DataFrame, parent: dict, narrow: dict, ranges: dict, n_bins: int, scale: float, seed, bits: int,
            family: str, n_train: int) -> DataFrame:
    """The root's table and every child's table per bin of its parent: all counts in
    one grouped pass, the grid of all cells from the public bins."""
    places = []
    for c in parent:
        integral = isinstance(df.schema[c].dataType, INTEGRAL)
        if c in narrow:
            places += [(c, "cat", key, v, v, integral) for v, key in narrow[c]]
        else:
            lo, hi = ranges[c]
            width = (hi - lo) / n_bins
            places += [(c, "hist", b, lo + b * width, lo + (b + 1) * width, integral) for b in range(n_bins)]
    place = spark.createDataFrame(places, "column string, kind string, bin long, bin_lo double, bin_hi double, integral boolean")
    tree = spark.createDataFrame(list(parent.items()), "column string, parent string")
    grid = (place.join(F.broadcast(tree), "column")
            .join(F.broadcast(place.select(F.col("column").alias("_p"), F.col("bin").alias("parent_bin"))), F.col("parent") == F.col("_p"), "left").drop("_p"))
    rec = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(p) if p else F.lit(None).cast("long")).alias("_pb"), F.col(c).alias("_b"))
                              for c, p in parent.items()]))
    counts = bins.select(rec.alias("r")).select("r.*").groupBy("column", "_pb", "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumnRenamed("column", "_c")
    both = grid.join(counts, (F.col("column") == F.col("_c")) & F.col("parent_bin").eqNullSafe(F.col("_pb")) & (F.col("bin") == F.col("_b")), "left")
    key = F.concat_ws("|", F.col("column"), F.coalesce(F.col("parent_bin").cast("string"), F.lit("root")), F.col("bin").cast("string"))
    noisy = Y.noise("laplace", F.coalesce("_n", F.lit(0)), scale, seed, key, None, bits)
    model = both.select(F.lit(family).alias("family"), "column", "kind", "bin", "bin_lo", "bin_hi", "parent", "parent_bin",
                        noisy.alias("noisy"), "integral", F.lit(n_train).cast("long").alias("n_train"))
    return Y._finish_local(model, ("column", "parent_bin")).select(*Y.MODEL_COLUMNS)
