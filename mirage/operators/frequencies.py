"""Column profiles and aligned frequency tables.

All columns are handled in one unpivoted pass: the table becomes
``(column, v)`` rows, the per-column profile of the *real* table (one row per
column) is broadcast, every value is mapped to its bin key, and a grouped count
gives every column's frequencies at once. Counting is map-side combined, so a
value holding a third of all rows costs nothing extra.

Frequency tables have the schema ``(column, bin, p_real, p_syn)``; ``bin`` is
the value itself for categorical columns (fewer than 5 distinct real values)
and the left histogram edge otherwise. Inputs are numeric (encode first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BINS = 10
CATEGORICAL_BELOW = 5
FILL = 1e-11       # stands in for a missing or zero frequency
HIST_EPS = 1e-8    # added to histogram totals


def value_key(v) -> F.Column:
    """Integer key of a categorical value: round(v * 1e6) when it fits in 64
    bits, else a 64-bit hash of the value (so huge values never overflow)."""
    return F.coalesce(F.round(v * F.lit(1e6)).try_cast("bigint"), F.xxhash64(v))


def feature_columns(df: DataFrame, skip=("row_id",)) -> list:
    return [c for c in df.columns if c not in skip]


def to_long(df: DataFrame, cols, by=()) -> DataFrame:
    """Unpivot to ([tags,] column, v double); one scan, no per-column jobs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                for c in cols]))
    return df.select(*by, pairs.alias("kv")).select(*by, "kv.*")


def column_profile(df: DataFrame, cols=None, n_bins: int = N_BINS) -> DataFrame:
    """A1: per column distinct count, bins = min(n_bins, distinct), categorical
    when distinct < 5, plus min/max (the histogram range). One row per column."""
    cols = cols or feature_columns(df)
    long = to_long(df, cols)
    per_value = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    prof = per_value.groupBy("column").agg(
        F.count("v").alias("n_distinct"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.sum("n").alias("n_rows"))
    return prof.select(
        "column", "n_distinct",
        F.least(F.lit(n_bins), F.col("n_distinct")).cast("long").alias("n_bins"),
        (F.col("n_distinct") < CATEGORICAL_BELOW).alias("categorical"), "lo", "hi", "n_rows")


# Screening with HyperLogLog (512 registers): with n distinct values the
# estimate is at most 512 ln(512 / (512 - n)) (linear counting, n < 512), so n
# values can never reach five times n up to n = 500. Columns estimated under five
# times the bins are counted exactly, all columns where more bins are asked for.
SCREEN_FACTOR = 5
SCREEN_RSD = 0.05


def bin_profile(df: DataFrame, cols=None, n_bins: int = N_BINS, categorical=()) -> DataFrame:
    """The profile that binning needs (n_bins, categorical, lo, hi, n_rows),
    exact where it matters, without shuffling every distinct value of a
    continuous column: one pass gives min / max / rows and a HyperLogLog
    count; only columns whose estimate is small (so the bin count depends on
    the exact number) are counted exactly - and those have few values.
    ``categorical``: columns whose values are categories at any width.
    Returned as a local table (one row per column)."""
    cols = cols or feature_columns(df)
    spark = df.sparkSession
    long = to_long(df, cols)
    stats = long.groupBy("column").agg(F.approx_count_distinct("v", SCREEN_RSD).alias("nd"), F.min("v").alias("lo"),
                                       F.max("v").alias("hi"), F.count(F.lit(1)).alias("n_rows")).collect()
    small = [r["column"] for r in stats if n_bins > 500 or r["nd"] < SCREEN_FACTOR * max(n_bins, CATEGORICAL_BELOW)]
    exact = {}
    if small:
        ex = (to_long(df, small).filter(F.col("v").isNotNull()).groupBy("column", "v").count()
              .groupBy("column").agg(F.count(F.lit(1)).alias("nd")))
        exact = {r["column"]: r["nd"] for r in ex.collect()}
    rows = []
    for r in stats:
        nd = exact.get(r["column"], 0) if r["column"] in small else r["nd"]
        rows.append((r["column"], int(nd), int(min(n_bins, nd)), bool(nd < CATEGORICAL_BELOW or r["column"] in categorical),
                     r["lo"], r["hi"], int(r["n_rows"])))
    return spark.createDataFrame(rows, "column string, n_distinct long, n_bins long, categorical boolean, "
                                       "lo double, hi double, n_rows long")


def value_freqs(df: DataFrame, col: str) -> DataFrame:
    """A2: relative value counts of one column (divided by all rows, nulls included)."""
    total = df.count()  # one number
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("value").isNotNull())
    return counts.select(F.lit(col).alias("column"), "value", (F.col("n") / F.lit(float(max(total, 1)))).alias("freq"))


def _bin_key(prof: DataFrame) -> F.Column:
    k = F.col("n_bins").cast("double")
    idx = F.least(F.floor((F.col("v") - F.col("lo")) * k / (F.col("hi") - F.col("lo"))), F.col("n_bins") - 1)
    return F.when(F.col("categorical"), F.col("v")).otherwise(
        F.col("lo") + idx.cast("double") * ((F.col("hi") - F.col("lo")) / k))


def _freqs(long: DataFrame, prof: DataFrame, name: str, by=()) -> DataFrame:
    by = list(by)
    j = long.join(F.broadcast(prof), "column")  # profile: one row per column
    in_range = F.col("categorical") | ((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    # One aggregation: rows outside the range (or null) count under a null bin,
    # so the per-column totals come from the small counted table, not a second scan.
    binned = j.withColumn("bin", F.when(in_range & F.col("v").isNotNull(), _bin_key(prof)))
    counted = binned.groupBy(*by, "column", "bin").agg(F.count(F.lit(1)).alias("n"), F.first("categorical").alias("cat"))
    totals = counted.groupBy(*by, "column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0)).alias("hits"))
    counts = counted.filter(F.col("bin").isNotNull())
    return (counts.join(F.broadcast(totals), [*by, "column"])  # one row per (tag, column)
            .select(*by, "column", "bin",
                    F.when(F.col("cat"), F.col("n") / F.col("rows"))
                    .otherwise(F.col("n") / (F.col("hits") + F.lit(HIST_EPS))).alias(name)))


def histogram_freqs(real: DataFrame, syn: DataFrame, col: str, bins: int = N_BINS) -> DataFrame:
    """A3: equal-width histogram of one column on the real table's edges."""
    return column_frequencies(real, syn, [col], n_bins=bins, force_hist=True)


def align_freqs(real_f: DataFrame, syn_f: DataFrame) -> DataFrame:
    """Full outer join key by key; missing or zero frequencies become 1e-11."""
    j = real_f.join(syn_f, ["column", "bin"], "full_outer")
    fix = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(FILL))
    return j.select("column", "bin", fix("p_real").alias("p_real"), fix("p_syn").alias("p_syn"))


def column_frequencies(real: DataFrame, syn: DataFrame, cols=None, n_bins: int = N_BINS,
                       force_hist: bool = False, profile: DataFrame | None = None, by=()) -> DataFrame:
    """A4: every column's aligned (real, synthetic) frequencies in one table.

    ``by``: tag columns of ``syn`` (several synthetic tables scored at once);
    the result then has one frequency table per tag.
    """
    by = list(by)
    cols = cols or [c for c in feature_columns(real)]
    prof = profile if profile is not None else bin_profile(real, cols, n_bins)
    if force_hist:
        # A constant column has one value in bins of width 1 / n_bins around it.
        flat = F.col("hi") == F.col("lo")
        prof = (prof.withColumn("n_bins", F.lit(n_bins).cast("long")).withColumn("categorical", F.lit(False))
                .withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
                              "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))}))
    real_f = _freqs(to_long(real, cols), prof, "p_real")
    syn_f = _freqs(to_long(syn, cols, by), prof, "p_syn", by)
    if not by:
        return align_freqs(real_f, syn_f)
    types = {f.name: f.dataType.simpleString() for f in syn.schema.fields}
    tags = [tuple(r) for r in syn.select(*by).distinct().collect()]  # a few (size, attempt) tags
    arr = F.array(*[F.struct(*[F.lit(v).cast(types[t]).alias(t) for t, v in zip(by, tg)]) for tg in tags])
    real_t = real_f.withColumn("_t", F.explode(arr)).select(*[F.col(f"_t.{t}").alias(t) for t in by], "column", "bin", "p_real")
    j = real_t.join(syn_f, [*by, "column", "bin"], "full_outer")
    fix = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(FILL))
    return j.select(*by, "column", "bin", fix("p_real").alias("p_real"), fix("p_syn").alias("p_syn"))


def validate_frequencies(freqs: DataFrame, err: float = 0.2) -> DataFrame:
    """A5: per column, is every bin's synthetic share within +-err of the real one?"""
    ok = F.col("p_syn").between(F.col("p_real") - F.lit(err), F.col("p_real") + F.lit(err))
    return freqs.groupBy("column").agg(F.bool_and(ok).alias("ok"))


def frequency_gaps(freqs: DataFrame, err: float = 0.2) -> DataFrame:
    """Bins outside the band; gap = distance beyond the band."""
    under = F.col("p_syn") < F.col("p_real") - F.lit(err)
    over = F.col("p_syn") > F.col("p_real") + F.lit(err)
    return (freqs.filter(under | over)
            .select("column", "bin", "p_real", "p_syn",
                    F.when(under, F.lit("under")).otherwise(F.lit("over")).alias("kind"),
                    F.when(under, F.col("p_real") - F.lit(err) - F.col("p_syn"))
                    .otherwise(F.col("p_syn") - F.col("p_real") - F.lit(err)).alias("gap")))


def marginal_comparison(real: DataFrame, syn: DataFrame, cols=None, n_bins: int = N_BINS) -> DataFrame:
    """The table behind a marginal plot: (column, bin, source, p)."""
    f = column_frequencies(real, syn, cols, n_bins)
    return f.select("column", "bin", F.expr("stack(2, 'real', p_real, 'synthetic', p_syn) as (source, p)"))


def column_entropy(real: DataFrame, cols=None, n_bins: int = N_BINS) -> DataFrame:
    """H_c = -sum p ln p over the real column's frequencies (used by M2)."""
    cols = cols or feature_columns(real)
    prof = bin_profile(real, cols, n_bins)
    f = _freqs(to_long(real, cols), prof, "p")
    return f.filter(F.col("p") > 0).groupBy("column").agg((-F.sum(F.col("p") * F.log(F.col("p")))).alias("entropy"))
