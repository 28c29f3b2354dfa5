"""Value modes of all numeric columns at once.

One expectation-maximisation serves every column. A pass is one scan: each row
gives its responsibilities for the modes of each of its values, and the sufficient
statistics (sum r, sum r z, sum r z^2) are a grouped aggregate per (column, mode),
combined before the shuffle, so a pass moves columns x modes rows whatever the table
holds. The parameters (columns x modes numbers) travel to the next pass as a
broadcast table of one row per column.

Values are worked on as z-scores; modes start at the normal quantiles
(j + 0.5) / k with standard deviation 2 / k and equal weights.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirage.functions.ordering import over_cores

MODES = 10
PASSES = 12
MIN_WEIGHT = 0.005   # lighter modes are dropped
MIN_SD = 1e-3        # in z-scores; a mode of equal values keeps a little width
EMPTY = 1e-9         # a mode with less responsibility keeps its place
SPAN = 4.0           # a mode's interval reaches this many standard deviations

MODES_SCHEMA = "column string, mode int, weight double, mean double, sd double"


def start_modes(k: int) -> list[tuple[float, float, float]]:
    """(weight, mean, sd) of the starting modes, in z-scores."""
    return [(1.0 / k, NormalDist().inv_cdf((j + 0.5) / k), 2.0 / k) for j in range(k)]


def _statistics(long: DataFrame, params: dict) -> list:
    """One pass: (column, mode, r, rz, rzz) under the current parameters."""
    table = [(c, [(math.log(w) - math.log(sd), mu, sd) for w, mu, sd in ms]) for c, ms in params.items()]
    modes = long.sparkSession.createDataFrame(table, "column string, ms array<struct<lw: double, mu: double, sd: double>>")
    z = F.col("z")
    score = F.transform("ms", lambda m: m["lw"] - F.pow((z - m["mu"]) / m["sd"], F.lit(2.0)) / F.lit(2.0))
    rows = long.join(F.broadcast(modes), "column").select("column", "z", score.alias("s"))  # one row per column
    rows = rows.withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("t", total).select("column", "z", "t", F.posexplode("e").alias("mode", "e"))
    r = F.col("e") / F.col("t")
    return rows.groupBy("column", "mode").agg(F.sum(r).alias("r"), F.sum(r * z).alias("rz"), F.sum(r * z * z).alias("rzz")).collect()


def fit_value_modes(df: DataFrame, cols, k: int = MODES, passes: int = PASSES, tol: float = 1e-3) -> DataFrame:
    """(column, mode, weight, mean, sd) of every column of ``cols`` in at most
    ``passes`` + 1 scans, fewer once no mean moves by ``tol`` standard deviations.
    Nulls and NaN are left out; a column without a spread has one mode, a column
    without values none. Modes of less than ``MIN_WEIGHT`` are dropped."""
    spark, cols = df.sparkSession, list(cols)
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    st = df.agg(*[f(value[c]).alias(f"{c}__{n}") for c in cols
                  for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).first()
    out, params = [], {}
    for c in cols:
        n, m, s = st[f"{c}__n"], st[f"{c}__m"], st[f"{c}__s"]
        if n and s:
            params[c] = start_modes(k)
        elif n:
            out.append((c, 0, 1.0, float(m), 0.0))
    if params:
        long = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), ((value[c] - F.lit(st[f"{c}__m"])) / F.lit(st[f"{c}__s"])).alias("z"))
            for c in params])).alias("kv")).select("kv.*").filter("z is not null")
        long = over_cores(long)
    live = dict(params)
    for _ in range(passes):
        if not live:
            break
        stats = _statistics(long.filter(F.col("column").isin(*live)), live)
        sums = {(r["column"], r["mode"]): r for r in stats}
        for c, ms in list(live.items()):
            new = [_maximise(sums.get((c, j)), st[f"{c}__n"], old) for j, old in enumerate(ms)]
            params[c] = live[c] = new
            if max(abs(a[1] - b[1]) for a, b in zip(new, ms)) < tol:
                del live[c]
    for c, ms in params.items():
        m, s = st[f"{c}__m"], st[f"{c}__s"]
        kept = [(j, *x) for j, x in enumerate(ms) if x[0] >= MIN_WEIGHT]
        total = sum(x[1] for x in kept)
        out += [(c, j, w / total, mu * s + m, sd * s) for j, w, mu, sd in kept]
    return spark.createDataFrame(out, MODES_SCHEMA)


def _maximise(r, n: int, old):
    if r is None or r["r"] <= EMPTY:
        return (EMPTY, old[1], old[2])
    mu = r["rz"] / r["r"]
    return (max(r["r"] / n, EMPTY), mu, math.sqrt(max(r["rzz"] / r["r"] - mu * mu, MIN_SD * MIN_SD)))


def mode_index(modes: list, v: Column) -> Column:
    """The likeliest mode of a value (ties: the first); null for null. ``modes``:
    (mode, weight, mean, sd) of one column."""
    if len(modes) == 1:
        return F.when(v.isNotNull(), F.lit(int(modes[0][0])).cast("long"))
    scored = [F.struct((F.lit(math.log(max(w, 1e-300)) - math.log(sd)) - F.pow((v - F.lit(mu)) / F.lit(sd), F.lit(2.0)) / F.lit(2.0)).alias("s"),
                       F.lit(-int(j)).cast("long").alias("j")) for j, w, mu, sd in modes]
    return F.when(v.isNotNull(), -F.array_max(F.array(*scored))["j"])


def mode_value(lo: float, hi: float, w: Column, w2: Column, integral: bool) -> Column:
    """A value of the mode whose interval is [lo, hi] = mean -+ SPAN sd: a normal
    deviate of two draws, held inside the interval."""
    z = F.sqrt(F.lit(-2.0) * F.log(w)) * F.cos(F.lit(2.0 * math.pi) * w2)
    z = F.greatest(F.least(z, F.lit(SPAN)), F.lit(-SPAN))
    x = F.lit((lo + hi) / 2.0) + z * F.lit((hi - lo) / (2.0 * SPAN))
    return F.floor(x + F.lit(0.5)).cast("double") if integral else x
