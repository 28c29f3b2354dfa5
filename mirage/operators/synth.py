"""Generators re-aimed as Spark synthesizers.

A fitted generator is a small tidy DataFrame (the *model table*): one row per
(column, bin) - or per (column, parent bin, bin) for conditional families -
with its probability and cumulative interval ``[cum_lo, cum_hi)``. Fitting is
one grouped count over the unpivoted private table plus noise. Text columns
(``categorical_columns``) are categories at any width, numbers below 5 values.
Columns of up to ``INLINE_CATEGORIES`` categories are read into a ``CASE`` chain
evaluated inside whole-stage codegen over ``spark.range(count)``: no join, no
shuffle, any number of rows. Wider ones (kind ``wide``) stay a distributed table:
a draw finds its category by an equi-join on its part of [0, 1), the categories
being listed under the parts they cover (a guide table).

Noise is a pure function of (seed, column, bin) through ``draw``; pass no seed
to get one from ``secrets`` (the right default when real data is protected).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.functions.draws import draw, fresh_seed
from mirage.functions.ordering import ordered_index, prefix_sum, take_first, top_k_per_group
from mirage.operators.distance import nearest_distance, nearest_neighbor, nearest_other
from mirage.operators.frequencies import bin_profile, feature_columns, to_long, value_key
from mirage.operators.modes import PASSES, SPAN, fit_value_modes, mode_index, mode_value
from mirage.operators.prep import INTEGRAL, categorical_columns, dedupe, match_constraints
from mirage.session import cut_lineage

N_BINS = 10
MODEL_MAX_ROWS = 200_000  # a model's inlined rows are metadata; refuse to inline more than this
INLINE_CATEGORIES = 256

MODEL_COLUMNS = ["family", "column", "kind", "bin", "bin_lo", "bin_hi", "parent", "parent_bin",
                 "noisy", "p", "cum_lo", "cum_hi", "integral", "n_train"]


def _bin_index(prof_cat: Column, k: Column) -> Column:
    idx = F.least(F.floor((F.col("v") - F.col("lo")) * k.cast("double") / (F.col("hi") - F.col("lo"))), k - 1)
    cat_key = value_key(F.col("v"))
    return F.when(prof_cat, cat_key).otherwise(idx.cast("long"))


def _profile(df: DataFrame, cols, n_bins: int, domain: dict | None) -> DataFrame:
    prof = bin_profile(df, cols, n_bins, categorical_columns(df))
    if not domain:
        return prof
    spark = df.sparkSession
    rows = [(c, float(lo), float(hi)) for c, (lo, hi) in domain.items()]
    pub = spark.createDataFrame(rows, "column string, d_lo double, d_hi double")
    return (prof.join(F.broadcast(pub), "column", "left")
            .withColumn("lo", F.coalesce("d_lo", "lo")).withColumn("hi", F.coalesce("d_hi", "hi"))
            .withColumn("n_bins", F.when(F.col("d_lo").isNotNull(), F.lit(n_bins).cast("long")).otherwise(F.col("n_bins")))
            .withColumn("categorical", F.when(F.col("d_lo").isNotNull(), F.lit(False)).otherwise(F.col("categorical")))
            .drop("d_lo", "d_hi"))


def noise(mechanism: str, count: Column, scale, seed, key: Column, delta: float | None = None, bits: int = 32) -> Column:
    """Noisy count clamped at 0. Laplace / Gaussian (delta given) / two-sided
    geometric. ``scale`` (= k / epsilon) may be a number or a column (a sweep
    over candidate epsilons)."""
    u = draw(seed, "noise", key, bits)
    if not isinstance(scale, Column):
        if scale == 0:
            return count.cast("double")
        scale = F.lit(float(scale))
    if mechanism == "geometric":
        mag = F.floor(F.log(F.lit(1.0) - F.abs(F.lit(2.0) * u - F.lit(1.0))) / (F.lit(-1.0) / scale))
        return F.greatest(count + F.signum(u - F.lit(0.5)) * mag, F.lit(0.0))
    if delta is not None:
        sigma = scale * F.lit(math.sqrt(2.0 * math.log(1.25 / delta)))
        u2 = draw(seed, "noise2", key, bits)
        z = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * u2)
        return F.greatest(count + sigma * z, F.lit(0.0))
    lap = scale * F.signum(u - F.lit(0.5)) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u - F.lit(0.5)))
    return F.greatest(count - lap, F.lit(0.0))


def _finish(model: DataFrame, group=("column",)) -> DataFrame:
    """p = noisy / sum (uniform when all zero); cumulative interval per group.
    The model table is small (bins per column), so these windows are tiny."""
    g = list(group)
    w_all = Window.partitionBy(*g)
    w_run = Window.partitionBy(*g).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    w_ord = Window.partitionBy(*g).orderBy("bin")
    tot = F.sum("noisy").over(w_all)
    n = F.count(F.lit(1)).over(w_all)
    p = F.when(tot > 0, F.col("noisy") / tot).otherwise(F.lit(1.0) / n)
    m = model.withColumn("p", p).withColumn("cum_hi", F.sum("p").over(w_run))
    m = m.withColumn("cum_lo", F.coalesce(F.lag("cum_hi", 1).over(w_ord), F.lit(0.0)))
    last = F.row_number().over(Window.partitionBy(*g).orderBy(F.col("bin").desc())) == 1
    return m.withColumn("cum_hi", F.when(last, F.lit(1.0)).otherwise(F.col("cum_hi")))


def marginal_counts(df: DataFrame, cols, prof: DataFrame | None = None) -> DataFrame:
    """True counts per (column, bin) with the bin's place: a working table of the
    fit that must not leave it. ``prof`` is the profile of ``cols``."""
    prof = _profile(df, cols, N_BINS, None) if prof is None else prof
    long = to_long(df, cols).filter(F.col("v").isNotNull())
    binned = long.join(F.broadcast(prof), "column")
    binned = binned.filter(F.col("categorical") | ((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))))
    counts = (binned.withColumn("bin", _bin_index(F.col("categorical"), F.col("n_bins")))
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"), F.first("v").alias("v0")))
    # Counts are one row per (column, bin): bounded metadata, kept locally too.
    counts = _local(counts, "too many bins to fit a model; reduce bins or categories")
    grid = (prof.filter(~F.col("categorical"))
            .select("column", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin")))
    cat_rows = counts.join(F.broadcast(prof.filter(F.col("categorical")).select("column")), "column", "left_semi")
    hist_rows = grid.join(counts, ["column", "bin"], "left")
    return (cat_rows.select("column", "bin", "count", "v0").unionByName(hist_rows.select("column", "bin", "count", "v0"))
            .join(F.broadcast(prof), "column").withColumn("count", F.coalesce("count", F.lit(0)).cast("double")))


def _local(df: DataFrame, message: str) -> DataFrame:
    """A table of at most ``MODEL_MAX_ROWS`` rows, computed once."""
    rows = df.limit(MODEL_MAX_ROWS + 1).collect()
    if len(rows) > MODEL_MAX_ROWS:
        raise ValueError(message)
    return df.sparkSession.createDataFrame(rows, df.schema)


def dp_fit(df: DataFrame, epsilon: float | None, seed=None, cols=None, delta: float | None = None,
           mechanism: str = "laplace", n_bins: int = N_BINS, cap: int = 1, domain: dict | None = None,
           family: str = "dp") -> DataFrame:
    """Noisy one-way marginals. One row adds 1 to each of k histograms, so
    the noise scale is k * cap / epsilon (Laplace, geometric) or sqrt(k) * cap /
    epsilon (Gaussian, ``delta`` given); epsilon None/inf gives exact counts.
    The model holds noisy counts only; its ``n_train`` is their mean total."""
    cols = list(cols or feature_columns(df))
    bits = 52 if seed is None else 32
    seed = fresh_seed() if seed is None else seed
    types = {f.name: f.dataType for f in df.schema.fields}
    integral = [c for c in cols if isinstance(types[c], INTEGRAL)]
    prof = _profile(df, cols, n_bins, domain)
    wide = [r["column"] for r in prof.collect() if r["categorical"] and r["n_distinct"] > INLINE_CATEGORIES]  # one row per column
    k = len(cols) if delta is None else math.sqrt(len(cols))
    scale = 0.0 if epsilon is None or math.isinf(epsilon) else k * cap / float(epsilon)
    key = F.concat_ws("|", F.col("column"), F.col("bin").cast("string"))

    def noisy(count: Column) -> Column:
        return noise(mechanism, count, scale, seed, key, delta, bits)

    is_int = F.col("column").isin(integral) if integral else F.lit(False)
    spread, totals = (_wide_marginals(df, wide, noisy, is_int, family) if wide else (None, []))
    narrow = [c for c in cols if c not in wide]
    model = marginal_counts(df, narrow, prof.filter(~F.col("column").isin(wide)) if wide else prof) if narrow else None
    if model is None:
        return spread.withColumn("n_train", F.lit(math.floor(sum(totals) / len(totals) + 0.5)))
    width = (F.col("hi") - F.col("lo")) / F.col("n_bins").cast("double")
    model = (model.withColumn("noisy", noisy(F.col("count")))
             .withColumn("kind", F.when(F.col("categorical"), F.lit("cat")).otherwise(F.lit("hist")))
             .withColumn("bin_lo", F.when(F.col("categorical"), F.col("v0"))
                         .otherwise(F.col("lo") + F.col("bin").cast("double") * width))
             .withColumn("bin_hi", F.when(F.col("categorical"), F.col("v0"))
                         .otherwise(F.col("lo") + (F.col("bin") + 1).cast("double") * width)))
    model = model.select(F.lit(family).alias("family"), "column", "kind", "bin", "bin_lo", "bin_hi",
                         F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_bin"),
                         "noisy", is_int.alias("integral"), F.lit(None).cast("long").alias("n_train"))
    model = _finish_local(model, ("column",), totals)
    if spread is None:
        return model
    return model.unionByName(spread.withColumn("n_train", F.lit(model.first()["n_train"]).cast("long")).select(model.columns))


def _wide_marginals(df: DataFrame, cols: list, noisy, is_int: Column, family: str) -> tuple[DataFrame, list[float]]:
    """Model rows of wide categorical columns, as a written table, and the columns'
    noisy totals. No category list is held in one place."""
    counts = (to_long(df, cols).filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).cast("double").alias("count"))
              .withColumn("bin", value_key(F.col("v"))))
    counts = cut_lineage(counts.withColumn("noisy", noisy(F.col("count"))).drop("count"))
    per_col = counts.groupBy("column").agg(F.sum("noisy").alias("_tot"), F.count(F.lit(1)).alias("_m"), F.max("bin").alias("_last"))
    per_col = df.sparkSession.createDataFrame(per_col.collect(), per_col.schema)  # one row per column
    share = counts.join(F.broadcast(per_col), "column").withColumn(
        "p", F.when(F.col("_tot") > 0, F.col("noisy") / F.col("_tot")).otherwise(F.lit(1.0) / F.col("_m")))
    cum = prefix_sum(share, ["bin"], "p", group_cols=["column"], name="cum_lo")
    out = cum.select(
        F.lit(family).alias("family"), "column", F.lit("wide").alias("kind"), "bin", F.col("v").alias("bin_lo"), F.col("v").alias("bin_hi"),
        F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_bin"), "noisy", "p", "cum_lo",
        F.when(F.col("bin") == F.col("_last"), F.lit(1.0)).otherwise(F.col("cum_lo_hi")).alias("cum_hi"), is_int.alias("integral"))
    return cut_lineage(out), [r["_tot"] for r in per_col.collect()]


MODEL_SCHEMA = ("family string, column string, kind string, bin long, bin_lo double, bin_hi double, "
                "parent string, parent_bin long, noisy double, p double, cum_lo double, "
                "cum_hi double, integral boolean, n_train long")


def _finish_local(model: DataFrame, group=("column",), totals=()) -> DataFrame:
    """``_finish`` for a bounded model table (columns x bins, size-checked):
    collected once, shares and cumulative intervals in bin order, kept as a
    local table. Same arithmetic as the windowed form: sequential sums.
    ``totals``: noisy totals of columns kept elsewhere, for ``n_train``."""
    rows = model.limit(MODEL_MAX_ROWS + 1).collect()
    if len(rows) > MODEL_MAX_ROWS:
        raise ValueError("model table too large; reduce bins or categories")
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r[g] for g in group), []).append(r.asDict())
    out = []
    every = sum(r["noisy"] for _, rs in sorted(groups.items(), key=str) for r in rs) + sum(totals)
    total = math.floor(every / max(len(groups) + len(totals), 1) + 0.5)
    for _, rs in sorted(groups.items(), key=lambda kv: tuple(str(x) for x in kv[0])):
        rs.sort(key=lambda r: r["bin"])
        tot = 0.0
        for r in rs:
            tot += r["noisy"]
        run = 0.0
        for i, r in enumerate(rs):
            r["n_train"] = total if r["n_train"] is None else r["n_train"]
            r["p"] = r["noisy"] / tot if tot > 0 else 1.0 / len(rs)
            r["cum_lo"] = run
            run += r["p"]
            r["cum_hi"] = 1.0 if i == len(rs) - 1 else run
            out.append(r)
    cols = [c.split()[0] for c in MODEL_SCHEMA.split(", ")]
    return model.sparkSession.createDataFrame([tuple(r.get(c) for c in cols) for r in out], MODEL_SCHEMA)


def bound_contribution(df: DataFrame, unit: str, cap: int, seed=0, id_col: str = "row_id") -> DataFrame:
    """Keep at most ``cap`` rows per unit (chosen by a seeded draw); a unit
    holding a third of the table is split by the salted top-k."""
    keyed = df.withColumn("_u", draw(seed, "unit", F.col(id_col)))
    return top_k_per_group(keyed, [unit], ["_u", id_col], cap, name="_rk").drop("_u", "_rk")


# --- generation --------------------------------------------------------------

def _inline(model: DataFrame) -> list:
    rows = model.filter("kind <> 'wide'").limit(MODEL_MAX_ROWS + 1).collect()
    if len(rows) > MODEL_MAX_ROWS:
        raise ValueError("model table too large to inline; reduce bins or categories")
    return rows


def _wide_columns(model: DataFrame) -> list:
    """(column, categories, training size) of the wide columns: one row per column."""
    return model.filter("kind = 'wide'").groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.max("n_train").alias("n_train")).orderBy("column").collect()


def _value_expr(rows, u: Column, w: Column, integral: bool, w2: Column | None = None) -> Column:
    """CASE chain over one column's bins (ordered): u picks [cum_lo, cum_hi)."""
    rows = sorted(rows, key=lambda r: r["bin"])
    def val(r):
        if r["kind"] == "cat":
            return F.lit(float(r["bin_lo"]))
        if r["kind"] == "mode":
            return mode_value(float(r["bin_lo"]), float(r["bin_hi"]), w, w2, integral)
        v = F.lit(float(r["bin_lo"])) + w * F.lit(float(r["bin_hi"] - r["bin_lo"]))
        return F.floor(v).cast("double") if integral else v
    expr = None
    for r in rows[:-1]:
        cond = u < F.lit(float(r["cum_hi"]))
        expr = F.when(cond, val(r)) if expr is None else expr.when(cond, val(r))
    last = val(rows[-1])
    return last if expr is None else expr.otherwise(last)


def generate(model: DataFrame, count: int | None = None, seed=0, attempt=0,
             cond: DataFrame | None = None, id_col: str = "row_id", ids: DataFrame | None = None) -> DataFrame:
    """``count`` rows (default: the training size) from a model table.

    Unconditional columns draw their bin with ``u = draw(seed, column|attempt, i)``
    and a value inside it with a second draw. Conditional columns (``parent``
    set) choose among the bins of their parent's drawn bin. ``cond`` (columns
    ``row_id`` + the root column) fixes the root; its length must equal count.
    """
    rows, wide = _inline(model), _wide_columns(model)
    if not rows and not wide:
        raise RuntimeError("Fit the generator first")
    spark = model.sparkSession
    if count is None:
        count = int((rows or wide)[0]["n_train"])
    if cond is not None:
        roots = {r["column"] for r in rows if r["parent"] is None}
        fixed = [c for c in cond.columns if c in {r["column"] for r in rows}]
        if not any(r["parent"] is not None for r in rows) or not fixed or not set(fixed) <= roots:
            raise ValueError("a condition needs a model fitted with that column as its condition")
        ids = cond
        if ids.count() != count:
            raise ValueError("condition length must equal count")
    elif ids is None:
        ids = spark.range(count).withColumnRenamed("id", id_col)
    by_col: dict = {}
    order: list = []
    for r in rows:
        if r["column"] not in by_col:
            order.append(r["column"])
        by_col.setdefault(r["column"], []).append(r)
    parents = {c: rs[0]["parent"] for c, rs in by_col.items()}
    done = set(ids.columns)
    out = ids
    att = F.col(attempt).cast("string") if isinstance(attempt, str) else F.lit(str(attempt))
    tag = lambda c, extra="": F.concat_ws("|", F.lit(c), att, *([F.lit(extra)] if extra else []))
    # Topological order: roots first, then children whose parent is done.
    pending = [c for c in order if c not in done]
    bin_cols = {}
    if cond is not None:
        for c in order:
            if c in cond.columns and c != id_col:
                bin_cols[c] = _bin_of(by_col[c], F.col(c))
    while pending:
        progressed = False
        for c in list(pending):
            p = parents[c]
            if p is not None and p not in bin_cols:
                continue
            # Draws become columns first so the CASE chains below reference them
            # instead of repeating the hash in every branch.
            out = out.withColumn(f"_u_{c}", draw(seed, tag(c), F.col(id_col)))
            out = out.withColumn(f"_w_{c}", draw(seed, tag(c, "in"), F.col(id_col)))
            u, w, w2 = F.col(f"_u_{c}"), F.col(f"_w_{c}"), None
            if by_col[c][0]["kind"] == "mode":
                out = out.withColumn(f"_w2_{c}", draw(seed, tag(c, "in2"), F.col(id_col)))
                w2 = F.col(f"_w2_{c}")
            integral = bool(by_col[c][0]["integral"])
            if p is None:
                val = _value_expr(by_col[c], u, w, integral, w2)
                binx = _bin_expr(by_col[c], u)
            else:
                val, binx = None, None
                for pb in sorted({r["parent_bin"] for r in by_col[c]}):
                    sub = [r for r in by_col[c] if r["parent_bin"] == pb]
                    cnd = bin_cols[p] == F.lit(pb)
                    one = _value_expr(sub, u, w, integral, w2)
                    val = F.when(cnd, one) if val is None else val.when(cnd, one)
                    binx = F.when(cnd, _bin_expr(sub, u)) if binx is None else binx.when(cnd, _bin_expr(sub, u))
            out = out.withColumn(c, val).withColumn(f"_bin_{c}", binx)
            bin_cols[c] = F.col(f"_bin_{c}")
            pending.remove(c)
            progressed = True
        if not progressed:
            raise ValueError("model has a cycle or a missing parent column")
    for r in wide:
        c, buckets = r["column"], 1 << max(int(r["n"]).bit_length(), 1)
        if c in done:
            continue
        table = model.filter((F.col("kind") == "wide") & (F.col("column") == c)).select(
            F.col("bin_lo").alias(c), F.col("cum_lo").alias("_lo"), F.col("cum_hi").alias("_hi"))
        out = interval_lookup(out.withColumn("_u", draw(seed, tag(c), F.col(id_col))), table, [], "_u", "_lo", "_hi", buckets).drop("_u", "_lo", "_hi")
        order.append(c)
    tags = [c for c in ids.columns if c != id_col and c not in order]
    keep = [id_col] + tags + [c for c in order if c in out.columns]
    return out.select(*keep)


def _bin_expr(rows, u: Column) -> Column:
    rows = sorted(rows, key=lambda r: r["bin"])
    expr = None
    for r in rows[:-1]:
        cond = u < F.lit(float(r["cum_hi"]))
        expr = F.when(cond, F.lit(r["bin"])) if expr is None else expr.when(cond, F.lit(r["bin"]))
    return F.lit(rows[-1]["bin"]) if expr is None else expr.otherwise(F.lit(rows[-1]["bin"]))


def _bin_of(rows, value: Column) -> Column:
    """Bin index of a given value (for a condition column)."""
    r0 = rows[0]
    if r0["kind"] == "cat":
        return value_key(value)
    if r0["kind"] == "mode":
        places = sorted({(r["bin"], r["bin_lo"], r["bin_hi"]) for r in rows})
        share = {r["bin"]: r["p"] for r in rows}  # a root: one row per mode
        return mode_index([(b, share[b], (lo + hi) / 2.0, (hi - lo) / (2.0 * SPAN)) for b, lo, hi in places], value.cast("double"))
    lo = min(r["bin_lo"] for r in rows)
    hi = max(r["bin_hi"] for r in rows)
    k = len({r["bin"] for r in rows})
    return F.least(F.floor((value - F.lit(lo)) * F.lit(float(k)) / F.lit(hi - lo)), F.lit(k - 1)).cast("long")


# --- Y5 / Y6: pair dependence and conditional tables --------------------------

def _binned_wide(df: DataFrame, cols, n_bins: int, modes: dict | None = None) -> tuple[DataFrame, DataFrame]:
    prof = bin_profile(df, cols, n_bins, categorical_columns(df))
    p = {r["column"]: r for r in prof.collect()}  # one row per column
    exprs = []
    for c in cols:
        r = p[c]
        v = F.col(c).cast("double")
        if modes and c in modes:
            exprs.append(mode_index(modes[c], v).alias(c))
        elif r["categorical"]:
            exprs.append(value_key(v).alias(c))
        else:
            k = int(r["n_bins"])
            span = (r["hi"] - r["lo"]) or 1.0
            exprs.append(F.least(F.floor((v - F.lit(r["lo"])) * F.lit(float(k)) / F.lit(span)),
                                 F.lit(k - 1)).cast("long").alias(c))
    return df.select("row_id", *exprs), prof


def pair_mutual_information(df: DataFrame, cols=None, n_bins: int = N_BINS, modes: dict | None = None) -> DataFrame:
    """I(a, b) = sum p_ab ln(p_ab / (p_a p_b)) for every column pair, from one
    pair-count job (each row emits one record per column pair, map-side combined)."""
    cols = list(cols or feature_columns(df))
    wide, _ = _binned_wide(df, cols, n_bins, modes)
    return pair_information(wide, cols)


def pair_information(wide: DataFrame, cols) -> DataFrame:
    """Mutual information of every pair of columns of bins: (a, b, mi)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    rec = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                       F.col(a).alias("ba"), F.col(b).alias("bb")) for a, b in pairs]))
    pc = wide.select(rec.alias("r")).select("r.*").groupBy("a", "b", "ba", "bb").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n").over(Window.partitionBy("a", "b"))
    na = F.sum("n").over(Window.partitionBy("a", "b", "ba"))
    nb = F.sum("n").over(Window.partitionBy("a", "b", "bb"))
    t = pc.select("a", "b", "n", n.alias("t"), na.alias("na"), nb.alias("nb"))
    return (t.groupBy("a", "b").agg(F.sum((F.col("n") / F.col("t")) * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
                                    .alias("mi")))


def chow_liu_tree(mi_rows: list, cols: list, root: str | None = None) -> dict:
    """Maximum spanning tree over pair MI (driver side: columns x columns numbers).
    Ties by name; root = first column name unless given. Returns child -> parent."""
    edges = sorted(((r["mi"], r["a"], r["b"]) for r in mi_rows), key=lambda e: (-e[0], e[1], e[2]))
    comp = {c: c for c in cols}

    def find(x):
        while comp[x] != x:
            comp[x] = comp[comp[x]]
            x = comp[x]
        return x
    adj: dict = {c: [] for c in cols}
    for _, a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            comp[ra] = rb
            adj[a].append(b)
            adj[b].append(a)
    root = root or sorted(cols)[0]
    parent = {root: None}
    stack = [root]
    while stack:
        x = stack.pop()
        for y in sorted(adj[x]):
            if y not in parent:
                parent[y] = x
                stack.append(y)
    for c in cols:  # disconnected columns become roots
        parent.setdefault(c, None)
    return parent


def modes_fit(df: DataFrame, epsilon: float | None = None, seed=None, cols=None, n_bins: int = N_BINS,
              cond: str | None = None, family: str = "modes", modes: int | None = None, passes: int = PASSES,
              tol: float = 1e-3) -> DataFrame:
    """Tree of conditional tables. Pair MI picks the tree (root = ``cond``
    when conditional generation is wanted); the root keeps its marginal, every
    child a table per parent bin. The tree itself is chosen from exact pair
    counts, so epsilon covers the tables but not the choice of the tree. Wide
    columns keep their marginal: a table per pair of their categories is no model.

    ``modes``: number columns that would be histograms get up to that many value
    modes instead of equal bins (``fit_value_modes``): a row counts for the likeliest
    mode of its value, generation draws a mode, then a value around its mean. The
    places of the modes are exact statistics, as the tree is."""
    every = list(cols or feature_columns(df))
    seed = fresh_seed() if seed is None else seed
    found = _column_modes(df, every, n_bins, modes, passes, tol) if modes else {}
    base = _mode_base(df, epsilon, seed, every, n_bins, family, found) if found else dp_fit(
        df, epsilon, seed, every, n_bins=n_bins, family=family)
    spread = {r["column"] for r in _wide_columns(base)}
    if cond in spread:
        raise ValueError("a wide column can't be the condition")
    cols = [c for c in every if c not in spread]
    if len(cols) < 2:
        return base
    mi = pair_mutual_information(df, cols, n_bins, found).collect()
    parent = chow_liu_tree(mi, cols, root=cond)
    kept, base = base.filter("kind = 'wide'"), base.filter("kind <> 'wide'")
    roots = [c for c in cols if parent[c] is None]
    wide, prof = _binned_wide(df, cols, n_bins, found)
    children = [(c, parent[c]) for c in cols if parent[c] is not None]
    if not children:
        return base.unionByName(kept)
    rec = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("parent"),
                                       F.col(p).alias("parent_bin"), F.col(c).alias("bin")) for c, p in children]))
    pc = (wide.select(rec.alias("r")).select("r.*").groupBy("column", "parent", "parent_bin", "bin")
          .agg(F.count(F.lit(1)).alias("count")))
    marg = base.select("column", "kind", "bin", "bin_lo", "bin_hi", "integral", "n_train")
    # Every child bin appears under every bin the parent's table can draw, also
    # those without a real row (zero counts get noise too).
    tree = df.sparkSession.createDataFrame(children, "column string, parent string")
    grid = (tree.join(marg.select(F.col("column").alias("parent"), F.col("bin").alias("parent_bin")), "parent")
            .join(marg.select("column", "bin"), "column"))
    cnt = grid.join(pc, ["column", "parent", "parent_bin", "bin"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0)).cast("double"))
    scale = 0.0 if epsilon is None or math.isinf(epsilon) else (len(every) + len(children)) / float(epsilon)
    key = F.concat_ws("|", F.col("column"), F.col("parent_bin").cast("string"), F.col("bin").cast("string"))
    cnt = cnt.withColumn("noisy", noise("laplace", F.col("count"), scale, seed, key))
    cond_t = cnt.join(marg, ["column", "bin"]).select(
        F.lit(family).alias("family"), "column", "kind", "bin", "bin_lo", "bin_hi", "parent",
        F.col("parent_bin").cast("long").alias("parent_bin"), "noisy", "integral", "n_train")
    cond_t = _finish_local(cond_t, ("column", "parent_bin"))
    out_roots = base.filter(F.col("column").isin(roots)) if roots else base.limit(0)
    model = out_roots.select(*MODEL_COLUMNS).unionByName(cond_t.select(*MODEL_COLUMNS))
    # Read by every generation: kept as a local table without lineage.
    model = _local(model, "model table too large; reduce bins or categories")
    return model.unionByName(kept.select(*MODEL_COLUMNS)) if spread else model


def _column_modes(df: DataFrame, cols, n_bins: int, k: int, passes: int, tol: float) -> dict:
    """Column -> [(mode, weight, mean, sd)] for the columns that are no categories
    and have a spread."""
    prof = bin_profile(df, cols, n_bins, categorical_columns(df)).collect()  # one row per column
    numeric = sorted(r["column"] for r in prof if not r["categorical"] and r["lo"] is not None and r["lo"] < r["hi"])
    found: dict = {}
    if numeric:
        for r in fit_value_modes(df, numeric, k, passes, tol).orderBy("column", "mode").collect():  # columns x modes
            found.setdefault(r["column"], []).append((r["mode"], r["weight"], r["mean"], r["sd"]))
    return found


def _mode_base(df: DataFrame, epsilon, seed, cols: list, n_bins: int, family: str, found: dict) -> DataFrame:
    """Noisy marginals of all ``cols``, those in ``found`` over their modes. Every
    column's counts get the noise that ``dp_fit`` of all of them would give."""
    spark = df.sparkSession
    scale = 0.0 if epsilon is None or math.isinf(epsilon) else len(cols) / float(epsilon)
    place = spark.createDataFrame(
        [(c, j, mu - SPAN * sd, mu + SPAN * sd, isinstance(df.schema[c].dataType, INTEGRAL))
         for c, ms in found.items() for j, _, mu, sd in ms],
        "column string, bin long, bin_lo double, bin_hi double, integral boolean")
    rec = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), mode_index(ms, F.col(c).cast("double")).alias("bin"))
                              for c, ms in found.items()]))
    counts = df.select(rec.alias("r")).select("r.*").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    key = F.concat_ws("|", F.col("column"), F.col("bin").cast("string"))
    model = (place.join(counts, ["column", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("double"))
             .select(F.lit(family).alias("family"), "column", F.lit("mode").alias("kind"), "bin", "bin_lo", "bin_hi",
                     F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("parent_bin"),
                     noise("laplace", F.col("count"), scale, seed, key).alias("noisy"), "integral",
                     F.lit(None).cast("long").alias("n_train")))
    model = _finish_local(model)
    rest = [c for c in cols if c not in found]
    if not rest:
        return model
    part = None if epsilon is None or math.isinf(epsilon) else epsilon * len(rest) / len(cols)
    other = dp_fit(df, part, seed, rest, n_bins=n_bins, family=family)
    return model.unionByName(other.withColumn("n_train", F.lit(model.first()["n_train"]).cast("long")).select(model.columns))


def value_modes(df: DataFrame, col: str, max_clusters: int = 10, seed: int = 3) -> DataFrame:
    """Value modes of a numeric column (spark.ml GaussianMixture): (column, mode, weight, mean, sd)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    nd = df.agg(F.count_distinct(col)).first()[0]
    k = max(1, min(max_clusters, int(nd)))
    data = VectorAssembler(inputCols=[col], outputCol="features").transform(df.select(F.col(col).cast("double").alias(col)).na.drop())
    if k == 1:
        st = data.agg(F.avg(col), F.stddev_samp(col)).first()
        return spark.createDataFrame([(col, 0, 1.0, float(st[0]), float(st[1] or 0.0))],
                                     "column string, mode int, weight double, mean double, sd double")
    m = GaussianMixture(k=k, seed=seed, maxIter=50).fit(data)
    g = m.gaussiansDF.collect()
    rows = [(col, i, float(w), float(r["mean"][0]), float(math.sqrt(max(r["cov"].toArray()[0][0], 0.0))))
            for i, (w, r) in enumerate(zip(m.weights, g))]
    return spark.createDataFrame(rows, "column string, mode int, weight double, mean double, sd double")


# --- Y7 marginal correction -----------------------------------------------------

def adjust_marginals(syn: DataFrame, real: DataFrame, col: str, seed=0, n_bins: int = N_BINS,
                     id_col: str = "row_id") -> DataFrame:
    """Resample synthetic rows so that ``col``'s bins follow the real shares.

    Weight per bin w = p_real / p_syn; systematic resampling in row-id order
    inside each bin with one offset draw per bin: row r (1-based) of bin b gets
    floor(w r + o) - floor(w (r - 1) + o) copies. Ranks come from the
    distributed index, so a hot bin is not one task.
    """
    prof = bin_profile(real, [col], n_bins, categorical_columns(real)).first()
    v = F.col(col).cast("double")
    if prof["categorical"]:
        b = value_key(v)
    else:
        k = int(prof["n_bins"])
        span = (prof["hi"] - prof["lo"]) or 1.0
        b = F.least(F.greatest(F.floor((v - F.lit(prof["lo"])) * F.lit(float(k)) / F.lit(span)), F.lit(0)),
                    F.lit(k - 1)).cast("long")
    pr = real.select(b.alias("_bin")).groupBy("_bin").agg(F.count(F.lit(1)).alias("nr"))
    ps = syn.select(b.alias("_bin")).groupBy("_bin").agg(F.count(F.lit(1)).alias("ns"))
    tr, ts = real.count(), syn.count()
    w = (pr.join(ps.withColumnRenamed("_bin", "_sb"), F.col("_bin").eqNullSafe(F.col("_sb"))).select(F.col("_bin").alias("_wb"), ((F.col("nr") / F.lit(float(tr))) / (F.col("ns") / F.lit(float(ts)))).alias("_w")))
    ranked = ordered_index(syn.withColumn("_bin", b), [id_col], group_cols=["_bin"], name="_r")
    j = ranked.join(F.broadcast(w), F.col("_bin").eqNullSafe(F.col("_wb"))).drop("_wb")  # one row per bin; null is a bin
    off = draw(seed, "offset", F.concat_ws("|", F.lit(col), F.col("_bin").cast("string")))
    copies = (F.floor(F.col("_w") * (F.col("_r") + 1) + off) - F.floor(F.col("_w") * F.col("_r") + off)).cast("int")
    out = j.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.drop("_bin", "_w", "_r", "_copies")


# --- Y8 / Y9 identifiability guard -------------------------------------------------

def guard_identifiable(syn: DataFrame, real: DataFrame, cols=None, weight: float = 0.1) -> DataFrame:
    """Drop generated rows that sit closer to their nearest real row than
    ``weight`` times that real row's distance to its own nearest other real row."""
    cols = list(cols or feature_columns(real))
    nn = cut_lineage(nearest_neighbor(syn, real, cols, name="d_gen"))
    met = real.join(nn.select(F.col("nn_id").alias("row_id")).distinct(), "row_id", "left_semi")  # only these are asked for their own
    own = nearest_other(met, cols, name="d_own", among=real).withColumnRenamed("row_id", "nn_id")
    bad = (nn.join(own, "nn_id").filter(F.col("d_gen") < F.lit(weight) * F.col("d_own")).select("row_id"))
    return syn.join(bad, "row_id", "left_anti")


def ads_fit(df: DataFrame, epsilon: float | None, seed=None, cols=None, **kw) -> DataFrame:
    """The DP + guard family. Its model table is a DP marginal model; the guard
    is applied at generation by ``ads_generate`` (reading real rows there voids
    the DP guarantee - documented)."""
    return dp_fit(df, epsilon, seed, cols, family="ads", **kw)


def ads_generate(model: DataFrame, real: DataFrame, count: int, seed=0, weight: float = 0.1,
                 patience: int = 500, cols=None) -> DataFrame:
    def batch(i, n):
        g = generate(model, n, seed, attempt=i)
        return guard_identifiable(g, real, cols or [c for c in g.columns if c != "row_id"], weight)
    return accumulate(batch, count, patience=patience)


# --- U2 / Y11 accumulate and constraints ---------------------------------------------

def _first_copies(acc: DataFrame, id_col: str) -> DataFrame:
    cols = [c for c in acc.columns if c not in (id_col, "_batch")]
    return (acc.groupBy(*cols).agg(F.min(F.struct("_batch", id_col)).alias("_k"))
            .select(*cols, F.col("_k._batch").alias("_batch"), F.col(f"_k.{id_col}").alias(id_col)))


def accumulate(make_batch, count: int, patience: int = 500, strict_dedupe: bool = False,
               id_col: str = "row_id") -> DataFrame:
    """Append accepted batches until ``count`` rows exist (at most
    ``patience`` batches). Batch i is ``make_batch(i, count)``: always a whole
    draw, so a low acceptance rate never ends in one-row batches; each batch is
    materialised once, rows keep a (batch, row) order and are renumbered."""
    parts, i, got = [], 0, 0
    while got < count and i < patience:
        parts.append(cut_lineage(make_batch(i, count).withColumn("_batch", F.lit(i))))
        acc = reduce(DataFrame.unionByName, parts)
        if strict_dedupe:
            acc = _first_copies(acc, id_col)
            got = acc.count()
        else:
            got += parts[-1].count()
        i += 1
    first = take_first(acc, ["_batch", id_col], count)
    out = ordered_index(first.withColumnRenamed(id_col, "_old"), ["_batch", "_old"], name=id_col)
    return out.drop("_batch", "_old")


def generate_constrained(model: DataFrame, count: int, rules: DataFrame, seed=0, strict: bool = True,
                         patience: int = 500) -> DataFrame:
    """Generated rows filtered by rules; strict also dedupes and raises when short."""
    def batch(i, n):
        return match_constraints(generate(model, n, seed, attempt=i), rules)
    out = accumulate(batch, count, patience=patience, strict_dedupe=strict)
    if strict and out.count() < count:
        raise ValueError("could not generate enough rows that satisfy the constraints")
    return out


def head(df: DataFrame, count: int, id_col: str = "row_id") -> DataFrame:
    """First ``count`` rows in row-id order."""
    return take_first(df, [id_col], count)


# --- Y10 log-frequency conditional sampler ----------------------------------------------

def log_frequency_sample(df: DataFrame, discrete_columns, count: int, seed=0, id_col: str = "row_id") -> DataFrame:
    """Per sample: a discrete column uniformly, a category with p ~ ln(1 + count),
    then a training row of that category (rank floor(u * size) in row-id order)."""
    spark = df.sparkSession
    m = len(discrete_columns)
    long = df.select(id_col, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category"))
                                                 for c in discrete_columns])).alias("kv")).select(id_col, "kv.*")
    cats = long.groupBy("column", "category").agg(F.count(F.lit(1)).alias("size"))
    wcol = F.log1p(F.col("size").cast("double"))
    # Per-column totals and last category: one row per discrete column.
    per_col = cats.groupBy("column").agg(F.sum(wcol).alias("_tot"), F.max("category").alias("_last"))
    cats = cats.join(F.broadcast(per_col), "column").withColumn("p", wcol / F.col("_tot"))
    # Cumulative shares with the distributed prefix sum: a column may have
    # millions of categories, so no window over a whole column.
    pmf = prefix_sum(cats, ["category"], "p", group_cols=["column"], name="cum_lo")
    pmf = pmf.withColumn("cum_hi", F.when(F.col("category").eqNullSafe(F.col("_last")), F.lit(1.0)).otherwise(F.col("cum_lo_hi")))
    colnames = F.array(*[F.lit(c) for c in discrete_columns])
    s = spark.range(count).withColumnRenamed("id", "sample_id")
    s = s.withColumn("column", F.element_at(colnames, (F.floor(draw(seed, "col", F.col("sample_id")) * F.lit(m)) + 1).cast("int")))
    s = s.withColumn("_u", draw(seed, "cat", F.col("sample_id"))).withColumn("_w", draw(seed, "row", F.col("sample_id")))
    pick = interval_lookup(s, pmf, ["column"], "_u", "cum_lo", "cum_hi")
    pick = pick.withColumn("_rank", F.floor(F.col("_w") * F.col("size")).cast("long"))
    ranked = ordered_index(long, [id_col], group_cols=["column", "category"], name="_r")
    ranked = ranked.withColumnsRenamed({"column": "_c", "category": "_k"})
    out = pick.join(ranked, (F.col("column") == F.col("_c")) & F.col("category").eqNullSafe(F.col("_k")) & (F.col("_rank") == F.col("_r")))
    return out.select("sample_id", "column", "category", id_col)


def interval_lookup(points: DataFrame, intervals: DataFrame, keys, u_col: str, lo_col: str, hi_col: str,
                    buckets: int = 1024) -> DataFrame:
    """Range join point u in [lo, hi) per key as an equi-join on (key, bucket):
    each interval is listed under every bucket of [0, 1) it overlaps, so the
    probe is a hash join plus one comparison, never a nested loop."""
    iv = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo_col) * buckets).cast("long"),
                                                          F.least(F.floor(F.col(hi_col) * buckets), F.lit(buckets - 1)).cast("long"))))
    pt = points.withColumn("_b", F.least(F.floor(F.col(u_col) * buckets), F.lit(buckets - 1)).cast("long"))
    j = pt.join(iv, [*keys, "_b"])
    return j.filter((F.col(u_col) >= F.col(lo_col)) & (F.col(u_col) < F.col(hi_col))).drop("_b")


# --- Y12 sequence stacking ------------------------------------------------------------

def stack_sequences(batches, id_col: str, count: int) -> DataFrame:
    """Shift each batch's sequence ids past the previous batches (offset =
    sum of earlier (max id + 1)), union, keep the first ``count`` sequences."""
    maxes = reduce(DataFrame.unionByName, [b.agg(F.max(id_col).alias("_mx")).withColumn("_batch", F.lit(i))
                                           for i, b in enumerate(batches)])
    off = maxes.withColumn("_off", F.coalesce(F.sum(F.col("_mx") + 1).over(
        Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per batch
    allb = reduce(DataFrame.unionByName, [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)])
    shifted = allb.join(F.broadcast(off.select("_batch", "_off")), "_batch").withColumn(
        id_col, F.col(id_col) + F.col("_off")).drop("_batch", "_off")
    keep = take_first(shifted.select(id_col).distinct(), [id_col], count)
    return shifted.join(keep, id_col, "left_semi")
