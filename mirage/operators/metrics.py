"""Privacy and utility metrics (M1-M9) as grouped Spark jobs.

Inputs are encoded (all-numeric) tables with a ``row_id``; ``cols`` names the
features (default: every column but the id). Each metric returns a one-row
DataFrame so results of many metrics union into one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.draws import draw
from mirage.functions.expr import normalize
from mirage.functions.ordering import over_cores
from mirage.operators.distance import nearest_distance, nearest_other, nearest_summary
from mirage.operators.prep import categorical_columns
from mirage.operators.frequencies import (column_entropy, column_frequencies, feature_columns,
                                          to_long)

WILSON_Z = 1.959964
N_ATTACKS = 500


def _cols(df, cols):
    return list(cols) if cols else feature_columns(df)


# --- M1 ------------------------------------------------------------------------

def nearest_neighbor_distance(real: DataFrame, syn: DataFrame, cols=None, by=()) -> DataFrame:
    """M1: distance from every real row to its closest synthetic row, min-max
    scaled over the real rows, averaged (0 when all distances are equal)."""
    cols = _cols(real, cols)
    if by:
        s = nearest_summary(real, syn, cols, by).withColumnRenamed("mean", "m")
    else:
        d = nearest_distance(real, syn, cols)
        s = d.agg(F.avg("dist").alias("m"), F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    return s.select(*by, F.when(F.col("hi") == F.col("lo"), F.lit(0.0))
                    .otherwise((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")))
                    .alias("nearest_neighbor_distance"))


# --- M2 / M3 ---------------------------------------------------------------------

def _identifiability(real_x: DataFrame, syn_x: DataFrame, cols, name: str, by=()) -> DataFrame:
    d_syn = nearest_distance(real_x, syn_x, cols, name="d_syn", by=by)
    d_real = nearest_other(real_x, cols, name="d_real")
    j = d_syn.join(d_real, "row_id")
    hit = F.coalesce(F.col("d_syn") < F.col("d_real"), F.lit(False))
    return j.groupBy(*by).agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias(name))


def entropy_weights(real: DataFrame, cols=None) -> dict:
    """1 / H_c per column (0 when the column has no entropy); one row per column."""
    cols = _cols(real, cols)
    h = {r["column"]: r["entropy"] for r in column_entropy(real, cols).collect()}
    return {c: (1.0 / h[c]) if h.get(c) else 0.0 for c in cols}


def identifiability(real: DataFrame, syn: DataFrame, cols=None, by=()) -> DataFrame:
    """M2: share of real rows whose closest synthetic row is nearer than their
    closest other real row, features weighted by 1 / entropy."""
    cols = _cols(real, cols)
    w = entropy_weights(real, cols)
    sc = lambda df, t=(): df.select("row_id", *t, *[(F.col(c).cast("double") * F.lit(w[c])).alias(c) for c in cols])
    return _identifiability(sc(real), sc(syn, by), cols, "identifiability", by)


def principal_axes(df: DataFrame, cols, k: int):
    """The ``k`` leading eigenvectors (columns x k numbers) of the Gram matrix of
    ``cols``: every partition sums its own products, the sums (columns x columns) are
    added in one aggregation. Rows with a null count for nothing. Axes point to where
    their largest entry is positive."""
    import numpy as np
    import pandas as pd

    cols = list(cols)
    c = len(cols)

    def products(it):
        g = np.zeros((c, c))
        for p in it:
            x = p[cols].to_numpy(np.float64)
            g += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(c), c), "j": np.tile(np.arange(c), c), "g": g.ravel()})

    part = df.select(*[F.col(x).cast("double").alias(x) for x in cols]).dropna().mapInPandas(products, "i int, j int, g double")
    g = np.zeros((c, c))
    for r in part.groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # columns x columns
        g[r["i"], r["j"]] = r["g"]
    axes = np.linalg.eigh((g + g.T) / 2.0)[1][:, ::-1][:, :k]
    return axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])


def identifiability_oc(real: DataFrame, syn: DataFrame, cols=None, by=(), pca: int | None = None) -> DataFrame:
    """M3: the same comparison in a space fitted on real rows only: z-scores
    with the real mean and sample standard deviation (0 when it is 0), with ``pca``
    their projections on that many principal axes of the real rows."""
    cols = _cols(real, cols)
    st = real.agg(*[F.avg(c).alias(f"{c}__m") for c in cols],
                  *[F.stddev_samp(c).alias(f"{c}__s") for c in cols]).first()

    def z(df, t=()):
        out = list(t)
        for c in cols:
            m, s = st[f"{c}__m"], st[f"{c}__s"]
            out.append(((F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(c) if s
                       else F.lit(0.0).alias(c))
        return df.select("row_id", *out)
    if not pca:
        return _identifiability(z(real), z(syn, by), cols, "identifiability_oc", by)
    axes = principal_axes(z(real), cols, min(int(pca), len(cols)))
    names = [f"axis{j}" for j in range(axes.shape[1])]

    def onto(df, t=()):
        return df.select("row_id", *t, *[reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(axes[i, j])) for i, c in enumerate(cols)]).alias(n)
                                         for j, n in enumerate(names)])
    return _identifiability(onto(z(real)), onto(z(syn, by), by), names, "identifiability_oc", by)


# --- M4 --------------------------------------------------------------------------

def data_leakage(real: DataFrame, syn: DataFrame, sensitive, cols=None, seed: int = 7) -> DataFrame:
    """M4: train on synthetic rows to predict each sensitive column from the
    others, score on real rows (accuracy for encoded text and booleans, or
    max(0, R^2) for numbers); mean. 0 when there is no sensitive column."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    spark = real.sparkSession
    cols = _cols(real, cols)
    categorical = set(categorical_columns(real))
    scores = []
    for s in sensitive or []:
        feats = [c for c in cols if c != s]
        va = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep")
        tr = va.transform(over_cores(syn.select(*feats, F.col(s).cast("double").alias("label"))))  # a pass an iteration
        te = va.transform(real.select(*feats, F.col(s).cast("double").alias("label")))
        mx = syn.agg(F.max(F.col(s).cast("double")).alias("mx")).first()["mx"]
        if s in categorical or mx is None:
            n_cls = int(mx) + 1 if mx is not None else 1
            if n_cls < 2:
                acc = te.agg(F.avg((F.col("label") == F.lit(0.0)).cast("double"))).first()[0] or 0.0
            else:
                mlp = MultilayerPerceptronClassifier(layers=[len(feats), 100, n_cls], seed=seed, maxIter=100)
                pred = mlp.fit(tr).transform(te)
                acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(pred)
            scores.append(float(acc))
        else:
            pred = GBTRegressor(seed=seed, maxIter=20).fit(tr).transform(te)
            r2 = RegressionEvaluator(metricName="r2").evaluate(pred)
            scores.append(max(0.0, float(r2)))
    value = sum(scores) / len(scores) if scores else 0.0
    return spark.createDataFrame([(value,)], "data_leakage double")


# --- M5 --------------------------------------------------------------------------

def _attack_key():
    # Values whose millionths don't fit in 64 bits are told apart as whole numbers.
    v = F.coalesce(F.round(F.col("v") * F.lit(1e6)).try_cast("bigint").cast("string"),
                   F.concat(F.lit("w"), F.round(F.col("v")).try_cast("decimal(38,0)").cast("string")), F.lit("null"))
    return F.md5(F.concat_ws("|", F.col("column"), F.col("op"), v))


def singling_out_attacks(syn: DataFrame, cols=None, n_attacks: int = N_ATTACKS) -> DataFrame:
    """Univariate predicates from synthetic rows: values seen once, the column
    minimum (<=) and maximum (>=), and IS NULL when exactly one value is null.
    The first ``n_attacks`` in md5 order are kept."""
    cols = _cols(syn, cols)
    long = to_long(syn, cols)
    once = (long.filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") == 1).select("column", F.lit("eq").alias("op"), "v"))
    ext = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                     F.sum(F.col("v").isNull().cast("int")).alias("nulls"))
    bounds = ext.select("column", F.expr("stack(2, 'le', lo, 'ge', hi) as (op, v)")).filter(F.col("v").isNotNull())
    nulls = ext.filter(F.col("nulls") == 1).select("column", F.lit("null").alias("op"),
                                                    F.lit(None).cast("double").alias("v"))
    preds = once.unionByName(bounds).unionByName(nulls).withColumn("key", _attack_key())
    return preds.orderBy("key", "column", "op", "v").limit(n_attacks)  # n_attacks is small: TakeOrdered


def _attack_success(attacks: DataFrame, target: DataFrame, cols) -> DataFrame:
    long = to_long(target, cols)
    eq = attacks.filter(F.col("op") == "eq")
    # Only values some attack names are counted: a broadcast semi join (at most
    # n_attacks keys) in front of the count, not a count of every distinct value.
    hits = long.join(F.broadcast(eq.select("column", "v")), ["column", "v"], "left_semi")
    counts = hits.groupBy("column", "v").agg(F.count(F.lit(1)).alias("m"))
    eq_m = eq.join(counts, ["column", "v"], "left").select("key", F.coalesce("m", F.lit(0)).alias("m"))
    th = (attacks.filter(F.col("op") != "eq").groupBy("column")
          .agg(F.max(F.when(F.col("op") == "le", F.col("v"))).alias("le_t"),
               F.max(F.when(F.col("op") == "ge", F.col("v"))).alias("ge_t")))
    per_col = (long.join(F.broadcast(th), "column")  # at most one row per column
               .groupBy("column").agg(F.sum((F.col("v") <= F.col("le_t")).cast("int")).alias("m_le"),
                                      F.sum((F.col("v") >= F.col("ge_t")).cast("int")).alias("m_ge"),
                                      F.sum(F.col("v").isNull().cast("int")).alias("m_null")))
    other = (attacks.filter(F.col("op") != "eq").join(per_col, "column", "left")
             .select("key", F.coalesce(F.when(F.col("op") == "le", F.col("m_le"))
                                       .when(F.col("op") == "ge", F.col("m_ge"))
                                       .otherwise(F.col("m_null")), F.lit(0)).alias("m")))
    return eq_m.unionByName(other)


def _wilson(s, n):
    z2 = WILSON_Z * WILSON_Z
    return F.when(n == 0, F.lit(0.0)).otherwise((s + F.lit(z2 / 2)) / (n + F.lit(z2)))


def singling_out(real: DataFrame, syn: DataFrame, cols=None, n_attacks: int = N_ATTACKS,
                 control: DataFrame | None = None) -> DataFrame:
    """M5: share of attacks that single out exactly one real row (Wilson
    centre); with ``control`` the risk is relative to the control rows."""
    cols = _cols(real, cols)
    attacks = singling_out_attacks(syn, cols, n_attacks)
    res = _attack_success(attacks, real, cols).agg(
        F.count(F.lit(1)).alias("n_attacks"), F.coalesce(F.sum((F.col("m") == 1).cast("long")), F.lit(0)).alias("n_success"))
    res = res.withColumn("risk", _wilson(F.col("n_success").cast("double"), F.col("n_attacks").cast("double")))
    if control is None:
        return res.select(F.col("risk").alias("singling_out"), "n_attacks", "n_success")
    ctl = _attack_success(attacks, control, cols).agg(
        F.count(F.lit(1)).alias("nc"), F.coalesce(F.sum((F.col("m") == 1).cast("long")), F.lit(0)).alias("sc"))
    rc = _wilson(F.col("sc").cast("double"), F.col("nc").cast("double"))
    both = side_by_side(res, ctl.select(rc.alias("rc")))
    rel = F.when(F.col("rc") >= 1, F.lit(0.0)).otherwise((F.col("risk") - F.col("rc")) / (F.lit(1.0) - F.col("rc")))
    return both.select(F.least(F.greatest(rel, F.lit(0.0)), F.lit(1.0)).alias("singling_out"),
                       "n_attacks", "n_success")


# --- M6 --------------------------------------------------------------------------

def kl_per_column(freqs: DataFrame, by=()) -> DataFrame:
    """KL(p || q) per column with p, q renormalised to sum 1:
    sum(pr ln(pr/ps)) / Sr + ln(Ss / Sr)."""
    return freqs.groupBy(*by, "column").agg(
        (F.sum(F.col("p_real") * F.log(F.col("p_real") / F.col("p_syn"))) / F.sum("p_real")
         + F.log(F.sum("p_syn") / F.sum("p_real"))).alias("kl"))


def inverse_kl(real: DataFrame, syn: DataFrame, cols=None, freqs: DataFrame | None = None, by=()) -> DataFrame:
    """M6: mean over columns of 1 / (1 + KL(real || synthetic))."""
    f = freqs if freqs is not None else column_frequencies(real, syn, _cols(real, cols), by=by)
    return kl_per_column(f, by).groupBy(*by).agg(F.avg(F.lit(1.0) / (F.lit(1.0) + F.col("kl"))).alias("inverse_kl"))


# --- M7 --------------------------------------------------------------------------

def detection_auc(real: DataFrame, syn: DataFrame, cols=None, seed: int = 11, holdout: float = 0.3) -> DataFrame:
    """M7: AUC of a classifier telling real (1) from synthetic (0) rows on a hash hold-out."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    cols = _cols(real, cols)
    both = (real.select("row_id", *cols).withColumn("label", F.lit(1.0)).withColumn("_s", F.lit("r"))
            .unionByName(syn.select("row_id", *cols).withColumn("label", F.lit(0.0)).withColumn("_s", F.lit("s"))))
    both = both.withColumn("_u", draw(seed, F.col("_s"), F.col("row_id")))
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
    data = va.transform(both)
    train, test = data.filter(F.col("_u") >= holdout), data.filter(F.col("_u") < holdout)
    model = GBTClassifier(seed=seed, maxIter=20, maxDepth=4).fit(train)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(model.transform(test))
    return real.sparkSession.createDataFrame([(float(auc),)], "detection_auc double")


# --- M8 / M9 ---------------------------------------------------------------------

def composite(results: DataFrame, weights: DataFrame, registry: DataFrame, by=()) -> DataFrame:
    """M9: per kind (privacy / utility), sum of normalised metric x weight.

    ``results``: (metric, value, *by); ``weights``: (kind, slot, metric, weight);
    ``registry``: (metric, kind, lo, hi, direction, ...). Slots naming no
    metric are ignored; weights are not rescaled.
    """
    reg = registry.select("metric", "lo", "hi", "direction")
    w = weights.filter(F.col("metric").isNotNull() & (F.col("metric") != "none"))
    j = results.join(F.broadcast(reg), "metric").join(F.broadcast(w), "metric")
    n = normalize(F.col("value"), F.col("lo"), F.col("hi"), F.col("direction"))
    return j.groupBy("kind", *by).agg(F.sum(n * F.col("weight")).alias("score"))


def normalized(results: DataFrame, registry: DataFrame) -> DataFrame:
    """M8 applied to a results table: (metric, value, normalized)."""
    reg = registry.select("metric", "lo", "hi", "direction")
    return results.join(F.broadcast(reg), "metric").withColumn(
        "normalized", normalize(F.col("value"), F.col("lo"), F.col("hi"), F.col("direction")))


def union_all(dfs):
    return reduce(DataFrame.unionByName, dfs)


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Put one-row results next to each other without a join: union them with
    the other columns null, then take each column's non-null value."""
    cols = [c for df in one_row for c in df.columns]
    types = {f.name: f.dataType for df in one_row for f in df.schema.fields}
    parts = [df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in cols])
             for df in one_row]
    return reduce(DataFrame.unionByName, parts).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
