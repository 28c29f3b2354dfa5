"""Protection levels, evaluation, request serving and epsilon search
(A7, R8-R14, S5 on tables).

"Tag, don't loop": sizes, repeats, attempts, candidate epsilons and levels are
columns. Many synthetic tables are generated in one plan from tagged row ids,
and each metric scores all of them in one grouped job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.functions.draws import draw
from mirage.functions.ordering import dealt
from mirage.operators import synth as Y
from mirage.operators.frequencies import feature_columns
from mirage.plans import registry as REG
from mirage.plans.requirements import LEVEL_SCHEMA, evaluate_request, find_levels, first_satisfying, validate_request

SIZES = (1000, 10000)
REPEATS = 5
ATTEMPTS = 10
LEVEL_TRIES = 5


def tagged_ids(spark: SparkSession, sizes, attempts, id_col: str = "row_id") -> DataFrame:
    """Row ids for every (size, attempt): ``spark.range(max size)`` exploded over
    the tags, cut at each size. ``_att`` is the draw tag of the table."""
    sizes, attempts = sorted(set(int(s) for s in sizes)), list(attempts)
    ids = spark.range(max(sizes)).withColumnRenamed("id", id_col)
    ids = ids.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    ids = ids.filter(F.col(id_col) < F.col("size")).withColumn("attempt", F.explode(F.array(*[F.lit(a) for a in attempts])))
    return ids.withColumn("_att", F.concat_ws("_", F.col("size").cast("string"), F.col("attempt").cast("string")))


def generate_tagged(model: DataFrame, sizes, attempts, seed, id_col: str = "row_id") -> DataFrame:
    """One DataFrame holding a synthetic table per (size, attempt). A model of a
    family registered with its own generator (E2) is drawn by that generator."""
    family = model.first()["family"] if "family" in model.columns else None  # a local table
    own = REG.generator_of(family)
    if own is not Y.generate:
        parts = [own(model, int(s), seed, a).withColumns({"size": F.lit(int(s)), "attempt": F.lit(a)})
                 for s in sorted({int(s) for s in sizes}) for a in attempts]  # a few tags
        return reduce(DataFrame.unionByName, parts)
    ids = tagged_ids(model.sparkSession, sizes, attempts, id_col)
    return Y.generate(model, seed=seed, attempt="_att", ids=ids).drop("_att")


def score_tagged(real: DataFrame, syn: DataFrame, metrics, by, cols=None, sensitive=()) -> DataFrame:
    """(*by, metric, value) for every metric over every tagged table."""
    cols = cols or feature_columns(real)
    return reduce(DataFrame.unionByName,
                  [REG.compute_metric_by(m, real, syn, by, cols, sensitive) for m in metrics])


def evaluate_level(real: DataFrame, model: DataFrame, metrics, sizes=SIZES, repeats: int = REPEATS,
                   seed=0, cols=None, sensitive=()) -> DataFrame:
    """Each metric averaged over ``repeats`` fresh draws at every size:
    (metric, size, value)."""
    syn = generate_tagged(model, sizes, range(repeats), seed)
    res = score_tagged(real, syn, metrics, ["size", "attempt"], cols, sensitive)
    return res.groupBy("metric", "size").agg(F.avg("value").alias("value"))


def level_rows(level: str, evaluation: DataFrame, sizes=SIZES, created: int = 0, pos_offset: dict | None = None) -> DataFrame:
    """Turn an evaluation into level rows: value_min = value at the small size,
    value_max = value at the large size (as the reference stores them)."""
    spark = evaluation.sparkSession
    small, large = min(sizes), max(sizes)
    reg = REG.metrics_table(spark).select("metric", "kind")
    order = spark.createDataFrame([(m, i) for i, m in enumerate(REG._METRICS)], "metric string, _o int")
    w = evaluation.groupBy("metric").agg(F.max(F.when(F.col("size") == small, F.col("value"))).alias("value_min"),
                                         F.max(F.when(F.col("size") == large, F.col("value"))).alias("value_max"))
    j = w.join(F.broadcast(reg), "metric").join(F.broadcast(order), "metric")
    from pyspark.sql import Window
    pos = F.row_number().over(Window.partitionBy("kind").orderBy("_o")) - 1  # a level has a handful of metrics
    out = j.withColumn("pos", pos.cast("int"))
    if pos_offset:
        off = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in pos_offset.items()], F.lit(0))
        out = out.withColumn("pos", (F.col("pos") + off).cast("int"))
    return out.select(F.lit(level).alias("level"), "kind", "pos", "metric", "value_min", "value_max",
                      F.lit(created).cast("long").alias("created"))


def create_level(spark: SparkSession, name: str, privacy=(), utility=(), created: int = 0) -> DataFrame:
    """A level from lists of (metric, (small-size value, large-size value))."""
    rows = [(name, "privacy", i, m, float(v[0]), float(v[1]), created) for i, (m, v) in enumerate(privacy)]
    rows += [(name, "utility", i, m, float(v[0]), float(v[1]), created) for i, (m, v) in enumerate(utility)]
    return spark.createDataFrame(rows, LEVEL_SCHEMA)


def show_levels(levels: DataFrame) -> DataFrame:
    """One text line per level, entries in (kind, pos) order."""
    entry = F.format_string("%s %s %.6f %.6f", F.col("kind"), F.col("metric"), F.col("value_min"), F.col("value_max"))
    agg = F.sort_array(F.collect_list(F.struct(F.col("kind"), F.col("pos"), entry.alias("t"))))  # entries of one level
    return (levels.groupBy("level").agg(agg.alias("e"))
            .select("level", F.concat_ws("; ", F.col("e.t")).alias("description")))


def add_generator(real: DataFrame, levels: DataFrame, store, level: str, family: str = "dp",
                  metrics=("nearestneighbordistance", "identifiabilityscore", "inversekldivergence"),
                  sizes=SIZES, repeats: int = REPEATS, seed=0, model: DataFrame | None = None,
                  cols=None, **fit_kw) -> DataFrame:
    """Refuse a known level, fit (unless a model is given), evaluate at both
    sizes, store the model and return the new level rows."""
    if levels.filter(F.col("level") == level).limit(1).count():
        raise ValueError(f"protection level {level!r} exists already")
    if model is None:
        fit, _ = REG.synthesizer(family)
        model = fit(real.select(*(["row_id"] + list(cols or feature_columns(real)))), seed=seed, **fit_kw)
    ev = evaluate_level(real, model, metrics, sizes, repeats, seed, cols)
    created = levels.agg(F.coalesce(F.max("created") + 1, F.lit(0))).first()[0]
    rows = level_rows(level, ev, sizes, created)
    if store is not None:
        store.save_model(model, family, level)
        store.append_levels(rows)
    return rows


def level_meets(real: DataFrame, model: DataFrame, requests: DataFrame, size: int = 5500,
                tries: int = LEVEL_TRIES, seed=0, cols=None) -> DataFrame:
    """Per request, does any of ``tries`` fresh draws of ``size`` rows
    satisfy it? (request_id, ok)."""
    syn = generate_tagged(model, [size], range(tries), seed)
    names = [r[0] for r in requests.select(F.explode(F.array("privacy_metric", "utility_metric"))).distinct().collect()
             if r[0] is not None]
    res = score_tagged(real, syn, names, ["attempt"], cols)
    tagged = requests.select("request_id", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
    long = tagged.join(F.broadcast(res), "attempt")  # res: tries x metrics rows
    ok = evaluate_request(long, requests, keys=("request_id", "attempt"))
    return ok.groupBy("request_id").agg(F.bool_or("ok").alias("ok"))


def _needed(requests, levels):
    """(valid requests, matches with their size); the matches are written once."""
    from mirage.session import cut_lineage
    valid = validate_request(requests)
    return valid, cut_lineage(find_levels(valid, levels).join(valid.select("request_id", "size"), "request_id"))


def _candidates(real, combos, models, store, attempts, seed, cols) -> DataFrame | None:
    """The candidate tables of (level, size) pairs, written once: scores, counts and
    served rows all read them. None if no level can offer one."""
    from mirage.operators.prep import sample_rows
    from mirage.session import cut_lineage
    cached = {r["level"] for r in store.cached_levels().collect()} if store is not None else set()
    parts = []
    for lv in sorted({lv for lv, _ in combos}):
        sizes = sorted({int(s) for x, s in combos if x == lv})
        if lv in cached:
            cache = store.cache_get(lv)
            n = cache.count()
            # a cache smaller than the request is skipped
            parts += [sample_rows(cache, s, seed, check=False).select(
                "row_id", F.lit(s).alias("size"), F.lit(-1).alias("attempt"), *cols, F.lit(lv).alias("level")) for s in sizes if s <= n]
        elif lv in models:
            g = generate_tagged(models[lv], sizes, range(attempts), seed)
            parts.append(g.select("row_id", "size", "attempt", *cols, F.lit(lv).alias("level")))
    return cut_lineage(reduce(DataFrame.unionByName, parts)) if parts else None


def _serve_candidates(real, requests, levels, models, store, attempts, seed, cols):
    """(valid requests, matches with their size, candidate tables)."""
    valid, need = _needed(requests, levels)
    combos = [(r["level"], r["size"]) for r in need.select("level", "size").distinct().collect()]  # levels x distinct sizes
    return valid, need, _candidates(real, combos, models, store, attempts, seed, cols)


def _metric_names(valid) -> list:
    return [r[0] for r in valid.select(F.explode(F.array("privacy_metric", "utility_metric"))).distinct().collect()
            if r[0] is not None]


def _serve_choice(real, valid, need, cands, levels, cols):
    """(request_id, level, attempt, status): the first satisfying candidate per
    request, the others pending or rejected."""
    res = None if cands is None else score_tagged(real, cands, _metric_names(valid), ["level", "size", "attempt"], cols)
    return _choose(valid, need, res, levels)


def _choose(valid, need, res, levels):
    """The choice by scores (level, size, attempt, metric, value)."""
    pending_all = valid.select("request_id", F.lit(None).cast("string").alias("level"),
                               F.lit(None).cast("int").alias("attempt"),
                               F.when(F.col("status") == "valid", F.lit("pending")).otherwise(F.lit("rejected")).alias("status"))
    if res is None:
        return pending_all
    order = levels.groupBy("level").agg(F.min("created").alias("level_pos"))
    per_req = dealt(need, "request_id").join(F.broadcast(res), ["level", "size"]).join(F.broadcast(order), "level")  # levels x sizes x attempts x metrics rows
    ok = evaluate_request(per_req, valid, keys=("request_id", "level", "level_pos", "attempt"))
    chosen = first_satisfying(ok).select("request_id", "level", "attempt", F.lit("served").alias("status"))
    rest = pending_all.join(chosen.select("request_id"), "request_id", "left_anti")
    return chosen.unionByName(rest)


SCORE_SCHEMA = "level string, created long, size int, attempt int, metric string, value double"


def serve_known(real: DataFrame, requests: DataFrame, levels: DataFrame, models: dict, known: DataFrame, store=None,
                attempts: int = ATTEMPTS, seed=0, cols=None) -> tuple[DataFrame, DataFrame | None]:
    """R11 for requests that come in batches: (result as of ``serve``, new scores).
    ``known`` (``SCORE_SCHEMA``) holds the scores of earlier batches; only (level,
    size, metric) without one are drawn and scored. A level that was removed and
    made again has another ``created`` and is scored anew; so is one that got cached
    rows (attempt -1)."""
    from mirage.session import cut_lineage
    spark, cols = real.sparkSession, cols or feature_columns(real)
    valid, need = _needed(requests, levels)
    names = _metric_names(valid)
    born = levels.groupBy("level").agg(F.min("created").alias("created"))
    cached = [r["level"] for r in store.cached_levels().collect()] if store is not None else []
    offered = F.when(F.col("level").isin(cached), F.col("attempt") < 0).otherwise(F.col("attempt") >= 0) if cached else F.col("attempt") >= 0
    usable = known.join(born, ["level", "created"]).filter(offered)
    keys = ["level", "size", "metric"]
    wanted = need.select("level", F.col("size").cast("int").alias("size")).distinct().withColumn(
        "metric", F.explode(F.array(*[F.lit(n) for n in names]))) if names else None
    missing = wanted.join(usable.select(*keys).distinct(), keys, "left_anti").collect() if names else []  # levels x sizes x metrics
    cands = _candidates(real, {(r["level"], r["size"]) for r in missing}, models, store, attempts, seed, cols) if missing else None
    new = None
    if cands is not None:
        lacking = spark.createDataFrame([(r["level"], r["size"], r["metric"]) for r in missing], "level string, size int, metric string")
        res = score_tagged(real, cands, sorted({r["metric"] for r in missing}), ["level", "size", "attempt"], cols)
        new = cut_lineage(res.withColumn("size", F.col("size").cast("int")).join(F.broadcast(lacking), keys, "left_semi").join(F.broadcast(born), "level")
                          .select("level", F.col("created").cast("long").alias("created"), "size", F.col("attempt").cast("int").alias("attempt"), "metric", "value"))
    scores = usable.select("level", "size", "attempt", "metric", "value")
    if new is not None:
        scores = scores.unionByName(new.drop("created"))
    return _choose(valid, need, scores, levels), new


def serve(real: DataFrame, requests: DataFrame, levels: DataFrame, models: dict, store=None,
          attempts: int = ATTEMPTS, seed=0, cols=None) -> DataFrame:
    """Match requests to levels (J6); a level with cached rows offers a
    sample of them (its generator is not tried), otherwise up to ``attempts``
    fresh draws; every candidate table is scored once per (level, size, attempt)
    however many requests share it; the first satisfying candidate in level,
    then attempt order serves the request (W6). Unserved requests are
    ``pending``. Returns (request_id, level, attempt, status)."""
    cols = cols or feature_columns(real)
    valid, need, cands = _serve_candidates(real, requests, levels, models, store, attempts, seed, cols)
    return _serve_choice(real, valid, need, cands, levels, cols)


def serve_rows(real: DataFrame, requests: DataFrame, levels: DataFrame, models: dict, store=None,
               attempts: int = ATTEMPTS, seed=0, cols=None, encoding=None) -> DataFrame:
    """R11 with the data: the rows of the winning table of every served request
    (request_id, level, attempt, row_id, features), decoded by ``encoding``. The
    largest winning draw of a level (its first attempt) is cached in ``store``."""
    from mirage.session import cut_lineage
    from mirage.sources.io import deliver
    cols = list(cols or feature_columns(real))
    valid, need, cands = _serve_candidates(real, requests, levels, models, store, attempts, seed, cols)
    chosen = cut_lineage(_serve_choice(real, valid, need, cands, levels, cols).filter("status = 'served'").drop("status")
                         .join(need, ["request_id", "level"]))
    if cands is None:
        return deliver(real.limit(0).select(F.lit(0).alias("request_id"), F.lit("").alias("level"), F.lit(0).alias("attempt"),
                                            "row_id", *cols), encoding)
    if store is not None:
        drawn = chosen.filter("attempt >= 0").groupBy("level").agg(
            F.min(F.struct((-F.col("size")).alias("s"), "attempt")).alias("w")).select("level", (-F.col("w.s")).alias("size"), "w.attempt")
        for r in drawn.collect():  # one row per level
            win = (F.col("level") == r["level"]) & (F.col("size") == r["size"]) & (F.col("attempt") == r["attempt"])
            store.cache_put(r["level"], cands.filter(win).select("row_id", *cols))
    rows = chosen.join(cands, ["level", "size", "attempt"]).select("request_id", "level", "attempt", "row_id", *cols)
    return deliver(rows, encoding)


def epsilon_sweep(real: DataFrame, epsilons, size: int = 1000, seed=0, cols=None,
                  metrics=("nearestneighbordistance", "inversekldivergence"), n_bins: int = Y.N_BINS) -> DataFrame:
    """R8 sweep form: counts once, noise for every candidate epsilon (an exploded
    column, not a join), one synthetic table per candidate, all scored in one
    grouped job. Returns (epsilon, metric, value). ``epsilons`` may also be pairs
    (epsilon, seed), each drawn with its own seed; then (epsilon, seed, metric, value)."""
    from mirage.session import cut_lineage
    cols = list(cols or feature_columns(real))
    paired = bool(epsilons) and isinstance(epsilons[0], tuple)
    pairs = list(epsilons) if paired else [(e, seed) for e in epsilons]
    base = Y.dp_fit(real.select("row_id", *cols), None, 0, cols, n_bins=n_bins)
    one = F.explode(F.array(*[F.struct(F.lit(float(e)).alias("epsilon"), F.lit(s).cast("long").alias("seed")) for e, s in pairs]))
    tags = ["epsilon", "seed"]
    # A working table inside the search: fitted without noise, never stored.
    cand = base.withColumnRenamed("noisy", "exact").withColumn("_c", one).select("*", "_c.*").drop("_c")
    key = F.concat_ws("|", F.col("column"), F.col("bin").cast("string"))
    scale = F.lit(float(len(cols))) / F.col("epsilon")
    cand = cand.withColumn("noisy", Y.noise("laplace", F.col("exact"), scale, F.col("seed"), key))
    cand = Y._finish(cand, group=(*tags, "column"))
    ids = real.sparkSession.range(size).withColumnRenamed("id", "row_id").withColumn("_c", one).select("row_id", "_c.*")
    long = ids.select("row_id", *tags, F.explode(F.array(*[F.lit(c) for c in cols])).alias("column"))
    tag = F.concat_ws("|", F.col("column"), F.col("epsilon").cast("string"))
    long = long.withColumn("_u", draw(F.col("seed"), tag, F.col("row_id"))).withColumn(
        "_w", draw(F.col("seed"), F.concat_ws("|", tag, F.lit("in")), F.col("row_id")))
    picked = Y.interval_lookup(long, cand, [*tags, "column"], "_u", "cum_lo", "cum_hi")
    val = F.when(F.col("kind") != "hist", F.col("bin_lo")).otherwise(F.col("bin_lo") + F.col("_w") * (F.col("bin_hi") - F.col("bin_lo")))
    val = F.when(F.col("integral") & (F.col("kind") == "hist"), F.floor(val).cast("double")).otherwise(val)
    wide = picked.withColumn("_val", val).groupBy(*tags, "row_id").pivot("column", cols).agg(F.first("_val"))
    wide = cut_lineage(wide)  # every metric reads it
    return score_tagged(real, wide if paired else wide.drop("seed"), list(metrics), tags if paired else ["epsilon"], cols)


def add_metric(real: DataFrame, levels: DataFrame, models: dict, name: str, sizes=SIZES,
               repeats: int = REPEATS, seed=0, cols=None, store=None) -> DataFrame:
    """Score every level on a new metric at both sizes and return the
    appended level rows (a cached level is scored on its cached table)."""
    kind = REG.metric(name).kind
    cached = {r["level"] for r in store.cached_levels().collect()} if store is not None else set()
    rows = []
    pos = {r["level"]: r["p"] for r in levels.filter(F.col("kind") == kind).groupBy("level")
           .agg(F.max("pos").alias("p")).collect()}
    created = {r["level"]: r["c"] for r in levels.groupBy("level").agg(F.min("created").alias("c")).collect()}
    for lv in sorted(created):
        if lv in cached:
            syn = store.cache_get(lv)
            v = REG.compute_metric(name, real, syn, cols).first()["value"]
            ev = real.sparkSession.createDataFrame([(name, s, float(v)) for s in sizes], "metric string, size int, value double")
        elif lv in models:
            ev = evaluate_level(real, models[lv], [name], sizes, repeats, seed, cols)
        else:
            continue
        r = level_rows(lv, ev, sizes, created[lv], {kind: (pos.get(lv, -1) + 1)})
        rows.append(r)
    if not rows:
        return real.sparkSession.createDataFrame([], LEVEL_SCHEMA)
    return reduce(DataFrame.unionByName, rows)
