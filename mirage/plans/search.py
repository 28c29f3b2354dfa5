"""Preparing levels for requests nothing served.

``search_epsilons``: every wanted level is a row with its bracket, seed, restart count
and how close it came. One sweep a round draws and scores the candidates of all open
rows together; the next state is one plan over the rows. ``prepare`` merges (G7) from the closest generator, searches an
epsilon for what merging can't meet, and publishes what it found as levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.operators import synth as Y
from mirage.operators.frequencies import feature_columns
from mirage.operators.tournament import Requirement, Scorer, merge_tables
from mirage.plans import levels as L
from mirage.plans import registry as REG
from mirage.plans.requirements import closest_generator, epsilon_direction, level_exists, next_epsilon
from mirage.session import cut_lineage

LOW, HIGH, RESTARTS = 0.1, 10.0, 3  # bracket of epsilon, new starts after a dead end
GRID = 5  # candidates a row adds to a round
ROUNDS = 40  # safety bound; brackets close long before
MERGE_SIZE = 5500  # rows of a merged table: between the two validation sizes
MERGE_ROUNDS = 3
WANTED = ["level", "privacy_metric", "privacy_value", "utility_metric", "utility_value", "tol"]
_STATE = ("low double, high double, guess double, seed long, restarts int, rounds int, gap double, epsilon double, p_val double, u_val double, "
          "status string")


def _tenth(x):
    return F.floor(x * 10.0 + 0.5) / 10.0


def search_epsilons(real: DataFrame, wanted: DataFrame, size: int = 1000, seed=0, cols=None, restarts: int = RESTARTS,
                    rounds: int = ROUNDS) -> DataFrame:
    """R8 for all wanted levels at once. ``wanted``: one row per level (WANTED).

    Every open row asks for a few epsilons of its bracket, equally spaced in ratio,
    and the one R6 proposes; one sweep scores all. A row ends as ``done`` if a
    candidate meets its requirements two-sided (R1). Else its closest candidate
    decides by R7 on which side the bracket goes on. Requirements that pull apart, a
    round that comes no closer and a closed bracket start the row anew with another
    seed, ``restarts`` times at most; then it is ``failed``. Returns (level, epsilon,
    seed, p_val, u_val, rounds, restarts, status)."""
    cols = list(cols or feature_columns(real))
    reg = {r["metric"]: r for r in REG.metrics_table(real.sparkSession).collect()}  # a few registered metrics
    fields = [f.split() for f in _STATE.split(", ")]
    begin = {"low": F.lit(LOW), "high": F.lit(HIGH), "seed": F.lit(seed), "restarts": F.lit(0), "rounds": F.lit(0), "status": F.lit("open")}
    state = wanted.select(*WANTED, *[begin.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])
    state = cut_lineage(state)
    names = sorted({r[0] for r in wanted.select(F.explode(F.array("privacy_metric", "utility_metric"))).distinct().collect()} - {None})
    p, u = F.col("privacy_metric"), F.col("utility_metric")

    def per_metric(metric, what):
        return F.coalesce(*[F.when(metric == n, what(i, n)) for i, n in enumerate(names)])

    for _ in range(rounds):
        grid = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: _tenth(F.col("low") * F.pow(F.col("high") / F.col("low"), i / (GRID - 1))))
        asked = F.array_distinct(F.filter(F.concat(grid, F.array("guess")), lambda x: x.isNotNull() & x.between(F.col("low"), F.col("high"))))
        asking = state.filter("status = 'open'").withColumn("asked", asked)
        tried = asking.select("*", F.explode("asked").alias("e"))
        pairs = [(r["e"], r["seed"]) for r in tried.select("e", "seed").distinct().collect()]  # open rows x a few
        if not pairs:
            break
        res = L.epsilon_sweep(real, pairs, size, None, cols, names)
        wide = res.groupBy(F.col("epsilon").alias("_e"), F.col("seed").alias("_s")).agg(
            *[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(f"v_{i}") for i, n in enumerate(names)])
        t = tried.drop("epsilon", "p_val", "u_val").join(wide, (F.col("e") == F.col("_e")) & (F.col("seed") == F.col("_s")))
        t = t.withColumns({"p_val": per_metric(p, lambda i, n: F.col(f"v_{i}")), "u_val": per_metric(u, lambda i, n: F.col(f"v_{i}")),
                           "p_req": F.col("privacy_value"), "u_req": F.col("utility_value"), "epsilon": F.col("e")})
        t = t.withColumns({f"{s}_{k}": per_metric(c, lambda i, n, f=f: F.lit(float(reg[n][f])))
                           for s, c in (("p", p), ("u", u)) for k, f in (("lo", "lo"), ("hi", "hi"), ("dir", "direction"))})
        t = epsilon_direction(t)
        off = F.coalesce(F.abs(F.col("p_val") - F.col("p_req")), F.lit(0.0)) + F.coalesce(F.abs(F.col("u_val") - F.col("u_req")), F.lit(0.0))
        own = F.struct("epsilon", "p_val", "u_val", "move", "step", off.alias("off"))
        best = t.groupBy("level").agg(F.min_by(own, F.struct(F.col("move") != "done", off, "epsilon")).alias("b"))
        t = asking.drop("epsilon", "p_val", "u_val").join(best, "level").select("*", "b.*")
        below = F.array_max(F.filter("asked", lambda x: x < F.col("epsilon")))
        above = F.array_min(F.filter("asked", lambda x: x > F.col("epsilon")))
        t = t.withColumns({"to_low": F.when(F.col("move") == "down", F.coalesce(below, F.col("low"))).otherwise(F.col("epsilon")),
                           "to_high": F.when(F.col("move") == "down", F.col("epsilon")).otherwise(F.coalesce(above, F.col("high"))),
                           "direction": F.col("move"), "amount": F.least(F.col("step"), F.lit(1.0))})
        guess = next_epsilon(t.select("level", "epsilon", F.col("to_low").alias("low"), F.col("to_high").alias("high"), "amount", "direction"))
        t = t.join(guess.select("level", F.col("new_epsilon").alias("_guess")), "level")
        closer = F.col("gap").isNull() | (F.col("off") < F.col("gap"))
        inside = F.col("move").isin("up", "down") & closer & (F.col("to_high") - F.col("to_low") > 0.15)
        again = F.col("restarts") + 1
        step = F.when(F.col("move") == "done", F.lit("done")).when(inside, F.lit("on")).when(again <= restarts, F.lit("again")).otherwise(F.lit("failed"))
        t = t.withColumn("_step", step)

        def by_step(on, anew, same):
            return F.when(F.col("_step") == "on", on).when(F.col("_step") == "again", anew).otherwise(same)

        null = F.lit(None)
        after = {"low": by_step(F.col("to_low"), F.lit(LOW), F.col("low")), "high": by_step(F.col("to_high"), F.lit(HIGH), F.col("high")),
                 "guess": by_step(F.col("_guess"), null, null), "seed": by_step(F.col("seed"), F.col("seed") + 1, F.col("seed")),
                 "restarts": by_step(F.col("restarts"), again, F.col("restarts")), "rounds": F.col("rounds") + 1,
                 "gap": by_step(F.col("off"), null, F.col("off")),
                 "status": F.when(F.col("_step").isin("done", "failed"), F.col("_step")).otherwise(F.lit("open"))}
        after = t.select(*WANTED, *[after.get(n, F.col(n)).cast(ty).alias(n) for n, ty in fields])
        state = cut_lineage(after.unionByName(state.filter("status <> 'open'")))
    return state.select("level", "epsilon", "seed", "p_val", "u_val", "rounds", "restarts",
                        F.when(F.col("status") == "open", F.lit("failed")).otherwise(F.col("status")).alias("status"))


def closest_models(real: DataFrame, models: dict, wanted: DataFrame, size: int, seed, cols) -> tuple[DataFrame, DataFrame]:
    """(level wanted, closest model) for every wanted level (W5), and the models'
    tables of ``size`` rows: all drawn into one table, scored in one grouped job."""
    drawn = cut_lineage(reduce(DataFrame.unionByName, [
        Y.generate(m, size, seed).select("row_id", *cols).withColumn("model", F.lit(n)) for n, m in sorted(models.items())]))
    names = sorted({r[0] for r in wanted.select(F.explode(F.array("privacy_metric", "utility_metric"))).distinct().collect()} - {None})
    res = cut_lineage(L.score_tagged(real, drawn, names, ["model"], cols))
    pos = {n: i for i, n in enumerate(sorted(models))}
    order = F.coalesce(*[F.when(F.col("model") == n, F.lit(i)) for n, i in pos.items()])
    pick = wanted.select(*WANTED).join(F.broadcast(res), F.col("metric").isin(F.col("privacy_metric"), F.col("utility_metric"))  # models x metrics rows
                                       ).groupBy("level", "model", "privacy_value", "utility_value").agg(
        F.max(F.when(F.col("metric") == F.col("privacy_metric"), F.col("value"))).alias("privacy"),
        F.max(F.when(F.col("metric") == F.col("utility_metric"), F.col("value"))).alias("utility"))
    scores = pick.select(F.col("level").alias("wanted"), F.col("model").alias("level"), order.alias("pos"), "privacy", "utility",
                         F.col("privacy_value").alias("p_req"), F.col("utility_value").alias("u_req"))
    best = closest_generator(scores, by=("wanted",)).select(F.col("wanted").alias("level"), F.col("level").alias("model"))
    return best, drawn


def prepare(real: DataFrame, pending: DataFrame, levels: DataFrame, models: dict, store=None, size: int = MERGE_SIZE, seed=0, cols=None,
            metrics=("nearestneighbordistance", "inversekldivergence"), sizes=L.SIZES, repeats: int = L.REPEATS, rounds: int = MERGE_ROUNDS,
            technique: str = "merge", search_size: int = 1000) -> DataFrame:
    """Unserved requests name the level they want; each new name is prepared
    once (J8: known names are skipped) from its earliest request. First merging (G7)
    from the closest model; the merged table becomes the level's rows, its scores the
    level's values at both sizes. Then one epsilon search for all other names; a
    generator found is evaluated (A7) and stored. A level is published whole or not
    at all (``Store.publish``). Returns (request_id, level, outcome): merged,
    searched, manual or exists."""
    spark = real.sparkSession
    cols = list(cols or feature_columns(real))
    pending = cut_lineage(pending)  # read several times below, and often the end of a whole serve
    known = level_exists(pending, levels).filter(F.col("exists")).select("request_id")
    new = pending.join(known, "request_id", "left_anti")
    first = new.groupBy("level").agg(F.min_by(F.struct(*[c for c in WANTED if c != "level"]), F.col("request_id")).alias("r")).select("level", "r.*")
    first = cut_lineage(first)
    outcome: dict[str, str] = {}
    scorer = Scorer(real, cols)
    created = levels.agg(F.coalesce(F.max("created") + 1, F.lit(0))).first()[0]
    if models and not first.isEmpty():
        best, drawn = closest_models(scorer.real, models, first, size, seed, cols)
        closest = {r["level"]: r["model"] for r in best.collect()}  # one row per new name
        donors = [(lambda a, m=m: Y.generate(m, size, seed, attempt=a)) for _, m in sorted(models.items())]
        for r in first.orderBy("level").collect():  # one row per new name
            need = [Requirement(r[f"{k}_metric"], r[f"{k}_value"], r["tol"]) if r[f"{k}_metric"] else None for k in ("privacy", "utility")]
            start = drawn.filter(F.col("model") == closest[r["level"]]).drop("model")
            merged, _ = merge_tables(start, donors, scorer, size, *need, technique, seed, rounds)
            if merged is None:
                continue
            outcome[r["level"]] = "merged"
            if store is not None:
                ev = L.score_tagged(scorer.real, merged.withColumn("size", F.lit(int(size))), metrics, ["size"], cols).select("metric", "size", "value")
                rows = L.level_rows(r["level"], ev, [size], created)
                store.publish(r["level"], rows, cache=merged, report=ev)
                created += 1
    rest = first.filter(~F.col("level").isin(list(outcome))) if outcome else first
    found = search_epsilons(scorer.real, rest, search_size, seed, cols).filter("status = 'done'").orderBy("level").collect()  # new names
    for r in found:
        outcome[r["level"]] = "searched"
        if store is not None:
            model = Y.dp_fit(real.select("row_id", *cols), r["epsilon"], r["seed"], cols)
            ev = cut_lineage(L.evaluate_level(scorer.real, model, metrics, sizes, repeats, seed, cols))
            store.publish(r["level"], L.level_rows(r["level"], ev, sizes, created), model=model, family="dp", report=ev)
            created += 1
    result = spark.createDataFrame(list(outcome.items()), "level string, outcome string")
    done = new.select("request_id", "level").join(F.broadcast(result), "level", "left").select(  # one row per new name
        "request_id", "level", F.coalesce("outcome", F.lit("manual")).alias("outcome"))
    return done.unionByName(pending.join(known, "request_id", "left_semi").select("request_id", "level", F.lit("exists").alias("outcome")))
