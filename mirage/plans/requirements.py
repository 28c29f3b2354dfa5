"""Requirement logic on tables.

``levels``: (level, kind, pos, metric, value_min, value_max[, created]) - one
row per metric entry of a protection level; ``pos`` is the entry's position.
``requests``: (request_id, level, size, privacy_metric, privacy_value,
utility_metric, utility_value, tol) with nullable sides.

Every function judges whole tables of requests / candidates in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirage.functions.expr import amount as amount_expr
from mirage.functions.expr import at_least
from mirage.functions.ordering import dealt

LEVEL_SCHEMA = ("level string, kind string, pos int, metric string, value_min double, "
                "value_max double, created long")
REQUEST_SCHEMA = ("request_id long, level string, size int, privacy_metric string, privacy_value double, "
                  "utility_metric string, utility_value double, tol double")
# Levels are a repository of generators (tens to thousands of rows): broadcast
# them into request joins when their entry count is under this bound.
LEVELS_BROADCAST_ROWS = 1_000_000


def _small(df: DataFrame, bound: int = LEVELS_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def first_entries(levels: DataFrame) -> DataFrame:
    """Per (level, kind, metric) the entry with the lowest ``pos`` (the first
    entry with that name decides)."""
    best = F.min_by(F.struct("value_min", "value_max", "pos"), F.col("pos"))
    out = levels.groupBy("level", "kind", "metric").agg(best.alias("e"),
                                                         F.min(F.coalesce(F.col("created"), F.lit(0))).alias("created")
                                                         if "created" in levels.columns else F.lit(0).alias("created"))
    return out.select("level", "kind", "metric", "e.value_min", "e.value_max", "e.pos", "created")


def validate_request(requests: DataFrame) -> DataFrame:
    """A request must name a privacy and/or a utility requirement."""
    ok = F.col("privacy_metric").isNotNull() | F.col("utility_metric").isNotNull()
    return requests.withColumn("status", F.when(ok, F.lit("valid")).otherwise(F.lit("rejected")))


def find_levels(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """(request_id, level, created) for every level whose first entry of the
    requested metric is within ``tol`` of the required value at the small or the
    large size; both sides must match when both are given. One row per level."""
    fe = _small(first_entries(levels))
    req = dealt(validate_request(requests).filter(F.col("status") == "valid"), "request_id")  # each meets many levels

    def side(kind, mcol, vcol):
        r = req.filter(F.col(mcol).isNotNull()).select("request_id", F.col(mcol).alias("metric"),
                                                        F.col(vcol).alias("v"), "tol")
        e = fe.filter(F.col("kind") == kind)
        m = r.join(e, "metric")
        hit = (F.abs(F.col("v") - F.col("value_min")) <= F.col("tol")) | (F.abs(F.col("v") - F.col("value_max")) <= F.col("tol"))
        return m.filter(hit).select("request_id", "level", "created")

    p = side("privacy", "privacy_metric", "privacy_value")
    u = side("utility", "utility_metric", "utility_value")
    both = req.filter(F.col("privacy_metric").isNotNull() & F.col("utility_metric").isNotNull()).select("request_id")
    only_p = req.filter(F.col("privacy_metric").isNotNull() & F.col("utility_metric").isNull()).select("request_id")
    only_u = req.filter(F.col("privacy_metric").isNull() & F.col("utility_metric").isNotNull()).select("request_id")
    pu = p.join(u.select("request_id", "level"), ["request_id", "level"], "inner").join(both, "request_id", "left_semi")
    return (pu.unionByName(p.join(only_p, "request_id", "left_semi"))
            .unionByName(u.join(only_u, "request_id", "left_semi")))


def level_exists(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Does the requested level name exist already?"""
    names = levels.select("level").distinct()
    hit = requests.join(names, "level", "left_semi").select("request_id", F.lit(True).alias("exists"))
    miss = requests.join(names, "level", "left_anti").select("request_id", F.lit(False).alias("exists"))
    return hit.unionByName(miss)


def remove_level(table: DataFrame, names: DataFrame, col: str = "level") -> DataFrame:
    """J9 (table side): drop every row of the named levels (anti join)."""
    return table.join(names.select(F.col(col)).distinct(), col, "left_anti")


def closest_generator(scores: DataFrame, requirement: DataFrame | None = None, halve_single: bool = False,
                      by=("request_id",)) -> DataFrame:
    """Per request, the generator (level) minimising
    (|privacy - p_req| + |utility - u_req|) / 2, or one side alone; ties by
    position. ``scores``: (level, pos, privacy, utility); ``requirement``:
    (request_id, p_req, u_req) - joined on nothing but the request side keys
    of ``scores`` when given (scores may already carry them)."""
    s = scores if requirement is None else scores.join(requirement, list(set(scores.columns) & set(requirement.columns)) or None)
    dp = F.abs(F.col("privacy") - F.col("p_req"))
    du = F.abs(F.col("utility") - F.col("u_req"))
    single = F.lit(0.5) if halve_single else F.lit(1.0)
    diff = (F.when(F.col("p_req").isNotNull() & F.col("u_req").isNotNull(), (dp + du) / F.lit(2.0))
            .when(F.col("p_req").isNotNull(), dp * single).otherwise(du * single))
    best = F.min_by(F.struct("level", "pos", "diff"), F.struct("diff", "pos"))
    return s.withColumn("diff", diff).groupBy(*by).agg(best.alias("b")).select(*by, "b.level", "b.pos", "b.diff")


def first_satisfying(candidates: DataFrame) -> DataFrame:
    """Per request the first satisfying candidate in level order, then
    attempt order. ``candidates``: (request_id, level, level_pos, attempt, ok)."""
    ok = candidates.filter(F.col("ok"))
    best = F.min_by(F.struct("level", "level_pos", "attempt"), F.struct("level_pos", "attempt"))
    return ok.groupBy("request_id").agg(best.alias("b")).select("request_id", "b.level", "b.level_pos", "b.attempt")


def evaluate_request(results: DataFrame, requests: DataFrame, keys=("request_id",)) -> DataFrame:
    """Judge measured metric values against requests; a missing side counts
    as satisfied. ``results``: (*keys, metric, value) in long form."""
    k = list(keys)
    r = requests.select("request_id", "privacy_metric", "privacy_value", "utility_metric", "utility_value", "tol")
    j = results.join(r, "request_id")
    pv = F.max(F.when(F.col("metric") == F.col("privacy_metric"), F.col("value")))
    uv = F.max(F.when(F.col("metric") == F.col("utility_metric"), F.col("value")))
    g = j.groupBy(*k, "privacy_value", "utility_value", "tol").agg(pv.alias("p"), uv.alias("u"))
    okp = F.col("privacy_value").isNull() | (F.abs(F.col("privacy_value") - F.col("p")) <= F.col("tol"))
    oku = F.col("utility_value").isNull() | (F.abs(F.col("utility_value") - F.col("u")) <= F.col("tol"))
    return g.select(*k, F.coalesce(okp & oku, F.lit(False)).alias("ok"))


def next_epsilon(df: DataFrame, cur="epsilon", low="low", high="high", amount="amount",
                 direction="direction") -> DataFrame:
    """Move epsilon inside its bracket by |amount| of the remaining width,
    rounded to 0.1; no value when the bracket closes."""
    c, lo, hi, a = F.col(cur), F.col(low), F.col(high), F.abs(F.col(amount))
    down = F.col(direction) == "down"
    new_lo = F.when(down, lo).otherwise(c)
    new_hi = F.when(down, c).otherwise(hi)
    tenth = lambda x: F.floor(x * F.lit(10.0) + F.lit(0.5)) / F.lit(10.0)  # noqa: E731 - half up to 0.1
    new = F.when(down, tenth(c - (c - lo) * a)).otherwise(tenth(c + (hi - c) * a))
    return (df.withColumn("new_low", new_lo).withColumn("new_high", new_hi)
            .withColumn("new_epsilon", F.when(new_lo < new_hi, new)))


def epsilon_direction(df: DataFrame) -> DataFrame:
    """Which way epsilon must move.

    Columns: p_req, p_val, p_lo, p_hi, p_dir, u_req, u_val, u_lo, u_hi, u_dir,
    tol (a side with null requirement is absent). Adds ``move`` in
    {down, up, restart, done} and ``step`` = the smaller |amount|.
    """
    has_p, has_u = F.col("p_req").isNotNull(), F.col("u_req").isNotNull()
    p_ok = (F.abs(F.col("p_val") - F.col("p_req")) <= F.col("tol"))
    u_ok = (F.abs(F.col("u_val") - F.col("u_req")) <= F.col("tol"))
    # Short and over compare with the plain value; the tolerance only ends the search.
    def side(s):
        up, val, req = F.col(f"{s}_dir") == 1, F.col(f"{s}_val"), F.col(f"{s}_req")
        return F.when(up, val < req).otherwise(val > req), F.when(up, val > req).otherwise(val < req)
    p_short, p_over = side("p")
    u_short, u_over = side("u")
    ap = F.abs(amount_expr(F.col("p_req"), F.col("p_val"), F.col("p_lo"), F.col("p_hi"), F.col("p_dir")))
    au = F.abs(amount_expr(F.col("u_req"), F.col("u_val"), F.col("u_lo"), F.col("u_hi"), F.col("u_dir")))
    both = has_p & has_u
    move = (F.when(both & p_ok & u_ok, "done")
            .when(both & p_short & u_over, "down")
            .when(both & p_over & u_short, "up")
            .when(both, "restart")
            .when(has_p & p_ok, "done").when(has_p & p_short, "down").when(has_p, "up")
            .when(has_u & u_ok, "done").when(has_u & u_over, "down").when(has_u, "up"))
    step = F.when(both, F.least(ap, au)).when(has_p, ap).otherwise(au)
    return df.withColumn("move", move).withColumn("step", step)
