"""Catalog: requirement logic, levels, evaluation, serving, search, store, stream
(J6, J8, J9, W5, W6, R1-R14, A7, S3-S5, T1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions import expr as X
from mirage.functions.draws import draw, draw_sql
from mirage.functions.ordering import dealt
from mirage.operators import synth as Y
from mirage.plans import levels as L
from mirage.plans import search as S
from mirage.plans import registry as REG
from mirage.plans import requirements as R
from mirage.plans.catalog import (CUST_ENC, FEATS, SEED, T, cust_roles, dsql, kl_sql, nn_sql, query, roles_sql,
                                  rounded, scratch)
from mirage.plans.catalog_synth import dp_sql
from mirage.sources.io import Store, evaluation_report

# --- fixtures: levels from nation, requests from customer ----------------------------


def _levels(spark, d) -> DataFrame:
    n = T(spark, d, "nation")
    nk, rk = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")

    def entry(df, kind, pos, metric, lo, width):
        return df.select(F.col("n_name").alias("level"), F.lit(kind).alias("kind"), F.lit(pos).alias("pos"),
                         F.lit(metric).alias("metric"), lo.alias("value_min"), (lo + F.lit(width)).alias("value_max"),
                         F.col("n_nationkey").cast("long").alias("created"))
    parts = [entry(n, "privacy", 0, "identifiabilityscore", nk / F.lit(50.0), 0.03),
             entry(n, "privacy", 1, "nearestneighbordistance", rk / F.lit(10.0), 0.05),
             entry(n.filter(F.col("n_regionkey") < 2), "privacy", 2, "identifiabilityscore", F.lit(0.9), 0.05),
             entry(n, "utility", 0, "inversekldivergence", F.lit(0.5) + rk / F.lit(10.0), 0.02)]
    return reduce(DataFrame.unionByName, parts)


_LEVELS = """levels AS (
  SELECT n_name AS level, 'privacy' AS kind, 0 AS pos, 'identifiabilityscore' AS metric, CAST(n_nationkey AS DOUBLE) / 50.0::DOUBLE AS value_min,
         CAST(n_nationkey AS DOUBLE) / 50.0::DOUBLE + 0.03::DOUBLE AS value_max, CAST(n_nationkey AS BIGINT) AS created FROM nation
  UNION ALL SELECT n_name, 'privacy', 1, 'nearestneighbordistance', CAST(n_regionkey AS DOUBLE) / 10.0::DOUBLE,
         CAST(n_regionkey AS DOUBLE) / 10.0::DOUBLE + 0.05::DOUBLE, n_nationkey FROM nation
  UNION ALL SELECT n_name, 'privacy', 2, 'identifiabilityscore', 0.9::DOUBLE, 0.9::DOUBLE + 0.05::DOUBLE, n_nationkey FROM nation WHERE n_regionkey < 2
  UNION ALL SELECT n_name, 'utility', 0, 'inversekldivergence', 0.5::DOUBLE + CAST(n_regionkey AS DOUBLE) / 10.0::DOUBLE,
         0.5::DOUBLE + CAST(n_regionkey AS DOUBLE) / 10.0::DOUBLE + 0.02::DOUBLE, n_nationkey FROM nation)"""


def _requests(spark, d) -> DataFrame:
    c = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("request_id"),
        F.when(F.col("c_nationkey") < 10, F.col("n_name")).otherwise(F.concat(F.lit("new_"), F.col("c_mktsegment"))).alias("level"),
        F.lit(1000).alias("size"),
        F.when(F.col("c_acctbal") > 0, F.lit("identifiabilityscore")).alias("privacy_metric"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / F.lit(20000.0) + F.lit(0.2)).alias("privacy_value"),
        F.when(F.col("c_nationkey") < 20, F.lit("inversekldivergence")).alias("utility_metric"),
        F.when(F.col("c_nationkey") < 20, F.lit(0.5) + F.col("c_nationkey").cast("double") / F.lit(50.0)).alias("utility_value"),
        F.lit(0.05).alias("tol"))


_REQUESTS = """requests AS (
  SELECT c_custkey AS request_id, CASE WHEN c_nationkey < 10 THEN n_name ELSE 'new_' || c_mktsegment END AS level, 1000 AS size,
         CASE WHEN c_acctbal > 0 THEN 'identifiabilityscore' END AS privacy_metric,
         CASE WHEN c_acctbal > 0 THEN c_acctbal / 20000.0::DOUBLE + 0.2::DOUBLE END AS privacy_value,
         CASE WHEN c_nationkey < 20 THEN 'inversekldivergence' END AS utility_metric,
         CASE WHEN c_nationkey < 20 THEN 0.5::DOUBLE + CAST(c_nationkey AS DOUBLE) / 50.0::DOUBLE END AS utility_value,
         0.05::DOUBLE AS tol
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
valid AS (SELECT * FROM requests WHERE privacy_metric IS NOT NULL OR utility_metric IS NOT NULL)"""

_FE = """fe AS (SELECT level, kind, metric, arg_min(value_min, pos) AS value_min, arg_min(value_max, pos) AS value_max,
               min(pos) AS pos, min(created) AS created FROM levels GROUP BY level, kind, metric)"""

_MATCH = f"""{_LEVELS}, {_REQUESTS}, {_FE},
mp AS (SELECT r.request_id, f.level FROM valid r JOIN fe f ON f.kind = 'privacy' AND f.metric = r.privacy_metric
       WHERE abs(r.privacy_value - f.value_min) <= r.tol OR abs(r.privacy_value - f.value_max) <= r.tol),
mu AS (SELECT r.request_id, f.level FROM valid r JOIN fe f ON f.kind = 'utility' AND f.metric = r.utility_metric
       WHERE abs(r.utility_value - f.value_min) <= r.tol OR abs(r.utility_value - f.value_max) <= r.tol),
matches AS (
  SELECT mp.request_id, mp.level FROM mp JOIN mu ON mp.request_id = mu.request_id AND mp.level = mu.level
     WHERE mp.request_id IN (SELECT request_id FROM valid WHERE privacy_metric IS NOT NULL AND utility_metric IS NOT NULL)
  UNION ALL SELECT request_id, level FROM mp WHERE request_id IN (SELECT request_id FROM valid WHERE utility_metric IS NULL)
  UNION ALL SELECT request_id, level FROM mu WHERE request_id IN (SELECT request_id FROM valid WHERE privacy_metric IS NULL))"""


@query("level_match", f"WITH {_MATCH} SELECT request_id, level FROM matches")
def level_match(spark, d):
    return R.find_levels(_requests(spark, d), _levels(spark, d)).select("request_id", "level")


@query("validate_request", f"""WITH {_LEVELS}, {_REQUESTS}
SELECT request_id, CASE WHEN privacy_metric IS NOT NULL OR utility_metric IS NOT NULL THEN 'valid' ELSE 'rejected' END AS status
FROM requests""")
def validate_request(spark, d):
    return R.validate_request(_requests(spark, d)).select("request_id", "status")


@query("level_exists", f"""WITH {_LEVELS}, {_REQUESTS}
SELECT request_id, level IN (SELECT level FROM levels) AS "exists" FROM requests""")
def level_exists(spark, d):
    return R.level_exists(_requests(spark, d), _levels(spark, d))


@query("level_remove", f"""WITH {_LEVELS}
SELECT * FROM levels WHERE level NOT IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA')""")
def level_remove(spark, d):
    names = (T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .filter(F.col("r_name") == "AMERICA").select(F.col("n_name").alias("level")))
    return R.remove_level(_levels(spark, d), names)


def _scores(spark, d):
    lv = _levels(spark, d)
    fe = R.first_entries(lv)
    p = fe.filter(F.col("kind") == "privacy").select("level", F.col("metric").alias("pm"), F.col("value_max").alias("privacy"))
    u = fe.filter(F.col("kind") == "utility").select("level", F.col("metric").alias("um"), F.col("value_max").alias("utility"),
                                                     F.col("created").alias("pos"))
    gens = p.join(u, "level")  # one row per (level, privacy metric)
    req = R.validate_request(_requests(spark, d)).filter(F.col("status") == "valid")
    keyed = req.select("request_id", F.col("privacy_value").alias("p_req"), F.col("utility_value").alias("u_req"),
                       F.coalesce("privacy_metric", F.lit("identifiabilityscore")).alias("pm"))
    return dealt(keyed, "request_id").join(F.broadcast(gens), "pm")  # equi-join on the requested metric name, a few rows a level


_SCORES = f"""{_LEVELS}, {_REQUESTS}, {_FE},
gens AS (SELECT p.level, p.metric AS pm, p.value_max AS privacy, u.value_max AS utility, u.created AS pos
         FROM fe p JOIN fe u ON p.level = u.level AND p.kind = 'privacy' AND u.kind = 'utility'),
scores AS (SELECT r.request_id, r.privacy_value AS p_req, r.utility_value AS u_req, g.level, g.pos, g.privacy, g.utility
           FROM valid r JOIN gens g ON g.pm = coalesce(r.privacy_metric, 'identifiabilityscore')),
diffs AS (SELECT *, CASE WHEN p_req IS NOT NULL AND u_req IS NOT NULL THEN (abs(privacy - p_req) + abs(utility - u_req)) / 2.0
                         WHEN p_req IS NOT NULL THEN abs(privacy - p_req) ELSE abs(utility - u_req) END AS diff FROM scores),
best AS (SELECT request_id, arg_min(level, (diff, pos)) AS level, arg_min(pos, (diff, pos)) AS pos, min(diff) AS diff FROM diffs GROUP BY request_id)"""


@query("closest_generator", f"WITH {_SCORES} SELECT request_id, level, pos, round(diff, 6) AS diff FROM best")
def closest_generator(spark, d):
    return rounded(R.closest_generator(_scores(spark, d)))


@query("first_satisfying", f"""WITH {_MATCH},
cand AS (SELECT m.request_id, m.level, l.created AS level_pos, a.attempt,
                {draw_sql(str(SEED), "'ok'", "concat_ws('|', m.request_id, m.level, a.attempt)")} < 0.2 AS ok
         FROM matches m JOIN (SELECT level, min(created) AS created FROM levels GROUP BY level) l ON m.level = l.level,
              (SELECT unnest(generate_series(0, 9)) AS attempt) a)
SELECT request_id, arg_min(level, (level_pos, attempt)) AS level, min(level_pos) AS level_pos,
       arg_min(attempt, (level_pos, attempt)) AS attempt FROM cand WHERE ok GROUP BY request_id""")
def first_satisfying(spark, d):
    lv = _levels(spark, d)
    m = R.find_levels(_requests(spark, d), lv).select("request_id", "level")
    order = lv.groupBy("level").agg(F.min("created").alias("level_pos"))
    cand = (m.join(F.broadcast(order), "level").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(9))))
            .withColumn("ok", draw(SEED, "ok", F.concat_ws("|", "request_id", "level", "attempt")) < 0.2))
    return R.first_satisfying(cand).select("request_id", "level", F.col("level_pos").cast("long").alias("level_pos"),
                                           "attempt")


def _matched_privacy(spark, d):
    lv = _levels(spark, d)
    req = _requests(spark, d)
    m = R.find_levels(req, lv).select("request_id", "level")
    fe = (R.first_entries(lv).filter(F.col("kind") == "privacy")
          .select("level", F.col("metric").alias("privacy_metric"), "value_min", "value_max"))
    j = (m.join(req.drop("level").filter(F.col("privacy_metric").isNotNull()), "request_id")
         .join(fe, ["level", "privacy_metric"]).withColumn("metric", F.col("privacy_metric")))
    reg = REG.metrics_table(spark).select("metric", "lo", "hi", "direction")
    return j.join(F.broadcast(reg), "metric")


@query("requirement_checks", f"""WITH {_MATCH},
reg AS (SELECT * FROM (VALUES ('identifiabilityscore', 0.0::DOUBLE, 1.0::DOUBLE, 0)) t(metric, lo, hi, direction)),
j AS (SELECT m.request_id, m.level, r.privacy_value AS req, f.value_max AS v, r.tol, g.lo, g.hi, g.direction
      FROM matches m JOIN valid r ON m.request_id = r.request_id AND r.privacy_metric IS NOT NULL
      JOIN fe f ON f.level = m.level AND f.kind = 'privacy' AND f.metric = r.privacy_metric JOIN reg g ON g.metric = f.metric)
SELECT request_id, level, v BETWEEN req - tol AND req + tol AS satisfied,
       CASE WHEN direction = 1 THEN v > req - tol ELSE v < req + tol END AS at_least,
       round(CASE WHEN direction = 1 THEN (req - v) / (hi - lo) ELSE (v - req) / (hi - lo) END, 6) AS amount FROM j""")
def requirement_checks(spark, d):
    j = _matched_privacy(spark, d)
    req, v = F.col("privacy_value"), F.col("value_max")
    return rounded(j.select("request_id", "level",
                            X.satisfied(req, v, F.col("tol")).alias("satisfied"),
                            X.at_least(req, v, F.col("tol"), F.col("direction")).alias("at_least"),
                            X.amount(req, v, F.col("lo"), F.col("hi"), F.col("direction")).alias("amount")))


@query("evaluate_request", f"""WITH {_MATCH},
res AS (SELECT m.request_id, m.level, f.metric, f.value_min AS value FROM matches m JOIN fe f ON f.level = m.level),
g AS (SELECT res.request_id, res.level, r.privacy_value, r.utility_value, r.tol,
             max(CASE WHEN res.metric = r.privacy_metric THEN value END) AS p, max(CASE WHEN res.metric = r.utility_metric THEN value END) AS u
      FROM res JOIN valid r ON res.request_id = r.request_id GROUP BY ALL)
SELECT request_id, level, coalesce((privacy_value IS NULL OR abs(privacy_value - p) <= tol) AND
                                   (utility_value IS NULL OR abs(utility_value - u) <= tol), false) AS ok FROM g""")
def evaluate_request(spark, d):
    lv = _levels(spark, d)
    req = _requests(spark, d)
    m = R.find_levels(req, lv).select("request_id", "level")
    fe = R.first_entries(lv)
    res = m.join(fe, "level").select("request_id", "level", "metric", F.col("value_min").alias("value"))
    return R.evaluate_request(res, R.validate_request(req).filter(F.col("status") == "valid"), keys=("request_id", "level"))


@query("next_epsilon", """
SELECT c_custkey AS id, round(e, 6) AS epsilon, CASE WHEN down THEN 0.1 ELSE e END AS new_low, CASE WHEN down THEN e ELSE 10.0 END AS new_high,
       CASE WHEN (CASE WHEN down THEN 0.1 ELSE e END) < (CASE WHEN down THEN e ELSE 10.0 END) THEN
            round(CASE WHEN down THEN floor((e - (e - 0.1) * abs(a)) * 10.0 + 0.5) / 10.0
                       ELSE floor((e + (10.0 - e) * abs(a)) * 10.0 + 0.5) / 10.0 END, 6) END AS new_epsilon
FROM (SELECT c_custkey, 0.1::DOUBLE + (c_acctbal + 1000.0::DOUBLE) / 1100.0::DOUBLE AS e,
             (CAST(c_nationkey AS DOUBLE) - 12.0::DOUBLE) / 25.0::DOUBLE AS a, c_mktsegment IN ('AUTOMOBILE', 'BUILDING') AS down FROM customer)""")
def next_epsilon(spark, d):
    c = T(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), (F.lit(0.1) + (F.col("c_acctbal") + F.lit(1000.0)) / F.lit(1100.0)).alias("epsilon"),
        F.lit(0.1).alias("low"), F.lit(10.0).alias("high"),
        ((F.col("c_nationkey").cast("double") - F.lit(12.0)) / F.lit(25.0)).alias("amount"),
        F.when(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING"), "down").otherwise("up").alias("direction"))
    return rounded(R.next_epsilon(c).select("id", "epsilon", "new_low", "new_high", "new_epsilon"))


@query("epsilon_direction", f"""WITH {_SCORES},
t AS (SELECT b.request_id, d.p_req, d.privacy AS p_val, d.u_req, d.utility AS u_val, 0.05 AS tol
      FROM best b JOIN diffs d ON b.request_id = d.request_id AND b.level = d.level),
f AS (SELECT *, p_req IS NOT NULL AS hp, u_req IS NOT NULL AS hu,
             abs(p_val - p_req) <= tol AS p_ok, abs(u_val - u_req) <= tol AS u_ok,
             p_val > p_req AS p_short, p_val < p_req AS p_over, u_val < u_req AS u_short, u_val > u_req AS u_over,
             abs(p_val - p_req) AS ap, abs(u_req - u_val) AS au FROM t),
g AS (SELECT * FROM f)
SELECT request_id,
  CASE WHEN hp AND hu AND p_ok AND u_ok THEN 'done' WHEN hp AND hu AND p_short AND u_over THEN 'down'
       WHEN hp AND hu AND p_over AND u_short THEN 'up' WHEN hp AND hu THEN 'restart'
       WHEN hp AND p_ok THEN 'done' WHEN hp AND p_short THEN 'down' WHEN hp THEN 'up'
       WHEN hu AND u_ok THEN 'done' WHEN hu AND u_over THEN 'down' WHEN hu THEN 'up' END AS move,
  round(CASE WHEN hp AND hu THEN least(ap, au) WHEN hp THEN ap ELSE au END, 6) AS step FROM g""")
def epsilon_direction(spark, d):
    sc = _scores(spark, d)
    best = R.closest_generator(sc).select(F.col("request_id").alias("_r"), F.col("level").alias("_best"))
    # The level is no join key: both sides are dealt by the request and stay there.
    t = sc.join(best, (F.col("request_id") == F.col("_r")) & F.array_contains(F.array("level"), F.col("_best"))).select(
        "request_id", "p_req", F.col("privacy").alias("p_val"), F.lit(0.0).alias("p_lo"), F.lit(1.0).alias("p_hi"),
        F.lit(0).alias("p_dir"), "u_req", F.col("utility").alias("u_val"), F.lit(0.0).alias("u_lo"), F.lit(1.0).alias("u_hi"),
        F.lit(1).alias("u_dir"), F.lit(0.05).alias("tol"))
    return rounded(R.epsilon_direction(t).select("request_id", "move", "step"))


@query("show_levels", f"""WITH {_LEVELS}
SELECT level, string_agg(printf('%s %s %.6f %.6f', kind, metric, value_min, value_max), '; ' ORDER BY kind, pos) AS description
FROM levels GROUP BY level""")
def show_levels(spark, d):
    return L.show_levels(_levels(spark, d))


# --- evaluation, sweep, level checks, serving -------------------------------------------

def _ids_sql(name: str, sizes, attempts, levels=None) -> str:
    sz = ", ".join(f"({s})" for s in sizes)
    at = ", ".join(f"({a})" for a in attempts)
    lv = ""
    lvsel = ""
    if levels:
        lv = ", (VALUES " + ", ".join(f"('{x}')" for x in levels) + ") lv(level)"
        lvsel = "lv.level, "
    return (f"{name} AS (SELECT {lvsel}r.range AS row_id, s.size, a.attempt, CAST(s.size AS VARCHAR) || '_' || CAST(a.attempt AS VARCHAR) AS att "
            f"FROM range({max(sizes)}) r, (VALUES {sz}) s(size), (VALUES {at}) a(attempt){lv} WHERE r.range < s.size)")


def gen_tagged_sql(model: str, ids: str, seed, cols, prefix: str = "gt", by_level: bool = False) -> str:
    """CTE ``{prefix}_t``: one synthetic table per tag row of ``ids`` (as L.generate_tagged)."""
    keys = (["level"] if by_level else []) + ["size", "attempt", "row_id"]
    parts = []
    for c in cols:
        u = draw_sql(str(seed), f"('{c}|' || i.att)", "i.row_id")
        w = draw_sql(str(seed), f"('{c}|' || i.att || '|in')", "i.row_id")
        val = (f"CASE WHEN m.kind = 'cat' THEN m.bin_lo WHEN m.integral THEN floor(m.bin_lo + {w} * (m.bin_hi - m.bin_lo))"
               f" ELSE m.bin_lo + {w} * (m.bin_hi - m.bin_lo) END")
        lvl = " AND m.level = i.level" if by_level else ""
        parts.append(f"""{prefix}_{c} AS (SELECT {', '.join('i.' + k for k in keys)}, {val} AS v FROM {ids} i JOIN {model} m
   ON m.column = '{c}'{lvl} AND {u} >= m.cum_lo AND {u} < m.cum_hi)""")
    first = f"{prefix}_{cols[0]}"
    sel = ", ".join(f"{prefix}_{c}.v AS {c}" for c in cols)
    joins = " ".join(f"JOIN {prefix}_{c} ON " + " AND ".join(f"{prefix}_{c}.{k} = {first}.{k}" for k in keys)
                     for c in cols[1:])
    return ", ".join(parts) + f", {prefix}_t AS (SELECT {', '.join(first + '.' + k for k in keys)}, {sel} FROM {first} {joins})"


_EVAL_SIZES, _EVAL_REPEATS = L.SIZES, L.REPEATS


@query("level_evaluation", f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 2.0, SEED)},
{_ids_sql('ids', _EVAL_SIZES, range(_EVAL_REPEATS))}, {gen_tagged_sql('m_model', 'ids', SEED, FEATS)},
{nn_sql('real', 'gt_t', FEATS, by=('size', 'attempt'))}, {kl_sql('real', 'gt_t', FEATS, by=('size', 'attempt'))}
SELECT 'nearestneighbordistance' AS metric, size, round(avg(v), 6) AS value FROM nn_v GROUP BY size
UNION ALL SELECT 'inversekldivergence', size, round(avg(v), 6) FROM kl_v GROUP BY size""")
def level_evaluation(spark, d):
    real, _ = cust_roles(spark, d)
    model = Y.dp_fit(real, 2.0, SEED, FEATS)
    ev = L.evaluate_level(real, model, ["nearestneighbordistance", "inversekldivergence"], _EVAL_SIZES, _EVAL_REPEATS, SEED, FEATS)
    return rounded(ev)


@query("report_long", f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 2.0, SEED)},
{_ids_sql('ids', _EVAL_SIZES, range(_EVAL_REPEATS))}, {gen_tagged_sql('m_model', 'ids', SEED, FEATS)},
{nn_sql('real', 'gt_t', FEATS, by=('size', 'attempt'))}, {kl_sql('real', 'gt_t', FEATS, by=('size', 'attempt'))}
SELECT 'eps2' AS level, 'dp' AS generator, 'nearestneighbordistance' AS metric, size, round(avg(v), 6) AS value FROM nn_v GROUP BY size
UNION ALL SELECT 'eps2', 'dp', 'inversekldivergence', size, round(avg(v), 6) FROM kl_v GROUP BY size""")
def report_long(spark, d):
    real, _ = cust_roles(spark, d)
    model = Y.dp_fit(real, 2.0, SEED, FEATS)
    ev = L.evaluate_level(real, model, ["nearestneighbordistance", "inversekldivergence"], _EVAL_SIZES, _EVAL_REPEATS, SEED, FEATS)
    rep = evaluation_report(rounded(ev), "dp", "eps2")
    from mirage.sources.io import write_report
    write_report(rep, scratch(spark, "report"))
    return rep


_SWEEP = [0.5, 1.0, 2.0, 4.0, 8.0]
_SWEEP_SIZE = 500


def _sweep_sql() -> str:
    u = dsql(SEED, "noise", "(column || '|' || CAST(bin AS VARCHAR))")
    eps = ", ".join(f"({e!r}::DOUBLE)" for e in _SWEEP)
    ut = draw_sql(str(SEED), "(i.column || '|' || CAST(i.epsilon AS VARCHAR))", "i.row_id")
    wt = draw_sql(str(SEED), "(i.column || '|' || CAST(i.epsilon AS VARCHAR) || '|in')", "i.row_id")
    cols = FEATS
    pivot = ", ".join(f"max(CASE WHEN column = '{c}' THEN v END) AS {c}" for c in cols)
    return f"""{CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, None, SEED)},
e AS (SELECT * FROM (VALUES {eps}) t(epsilon)),
cn AS (SELECT m.*, e.epsilon, greatest(m.count - ({float(len(cols))!r} / e.epsilon) * sign({u} - 0.5) * ln(1.0 - 2.0 * abs({u} - 0.5)), 0.0) AS nz
       FROM m_model m, e),
cp AS (SELECT *, CASE WHEN sum(nz) OVER (PARTITION BY epsilon, column) > 0 THEN nz / sum(nz) OVER (PARTITION BY epsilon, column)
                      ELSE 1.0 / count(*) OVER (PARTITION BY epsilon, column) END AS pp FROM cn),
cc AS (SELECT *, sum(pp) OVER (PARTITION BY epsilon, column ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ch,
              row_number() OVER (PARTITION BY epsilon, column ORDER BY bin DESC) AS rl FROM cp),
cm AS (SELECT epsilon, column, kind, bin, bin_lo, bin_hi, integral, coalesce(lag(ch) OVER (PARTITION BY epsilon, column ORDER BY bin), 0.0) AS clo,
              CASE WHEN rl = 1 THEN 1.0 ELSE ch END AS chi FROM cc),
ids AS (SELECT r.range AS row_id, e.epsilon, c.column FROM range({_SWEEP_SIZE}) r, e, (VALUES {', '.join(f"('{c}')" for c in cols)}) c(column)),
pk AS (SELECT i.row_id, i.epsilon, i.column,
         CASE WHEN m.kind = 'cat' THEN m.bin_lo WHEN m.integral THEN floor(m.bin_lo + {wt} * (m.bin_hi - m.bin_lo))
              ELSE m.bin_lo + {wt} * (m.bin_hi - m.bin_lo) END AS v
       FROM ids i JOIN cm m ON m.epsilon = i.epsilon AND m.column = i.column AND {ut} >= m.clo AND {ut} < m.chi),
syn_e AS (SELECT epsilon, row_id, {pivot} FROM pk GROUP BY epsilon, row_id),
{nn_sql('real', 'syn_e', FEATS, by=('epsilon',))}, {kl_sql('real', 'syn_e', FEATS, by=('epsilon',))}"""


@query("epsilon_sweep", f"""WITH {_sweep_sql()}
SELECT epsilon, 'nearestneighbordistance' AS metric, round(v, 6) AS value FROM nn_v
UNION ALL SELECT epsilon, 'inversekldivergence', round(v, 6) FROM kl_v""")
def epsilon_sweep(spark, d):
    real, _ = cust_roles(spark, d)
    return rounded(L.epsilon_sweep(real, _SWEEP, _SWEEP_SIZE, SEED, FEATS))


@query("search_epsilon", """SELECT c_mktsegment AS level, 'done' AS status, true AS inside, true AS in_bracket FROM customer GROUP BY c_mktsegment""")
def search_epsilon(spark, d):
    """One wanted level per market segment, each with its own utility; all are
    searched together and end inside their bands."""
    real, _ = cust_roles(spark, d)
    seg = T(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_nationkey").alias("n"))
    rank = F.pmod(F.crc32(F.col("c_mktsegment").cast("binary")), F.lit(5)).cast("double")
    wanted = seg.select(F.col("c_mktsegment").alias("level"), F.lit(None).cast("string").alias("privacy_metric"), F.lit(None).cast("double").alias("privacy_value"),
                        F.lit("inversekldivergence").alias("utility_metric"), (F.lit(0.84) + rank * 0.03).alias("utility_value"), F.lit(0.08).alias("tol"))
    out = S.search_epsilons(real, wanted, 500, SEED, FEATS)
    j = out.join(wanted, "level")
    return j.select("level", "status", (F.abs(F.col("u_val") - F.col("utility_value")) <= F.col("tol")).alias("inside"),
                    F.col("epsilon").between(S.LOW, S.HIGH).alias("in_bracket"))


def _meets_requests(spark, d) -> DataFrame:
    c = T(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), F.lit("eps2").alias("level"), F.lit(5500).alias("size"),
                    F.lit("nearestneighbordistance").alias("privacy_metric"),
                    (F.col("c_acctbal") / F.lit(40000.0) + F.lit(0.1)).alias("privacy_value"),
                    F.lit("inversekldivergence").alias("utility_metric"),
                    (F.lit(0.7) + F.col("c_nationkey").cast("double") / F.lit(100.0)).alias("utility_value"),
                    F.lit(0.05).alias("tol"))


@query("level_meets", f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 2.0, SEED)},
{_ids_sql('ids', [5500], range(5))}, {gen_tagged_sql('m_model', 'ids', SEED, FEATS)},
{nn_sql('real', 'gt_t', FEATS, by=('attempt',))}, {kl_sql('real', 'gt_t', FEATS, by=('attempt',))},
req AS (SELECT c_custkey AS request_id, c_acctbal / 40000.0::DOUBLE + 0.1::DOUBLE AS pv,
               0.7::DOUBLE + CAST(c_nationkey AS DOUBLE) / 100.0::DOUBLE AS uv, 0.05::DOUBLE AS tol FROM customer)
SELECT r.request_id, bool_or(abs(r.pv - n.v) <= r.tol AND abs(r.uv - k.v) <= r.tol) AS ok
FROM req r, nn_v n JOIN kl_v k ON n.attempt = k.attempt GROUP BY r.request_id""")
def level_meets(spark, d):
    real, _ = cust_roles(spark, d)
    model = Y.dp_fit(real, 2.0, SEED, FEATS)
    return L.level_meets(real, model, _meets_requests(spark, d), 5500, 5, SEED, FEATS)


_SERVE_EPS = {"eps8": 8.0, "eps2": 2.0, "eps05": 0.5, "eps01": 0.1}
_SERVE_LEVELS = [("eps8", 0, (0.10, 0.14), (0.90, 0.93)), ("eps2", 1, (0.15, 0.2), (0.85, 0.88)),
                 ("eps05", 2, (0.2, 0.3), (0.75, 0.8)), ("eps01", 3, (0.3, 0.45), (0.6, 0.7))]


def _serve_levels(spark) -> DataFrame:
    parts = [L.create_level(spark, n, [("nearestneighbordistance", p)], [("inversekldivergence", u)], created=c)
             for n, c, p, u in _SERVE_LEVELS]
    return reduce(DataFrame.unionByName, parts)


def _serve_requests(spark, d) -> DataFrame:
    c = T(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("request_id"), F.lit("any").alias("level"),
                    F.when(F.col("c_nationkey") < 12, F.lit(200)).otherwise(F.lit(100)).alias("size"),
                    F.when(F.col("c_mktsegment") != "MACHINERY", F.lit("nearestneighbordistance")).alias("privacy_metric"),
                    F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") / F.lit(40000.0) + F.lit(0.15)).alias("privacy_value"),
                    F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.lit("inversekldivergence")).alias("utility_metric"),
                    F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.lit(0.6) + F.col("c_nationkey").cast("double") / F.lit(80.0)).alias("utility_value"),
                    F.lit(0.05).alias("tol"))


def _serve_sql() -> str:
    models = ", ".join(dp_sql("real", FEATS, e, SEED, prefix=f"m_{n}") for n, e in _SERVE_EPS.items())
    union = " UNION ALL ".join(f"SELECT '{n}' AS level, * FROM m_{n}_model" for n in _SERVE_EPS)
    lv = ", ".join(f"('{n}', 'privacy', 0, 'nearestneighbordistance', {p[0]!r}::DOUBLE, {p[1]!r}::DOUBLE, {c}), "
                   f"('{n}', 'utility', 0, 'inversekldivergence', {u[0]!r}::DOUBLE, {u[1]!r}::DOUBLE, {c})"
                   for n, c, p, u in _SERVE_LEVELS)
    return f"""{CUST_ENC}, {roles_sql()}, {models}, models AS ({union}),
levels AS (SELECT * FROM (VALUES {lv}) t(level, kind, pos, metric, value_min, value_max, created)),
requests AS (SELECT c_custkey AS request_id, CASE WHEN c_nationkey < 12 THEN 200 ELSE 100 END AS size,
   CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'nearestneighbordistance' END AS privacy_metric,
   CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal / 40000.0::DOUBLE + 0.15::DOUBLE END AS privacy_value,
   CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'inversekldivergence' END AS utility_metric,
   CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 0.6::DOUBLE + CAST(c_nationkey AS DOUBLE) / 80.0::DOUBLE END AS utility_value,
   0.05::DOUBLE AS tol FROM customer),
valid AS (SELECT * FROM requests WHERE privacy_metric IS NOT NULL OR utility_metric IS NOT NULL),
{_FE},
mp AS (SELECT r.request_id, f.level FROM valid r JOIN fe f ON f.kind = 'privacy' AND f.metric = r.privacy_metric
       WHERE abs(r.privacy_value - f.value_min) <= r.tol OR abs(r.privacy_value - f.value_max) <= r.tol),
mu AS (SELECT r.request_id, f.level FROM valid r JOIN fe f ON f.kind = 'utility' AND f.metric = r.utility_metric
       WHERE abs(r.utility_value - f.value_min) <= r.tol OR abs(r.utility_value - f.value_max) <= r.tol),
matches AS (
  SELECT mp.request_id, mp.level FROM mp JOIN mu ON mp.request_id = mu.request_id AND mp.level = mu.level
  UNION ALL SELECT request_id, level FROM mp WHERE request_id IN (SELECT request_id FROM valid WHERE utility_metric IS NULL)
  UNION ALL SELECT request_id, level FROM mu WHERE request_id IN (SELECT request_id FROM valid WHERE privacy_metric IS NULL)),
need AS (SELECT m.request_id, m.level, r.size FROM matches m JOIN valid r ON m.request_id = r.request_id),
combos AS (SELECT DISTINCT level, size FROM need),
ids AS (SELECT c.level, r.range AS row_id, c.size, a.attempt, CAST(c.size AS VARCHAR) || '_' || CAST(a.attempt AS VARCHAR) AS att
        FROM combos c, range(200) r, (SELECT unnest(generate_series(0, 9)) AS attempt) a WHERE r.range < c.size),
{gen_tagged_sql('models', 'ids', SEED, FEATS, by_level=True)},
{nn_sql('real', 'gt_t', FEATS, by=('level', 'size', 'attempt'))}, {kl_sql('real', 'gt_t', FEATS, by=('level', 'size', 'attempt'))},
res AS (SELECT level, size, attempt, 'nearestneighbordistance' AS metric, v AS value FROM nn_v
        UNION ALL SELECT level, size, attempt, 'inversekldivergence', v FROM kl_v),
ok AS (SELECT n.request_id, n.level, r.attempt, lv.created,
          coalesce((q.privacy_value IS NULL OR abs(q.privacy_value - max(CASE WHEN r.metric = q.privacy_metric THEN r.value END)) <= q.tol)
               AND (q.utility_value IS NULL OR abs(q.utility_value - max(CASE WHEN r.metric = q.utility_metric THEN r.value END)) <= q.tol), false) AS ok
       FROM need n JOIN res r ON n.level = r.level AND n.size = r.size JOIN valid q ON q.request_id = n.request_id
       JOIN (SELECT level, min(created) AS created FROM levels GROUP BY level) lv ON lv.level = n.level
       GROUP BY n.request_id, n.level, r.attempt, lv.created, q.privacy_value, q.utility_value, q.tol),
chosen AS (SELECT request_id, arg_min(level, (created, attempt)) AS level, arg_min(attempt, (created, attempt)) AS attempt
           FROM ok WHERE ok GROUP BY request_id)"""


_SERVE_SQL = f"""WITH {_serve_sql()}
SELECT request_id, level, attempt, 'served' AS status FROM chosen
UNION ALL SELECT request_id, NULL, NULL, CASE WHEN privacy_metric IS NOT NULL OR utility_metric IS NOT NULL THEN 'pending' ELSE 'rejected' END
FROM requests WHERE request_id NOT IN (SELECT request_id FROM chosen)"""


@query("serve", _SERVE_SQL)
def serve(spark, d):
    real, _ = cust_roles(spark, d)
    models = {n: Y.dp_fit(real, e, SEED, FEATS) for n, e in _SERVE_EPS.items()}
    return L.serve(real, _serve_requests(spark, d), _serve_levels(spark), models, None, 10, SEED, FEATS)


@query("serve_rows", f"""WITH {_serve_sql()},
seg AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM customer))
SELECT c.request_id, c.level, c.attempt, g.row_id, CAST(round(g.c_nationkey) AS INTEGER) AS c_nationkey, round(g.c_acctbal, 6) AS c_acctbal,
  seg.v AS c_mktsegment
FROM chosen c JOIN need n ON c.request_id = n.request_id AND c.level = n.level
JOIN gt_t g ON g.level = c.level AND g.attempt = c.attempt AND g.size = n.size
JOIN seg ON seg.code = least(greatest(round(g.c_mktsegment), 0), (SELECT max(code) FROM seg))""")
def serve_rows(spark, d):
    """The decoded rows each served request gets; winners go to the cache."""
    from mirage.operators.prep import encode
    from mirage.plans.catalog import cust_raw, roles
    enc, encoding = encode(cust_raw(spark, d))
    real, _ = roles(enc)
    models = {n: Y.dp_fit(real, e, SEED, FEATS) for n, e in _SERVE_EPS.items()}
    store = Store(spark, scratch(spark, "store"))
    rows = L.serve_rows(real, _serve_requests(spark, d), _serve_levels(spark), models, store, 10, SEED, FEATS, encoding)
    return rounded(rows.select("request_id", "level", "attempt", "row_id", *FEATS))


@query("serve_stream", _SERVE_SQL)
def serve_stream(spark, d):
    from mirage.streaming.serve import serve_stream as run
    real, _ = cust_roles(spark, d)
    models = {n: Y.dp_fit(real, e, SEED, FEATS) for n, e in _SERVE_EPS.items()}
    return run(real, _serve_requests(spark, d), _serve_levels(spark), models, scratch(spark, "stream"),
               seed=SEED, cols=FEATS, chunks=3)


@query("add_metric")
def add_metric(spark, d):
    real, _ = cust_roles(spark, d)
    models = {n: Y.dp_fit(real, e, SEED, FEATS) for n, e in _SERVE_EPS.items()}
    return rounded(L.add_metric(real, _serve_levels(spark), models, "singlingout", (100, 300), 2, SEED, FEATS))


@query("add_generator", f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 4.0, SEED)},
{_ids_sql('ids', _EVAL_SIZES, range(_EVAL_REPEATS))}, {gen_tagged_sql('m_model', 'ids', SEED, FEATS)},
{nn_sql('real', 'gt_t', FEATS, by=('size', 'attempt'))}, {kl_sql('real', 'gt_t', FEATS, by=('size', 'attempt'))},
ev AS (SELECT 'privacy' AS kind, 'nearestneighbordistance' AS metric, size, avg(v) AS value FROM nn_v GROUP BY size
       UNION ALL SELECT 'utility', 'inversekldivergence', size, avg(v) FROM kl_v GROUP BY size)
SELECT 'eps4' AS level, kind, 0 AS pos, metric, round(max(CASE WHEN size = {min(_EVAL_SIZES)} THEN value END), 6) AS value_min,
  round(max(CASE WHEN size = {max(_EVAL_SIZES)} THEN value END), 6) AS value_max, 0 AS created FROM ev GROUP BY kind, metric""")
def add_generator(spark, d):
    real, _ = cust_roles(spark, d)
    store = Store(spark, scratch(spark, "store"))
    rows = L.add_generator(real.select("row_id", *FEATS), store.read_levels(), store, "eps4", "dp",
                           metrics=("nearestneighbordistance", "inversekldivergence"), sizes=_EVAL_SIZES, repeats=_EVAL_REPEATS,
                           seed=SEED, epsilon=4.0, cols=FEATS)
    return rounded(rows)


@query("store_roundtrip", f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 2.0, SEED)}
SELECT column, kind, bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, round(p, 6) AS p,
       round(cum_lo, 6) AS cum_lo, round(cum_hi, 6) AS cum_hi FROM m_model""")
def store_roundtrip(spark, d):
    real, _ = cust_roles(spark, d)
    store = Store(spark, scratch(spark, "store"))
    model = Y.dp_fit(real, 2.0, SEED, FEATS)
    assert store.save_model(model, "dp", "eps2")
    assert not store.save_model(Y.dp_fit(real, 8.0, SEED, FEATS), "dp", "eps2")  # a stored level is kept
    back = store.load_model("eps2", "dp")
    return rounded(back.select("column", "kind", "bin", "bin_lo", "bin_hi", "p", "cum_lo", "cum_hi"))


@query("level_remove_store", f"""WITH {_LEVELS} SELECT * FROM levels WHERE level <> 'FRANCE'""")
def level_remove_store(spark, d):
    real, _ = cust_roles(spark, d)
    store = Store(spark, scratch(spark, "store"))
    store.append_levels(_levels(spark, d))
    store.save_model(Y.dp_fit(real, 2.0, SEED, FEATS), "dp", "FRANCE")
    store.cache_put("FRANCE", real.filter(F.col("c_mktsegment") == 0))
    store.remove_level("FRANCE")
    gone = store.load_model("FRANCE")
    cached = store.cache_get("FRANCE")
    assert (gone is None or gone.count() == 0) and (cached is None or cached.count() == 0)
    return store.read_levels()


@query("prepare", f"""WITH {_serve_sql()},
pend AS (SELECT request_id FROM valid WHERE request_id NOT IN (SELECT request_id FROM chosen))
SELECT request_id, 'any' AS level, true AS prepared, true AS published FROM pend""")
def prepare(spark, d):
    """Requests nothing served (serve -> pending) go to preparation; all of
    them ask for the level named 'any', which is prepared once and published."""
    real, _ = cust_roles(spark, d)
    models = {n: Y.dp_fit(real, e, SEED, FEATS) for n, e in _SERVE_EPS.items()}
    reqs = _serve_requests(spark, d)
    lv = _serve_levels(spark)
    served = L.serve(real, reqs, lv, models, None, 10, SEED, FEATS)
    pending = reqs.join(served.filter(F.col("status") == "pending").select("request_id"), "request_id", "left_semi")
    store = Store(spark, scratch(spark, "store"))
    out = S.prepare(real, pending, lv, models, store, seed=SEED, cols=FEATS)
    names = {r["level"] for r in store.read_levels().select("level").distinct().collect()}
    return out.select("request_id", "level", F.col("outcome").isin("merged", "searched").alias("prepared"), F.col("level").isin(list(names)).alias("published"))
