"""Catalog: generators (Y1-Y12), accumulation (U2), merging (G1-G7), flagship."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.draws import draw
from mirage.operators import distance as D
from mirage.operators import merge as G
from mirage.operators import metrics as M
from mirage.operators import private as PV
from mirage.operators import synth as Y
from mirage.operators import tournament as TM
from mirage.operators.modes import fit_value_modes, start_modes
from mirage.operators.prep import encode
from mirage.plans.catalog import (CUST_ENC, FEATS, ROLE_SEED, SEED, T, cust_enc, cust_roles, dist_sql, dsql,
                                  freqs_sql, long_sql, query, roles, roles_sql, rounded)

INTEGRAL = {"c_nationkey", "c_mktsegment", "c_name"}
TEXT = {"c_mktsegment", "c_name"}  # categories at any width


def dp_sql(src: str, cols, eps: float | None, seed: int, prefix: str = "m", mech: str = "laplace",
           integral=INTEGRAL) -> str:
    """CTEs ending in ``{prefix}_model`` (column, kind, bin, bin_lo, bin_hi, count,
    noisy, p, cum_lo, cum_hi, integral) - the DP marginal model of ``src``."""
    scale = 0.0 if eps is None else len(cols) / float(eps)
    u = dsql(seed, "noise", "(column || '|' || CAST(bin AS VARCHAR))")
    if scale == 0:
        noisy = "count"
    elif mech == "geometric":
        noisy = f"greatest(count + sign({u} - 0.5) * floor(ln(1.0 - abs(2.0 * {u} - 1.0)) / (-1.0 / {scale!r})), 0.0)"
    else:
        noisy = f"greatest(count - {scale!r} * sign({u} - 0.5) * ln(1.0 - 2.0 * abs({u} - 0.5)), 0.0)"
    integ = ", ".join(f"'{c}'" for c in cols if c in integral) or "NULL"
    text = ", ".join(f"'{c}'" for c in cols if c in TEXT) or "NULL"
    return f"""{prefix}_l AS ({long_sql(src, cols)}),
{prefix}_prof AS (SELECT column, nd, least(10, nd) AS k, coalesce(nd < 5 OR column IN ({text}), false) AS cat, lo, hi FROM
   (SELECT column, count(DISTINCT v) AS nd, min(v) AS lo, max(v) AS hi FROM {prefix}_l GROUP BY column)),
{prefix}_b AS (SELECT l.column, l.v, p.cat,
     CASE WHEN p.cat THEN CAST(round(l.v * 1000000.0) AS BIGINT)
          ELSE CAST(least(floor((l.v - p.lo) * CAST(p.k AS DOUBLE) / (p.hi - p.lo)), p.k - 1) AS BIGINT) END AS bin
   FROM {prefix}_l l JOIN {prefix}_prof p ON l.column = p.column
   WHERE l.v IS NOT NULL AND (p.cat OR (l.v >= p.lo AND l.v <= p.hi))),
{prefix}_c AS (SELECT column, bin, count(*) AS n, any_value(v) AS v0 FROM {prefix}_b GROUP BY column, bin),
{prefix}_g AS (
   SELECT c.column, c.bin, CAST(c.n AS DOUBLE) AS count, c.v0 FROM {prefix}_c c JOIN {prefix}_prof p ON c.column = p.column WHERE p.cat
   UNION ALL
   SELECT g.column, g.bin, CAST(coalesce(c.n, 0) AS DOUBLE), c.v0 FROM
     (SELECT column, unnest(generate_series(0, k - 1)) AS bin FROM {prefix}_prof WHERE NOT cat) g
     LEFT JOIN {prefix}_c c ON g.column = c.column AND g.bin = c.bin),
{prefix}_n AS (SELECT x.*, {noisy} AS noisy FROM
   (SELECT g.*, p.cat, p.lo, p.hi, p.k FROM {prefix}_g g JOIN {prefix}_prof p ON g.column = p.column) x),
{prefix}_p AS (SELECT *, CASE WHEN sum(noisy) OVER (PARTITION BY column) > 0 THEN noisy / sum(noisy) OVER (PARTITION BY column)
                              ELSE 1.0 / count(*) OVER (PARTITION BY column) END AS p FROM {prefix}_n),
{prefix}_cum AS (SELECT *, sum(p) OVER (PARTITION BY column ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ch,
                           row_number() OVER (PARTITION BY column ORDER BY bin DESC) AS rl FROM {prefix}_p),
{prefix}_model AS (SELECT column, CASE WHEN cat THEN 'cat' ELSE 'hist' END AS kind, bin,
     CASE WHEN cat THEN v0 ELSE lo + CAST(bin AS DOUBLE) * ((hi - lo) / CAST(k AS DOUBLE)) END AS bin_lo,
     CASE WHEN cat THEN v0 ELSE lo + CAST(bin + 1 AS DOUBLE) * ((hi - lo) / CAST(k AS DOUBLE)) END AS bin_hi,
     count, noisy, p, coalesce(lag(ch) OVER (PARTITION BY column ORDER BY bin), 0.0) AS cum_lo,
     CASE WHEN rl = 1 THEN 1.0 ELSE ch END AS cum_hi, column IN ({integ}) AS integral FROM {prefix}_cum)"""


def gen_sql(model: str, n: int | str, seed: int, cols, attempt="0", prefix: str = "g") -> str:
    """CTE ``{prefix}_t`` (row_id, cols...) generated from a model CTE."""
    ids = f"{prefix}_ids AS (SELECT range AS row_id FROM range({n}))"
    parts = []
    for c in cols:
        u = dsql(seed, f"{c}|{attempt}", "i.row_id")
        w = dsql(seed, f"{c}|{attempt}|in", "i.row_id")
        val = (f"CASE WHEN m.kind = 'cat' THEN m.bin_lo WHEN m.integral THEN floor(m.bin_lo + {w} * (m.bin_hi - m.bin_lo))"
               f" ELSE m.bin_lo + {w} * (m.bin_hi - m.bin_lo) END")
        parts.append(f"""{prefix}_{c} AS (SELECT i.row_id, {val} AS v FROM {prefix}_ids i JOIN {model} m
   ON m.column = '{c}' AND {u} >= m.cum_lo AND {u} < m.cum_hi)""")
    sel = ", ".join(f"{prefix}_{c}.v AS {c}" for c in cols)
    joins = " ".join(f"JOIN {prefix}_{c} ON {prefix}_{c}.row_id = {prefix}_ids.row_id" for c in cols)
    return f"{ids}, " + ", ".join(parts) + f", {prefix}_t AS (SELECT {prefix}_ids.row_id, {sel} FROM {prefix}_ids {joins})"


_MODEL_COLS = ["column", "kind", "bin", "bin_lo", "bin_hi", "noisy", "p", "cum_lo", "cum_hi", "integral"]
_R = ", ".join(f"round({c}, 6) AS {c}" if c not in ("column", "kind", "bin", "integral") else c for c in _MODEL_COLS)


@query("dp_fit", f"WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 2.0, SEED)} SELECT {_R} FROM m_model")
def dp_fit_q(spark, d):
    real, _ = cust_roles(spark, d)
    return rounded(Y.dp_fit(real, 2.0, SEED, FEATS).select(*_MODEL_COLS))


@query("dp_fit_geometric", f"WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 1.0, SEED, mech='geometric')} SELECT {_R} FROM m_model")
def dp_fit_geometric(spark, d):
    real, _ = cust_roles(spark, d)
    return rounded(Y.dp_fit(real, 1.0, SEED, FEATS, mechanism="geometric").select(*_MODEL_COLS))


@query("dp_fit_exact", f"WITH {CUST_ENC}, {dp_sql('cust_enc', FEATS, None, SEED)} SELECT {_R} FROM m_model")
def dp_fit_exact(spark, d):
    return rounded(Y.dp_fit(cust_enc(spark, d), None, SEED, FEATS).select(*_MODEL_COLS))


@query("bound_contribution", f"""
SELECT row_id, o_custkey, o_totalprice FROM (
  SELECT o_orderkey AS row_id, o_custkey, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY {dsql(SEED, 'unit', 'o_orderkey')}, o_orderkey) AS rn FROM orders)
WHERE rn <= 3""")
def bound_contribution(spark, d):
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_totalprice")
    return Y.bound_contribution(o, "o_custkey", 3, SEED)


@query("generate", f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 2.0, SEED)}, {gen_sql('m_model', 1000, SEED, FEATS)}
SELECT row_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATS)} FROM g_t""")
def generate_q(spark, d):
    real, _ = cust_roles(spark, d)
    return rounded(Y.generate(Y.dp_fit(real, 2.0, SEED, FEATS), 1000, SEED))


_NAMES = """named AS (
  SELECT c.c_custkey AS row_id, d.code AS c_name, s.code AS c_mktsegment, c.c_acctbal FROM customer c
  JOIN (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code FROM (SELECT DISTINCT c_name AS v FROM customer)) d ON c.c_name = d.v
  JOIN (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)) s ON c.c_mktsegment = s.v)"""
_NAMED = ["c_name", "c_mktsegment", "c_acctbal"]


@query("generate_wide_text", f"""WITH {_NAMES}, {dp_sql('named', _NAMED, 8.0, SEED)}, {gen_sql('m_model', 3000, SEED, _NAMED)}
SELECT row_id, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMED)} FROM g_t""")
def generate_wide_text(spark, d):
    """A text column with a value per customer: categories, drawn by a guide table."""
    raw = T(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), *_NAMED)
    real, _ = encode(raw)
    return rounded(Y.generate(Y.dp_fit(real, 8.0, SEED, _NAMED), 3000, SEED)).select("row_id", *_NAMED)


def flagship_sql(n_rows_sql: str = "(SELECT floor(sum(noisy) / count(DISTINCT column) + 0.5)::BIGINT FROM m_model)") -> str:
    return f"""WITH {CUST_ENC}, {dp_sql('cust_enc', FEATS, 2.0, SEED)},
{gen_sql('m_model', n_rows_sql, SEED, FEATS)}, real AS (SELECT * FROM cust_enc), syn AS (SELECT * FROM g_t),
{freqs_sql('real', 'syn', FEATS, prefix='k')},
kl_c AS (SELECT column, sum(p_real * ln(p_real / p_syn)) / sum(p_real) + ln(sum(p_syn) / sum(p_real)) AS kl FROM k_al GROUP BY column),
nn_d AS (SELECT a.row_id, min({dist_sql('a', 'b', FEATS)}) AS dist FROM real a, syn b GROUP BY a.row_id),
nn_s AS (SELECT avg(dist) m, min(dist) lo, max(dist) hi FROM nn_d)
SELECT round((SELECT avg(1.0 / (1.0 + kl)) FROM kl_c), 6) AS inverse_kl,
       round(CASE WHEN hi = lo THEN 0.0 ELSE (m - lo) / (hi - lo) END, 6) AS nearest_neighbor_distance FROM nn_s"""


@query("flagship", flagship_sql())
def flagship(spark, d):
    """Minimum slice: private customers -> encode -> DP fit (epsilon 2) ->
    as many synthetic rows as real ones -> (inverse KL, nearest-neighbour distance)."""
    real = cust_enc(spark, d)
    syn = Y.generate(Y.dp_fit(real, 2.0, SEED, FEATS), None, SEED)
    return rounded(M.side_by_side(M.inverse_kl(real, syn, FEATS), M.nearest_neighbor_distance(real, syn, FEATS)))


@query("pair_mutual_information", f"""WITH {CUST_ENC},
l AS ({long_sql('cust_enc', FEATS)}),
prof AS (SELECT column, least(10, count(DISTINCT v)) AS k, count(DISTINCT v) < 5 AS cat, min(v) AS lo, max(v) AS hi FROM l GROUP BY column),
pw AS (SELECT max(CASE WHEN column = 'c_nationkey' THEN k END) k1, max(CASE WHEN column = 'c_nationkey' THEN lo END) lo1,
              max(CASE WHEN column = 'c_nationkey' THEN hi END) hi1,
              max(CASE WHEN column = 'c_acctbal' THEN k END) k2, max(CASE WHEN column = 'c_acctbal' THEN lo END) lo2,
              max(CASE WHEN column = 'c_acctbal' THEN hi END) hi2 FROM prof),
b AS (SELECT row_id,
        CAST(least(floor((CAST(c_nationkey AS DOUBLE) - lo1) * CAST(k1 AS DOUBLE) / (hi1 - lo1)), k1 - 1) AS BIGINT) AS c_nationkey,
        CAST(least(floor((c_acctbal - lo2) * CAST(k2 AS DOUBLE) / (hi2 - lo2)), k2 - 1) AS BIGINT) AS c_acctbal,
        CAST(round(CAST(c_mktsegment AS DOUBLE) * 1000000.0) AS BIGINT) AS c_mktsegment FROM cust_enc, pw),
pc AS (SELECT 'c_nationkey' AS a, 'c_acctbal' AS b, c_nationkey AS ba, c_acctbal AS bb, count(*) AS n FROM b GROUP BY 3, 4
       UNION ALL SELECT 'c_nationkey', 'c_mktsegment', c_nationkey, c_mktsegment, count(*) FROM b GROUP BY 3, 4
       UNION ALL SELECT 'c_acctbal', 'c_mktsegment', c_acctbal, c_mktsegment, count(*) FROM b GROUP BY 3, 4),
t AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, ba) AS na,
             sum(n) OVER (PARTITION BY a, b, bb) AS nb FROM pc)
SELECT a, b, round(sum((n / t) * ln(n * t / (na * nb))), 6) AS mi FROM t GROUP BY a, b""")
def pair_mutual_information(spark, d):
    return rounded(Y.pair_mutual_information(cust_enc(spark, d), FEATS))


@query("generate_conditional")
def generate_conditional(spark, d):
    real, syn = cust_roles(spark, d)
    model = Y.modes_fit(real, 4.0, SEED, FEATS, cond="c_mktsegment")
    cond = syn.select(F.col("row_id"), "c_mktsegment")
    return rounded(Y.generate(model, cond.count(), SEED, cond=cond))


@query("value_modes")
def value_modes(spark, d):
    real, _ = cust_roles(spark, d)
    return rounded(Y.value_modes(real, "c_acctbal", 10))


_MODE_COLS = ["c_acctbal", "c_nationkey"]
_MODE_K, _MODE_PASSES = 5, 6


def modes_sql(src: str, cols, k: int, passes: int) -> str:
    """CTEs ending in ``md`` (column, mode, weight, mean, sd): expectation-maximisation
    with one group of CTEs a pass."""
    start = ", ".join(f"('{c}', {j}, {w!r}::DOUBLE, {mu!r}::DOUBLE, {sd!r}::DOUBLE)" for c in cols for j, (w, mu, sd) in enumerate(start_modes(k)))
    out = [f"""ml AS ({' UNION ALL '.join(f"SELECT '{c}' AS column, row_id, CAST({c} AS DOUBLE) AS v FROM {src} WHERE {c} IS NOT NULL" for c in cols)}),
mst AS (SELECT column, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM ml GROUP BY column),
mz AS MATERIALIZED (SELECT ml.column, ml.row_id, (v - m) / s AS z FROM ml JOIN mst ON ml.column = mst.column),
mp0(column, mode, w, mu, sd) AS (VALUES {start})"""]
    for i in range(1, passes + 1):
        out.append(f"""me{i} AS (SELECT z.column, z.row_id, z.z, p.mode, ln(p.w) - ln(p.sd) - pow((z.z - p.mu) / p.sd, 2) / 2 AS s
   FROM mz z JOIN mp{i - 1} p ON z.column = p.column),
mf{i} AS (SELECT *, exp(s - max(s) OVER (PARTITION BY column, row_id)) AS e FROM me{i}),
mr{i} AS (SELECT *, e / sum(e) OVER (PARTITION BY column, row_id) AS r FROM mf{i}),
mg{i} AS (SELECT column, mode, sum(r) AS r, sum(r * z) AS rz, sum(r * z * z) AS rzz FROM mr{i} GROUP BY column, mode),
mp{i} AS MATERIALIZED (SELECT p.column, p.mode, CASE WHEN g.r > 1e-9 THEN greatest(g.r / t.n, 1e-9) ELSE 1e-9 END AS w,
   CASE WHEN g.r > 1e-9 THEN g.rz / g.r ELSE p.mu END AS mu,
   CASE WHEN g.r > 1e-9 THEN sqrt(greatest(g.rzz / g.r - (g.rz / g.r) * (g.rz / g.r), 1e-6)) ELSE p.sd END AS sd
   FROM mp{i - 1} p JOIN mst t ON p.column = t.column LEFT JOIN mg{i} g ON g.column = p.column AND g.mode = p.mode)""")
    out.append(f"""md AS MATERIALIZED (SELECT p.column, p.mode, p.w / sum(p.w) OVER (PARTITION BY p.column) AS weight, p.mu * t.s + t.m AS mean, p.sd * t.s AS sd
   FROM mp{passes} p JOIN mst t ON p.column = t.column WHERE p.w >= 0.005)""")
    return ",\n".join(out)


def _mode_rows_sql(eps: float, n: int) -> str:
    """Rows of the two-column tree: the root's modes, then the child's given the root's."""
    root, child = _MODE_COLS
    lap = lambda scale, key: f"{scale!r} * sign({(u := dsql(SEED, 'noise', key))} - 0.5) * ln(1.0 - 2.0 * abs({u} - 0.5))"
    val = lambda c: (f"(b.lo + b.hi) / 2.0 + greatest(least(sqrt(-2.0 * ln({dsql(SEED, f'{c}|0|in', 'i.row_id')})) * "  # noqa: E731
                     f"cos({2.0 * math.pi!r} * {dsql(SEED, f'{c}|0|in2', 'i.row_id')}), 4.0), -4.0) * ((b.hi - b.lo) / 8.0)")
    cum = lambda keys: f"""sum(p) OVER (PARTITION BY {keys} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ch,
   row_number() OVER (PARTITION BY {keys} ORDER BY bin DESC) AS rl"""  # noqa: E731
    ends = lambda keys: f"coalesce(lag(ch) OVER (PARTITION BY {keys} ORDER BY bin), 0.0) AS cl, CASE WHEN rl = 1 THEN 1.0 ELSE ch END AS cu"
    share = lambda keys: f"CASE WHEN sum(noisy) OVER (PARTITION BY {keys}) > 0 THEN noisy / sum(noisy) OVER (PARTITION BY {keys}) ELSE 1.0 / count(*) OVER (PARTITION BY {keys}) END AS p"
    return f"""ba AS MATERIALIZED (SELECT column, row_id, mode AS bin FROM (SELECT ml.column, ml.row_id, md.mode, row_number() OVER (
   PARTITION BY ml.column, ml.row_id ORDER BY ln(md.weight) - ln(md.sd) - pow((ml.v - md.mean) / md.sd, 2) / 2 DESC, md.mode) AS rn
   FROM ml JOIN md ON ml.column = md.column) WHERE rn = 1),
bp AS (SELECT column, mode AS bin, mean - 4.0 * sd AS lo, mean + 4.0 * sd AS hi FROM md),
rn AS (SELECT p.bin, p.lo, p.hi, greatest(coalesce(c.n, 0) - {lap(2.0 / eps, f"('{root}|' || CAST(p.bin AS VARCHAR))")}, 0.0) AS noisy
   FROM bp p LEFT JOIN (SELECT bin, count(*) AS n FROM ba WHERE column = '{root}' GROUP BY bin) c ON p.bin = c.bin WHERE p.column = '{root}'),
rp AS (SELECT *, 1 AS one, {share('1')} FROM rn), rc AS (SELECT *, {cum('one')} FROM rp), rt AS MATERIALIZED (SELECT *, {ends('one')} FROM rc),
cc AS (SELECT a.bin AS pb, b.bin, count(*) AS n FROM ba a JOIN ba b ON a.row_id = b.row_id AND a.column = '{root}' AND b.column = '{child}' GROUP BY 1, 2),
cg AS (SELECT r.bin AS pb, p.bin, p.lo, p.hi FROM bp r, bp p WHERE r.column = '{root}' AND p.column = '{child}'),
cn AS (SELECT cg.*, greatest(coalesce(cc.n, 0) - {lap(3.0 / eps, f"('{child}|' || CAST(cg.pb AS VARCHAR) || '|' || CAST(cg.bin AS VARCHAR))")}, 0.0) AS noisy
   FROM cg LEFT JOIN cc ON cg.pb = cc.pb AND cg.bin = cc.bin),
cp AS (SELECT *, {share('pb')} FROM cn), cq AS (SELECT *, {cum('pb')} FROM cp), ct AS MATERIALIZED (SELECT *, {ends('pb')} FROM cq),
gi AS (SELECT range AS row_id FROM range({n})),
g1 AS (SELECT i.row_id, b.bin, {val(root)} AS {root} FROM gi i JOIN rt b ON {dsql(SEED, f'{root}|0', 'i.row_id')} >= b.cl AND {dsql(SEED, f'{root}|0', 'i.row_id')} < b.cu),
g2 AS (SELECT i.row_id, i.{root}, floor({val(child)} + 0.5) AS {child} FROM g1 i JOIN ct b ON b.pb = i.bin
   AND {dsql(SEED, f'{child}|0', 'i.row_id')} >= b.cl AND {dsql(SEED, f'{child}|0', 'i.row_id')} < b.cu)"""


@query("fit_value_modes", f"""WITH cust AS (SELECT c_custkey AS row_id, {', '.join(_MODE_COLS)} FROM customer),
{modes_sql('cust', _MODE_COLS, _MODE_K, _MODE_PASSES)}
SELECT column, mode, round(weight, 6) AS weight, round(mean, 6) AS mean, round(sd, 6) AS sd FROM md""")
def fit_value_modes_q(spark, d):
    """Modes of every numeric column in one expectation-maximisation."""
    real = T(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), *_MODE_COLS)
    return rounded(fit_value_modes(real, _MODE_COLS, _MODE_K, _MODE_PASSES, tol=0.0))


@query("generate_modes", f"""WITH cust AS (SELECT c_custkey AS row_id, {', '.join(_MODE_COLS)} FROM customer),
{modes_sql('cust', _MODE_COLS, _MODE_K, _MODE_PASSES)},
{_mode_rows_sql(8.0, 2000)}
SELECT row_id, {', '.join(f'round({c}, 6) AS {c}' for c in _MODE_COLS)} FROM g2""")
def generate_modes(spark, d):
    """Rows drawn by mode, then by value: a tree of tables over value modes."""
    real = T(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), *_MODE_COLS)
    model = Y.modes_fit(real, 8.0, SEED, _MODE_COLS, modes=_MODE_K, passes=_MODE_PASSES, tol=0.0)
    return rounded(Y.generate(model, 2000, SEED)).select("row_id", *_MODE_COLS)


_PRIVATE = ["c_mktsegment", "c_nationkey"]  # the first is the tree's root


def _private_parts(eps: float) -> tuple[float, dict]:
    """(what is left for the tables, what each step spends)."""
    spent = {s: PV.SHARES[s] * eps for s in ("rows", "edges", "categories", "tree")}
    left = eps
    for s in spent.values():
        left -= s
    return left, spent


def _private_sql(eps: float) -> str:
    left, spent = _private_parts(eps)
    lap = lambda scale, key: f"{scale!r} * sign({(u := dsql(SEED, 'noise', key))} - 0.5) * ln(1.0 - 2.0 * abs({u} - 0.5))"
    one_edge, one_cat, per_table = 1 / spent["edges"], 1 / spent["categories"], 2 / left
    top = PV.MOST_POWER - PV.LEAST_POWER + 1
    edge_least = one_edge * math.log((2 * top + 1) / (2 * PV.FALSE_EDGE))
    cat_least = 1.0 + one_cat * math.log(1 / (2.0 * PV.DELTA))
    shares = lambda keys: f"""CASE WHEN sum(noisy) OVER (PARTITION BY {keys}) > 0 THEN noisy / sum(noisy) OVER (PARTITION BY {keys})
   ELSE 1.0 / count(*) OVER (PARTITION BY {keys}) END AS p"""  # noqa: E731
    return f"""WITH {CUST_ENC},
pn AS (SELECT CAST(floor(greatest(count(*) - {lap(1 / spent['rows'], "'rows'")}, 1.0) + 0.5) AS BIGINT) AS n_train FROM cust_enc),
pe AS (SELECT CAST(CASE WHEN c_nationkey = 0 THEN 0 ELSE sign(c_nationkey) * (greatest(least(floor(log2(abs(c_nationkey))), 60), -40) + 41) END AS BIGINT) AS b,
   count(*) AS n FROM cust_enc GROUP BY 1),
pg AS (SELECT g.b FROM (SELECT unnest(generate_series({-top}, {top})) AS b) g LEFT JOIN pe ON g.b = pe.b
   WHERE greatest(coalesce(pe.n, 0) - {lap(one_edge, "('c_nationkey|edge|' || CAST(g.b AS VARCHAR))")}, 0.0) > {edge_least!r}),
pr AS (SELECT CASE WHEN lo = 0 THEN 0.0 WHEN lo > 0 THEN pow(2, lo - 41) ELSE -pow(2, abs(lo) - 40) END AS lo,
   CASE WHEN hi = 0 THEN 0.0 WHEN hi > 0 THEN pow(2, hi - 40) ELSE -pow(2, abs(hi) - 41) END AS hi FROM (SELECT min(b) AS lo, max(b) AS hi FROM pg)),
pc AS (SELECT v, CAST(round(v * 1e6) AS BIGINT) AS bin FROM (SELECT c_mktsegment AS v, count(*) AS n FROM cust_enc GROUP BY 1)
   WHERE greatest(n - {lap(one_cat, "('c_mktsegment|cat|' || CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR))")}, 0.0) > {cat_least!r}),
pb AS (SELECT pc.bin AS rb, CAST(least(floor((greatest(least(c_nationkey, hi), lo) - lo) * 10.0 / (hi - lo)), 9) AS BIGINT) AS cb
   FROM cust_enc CROSS JOIN pr LEFT JOIN pc ON c_mktsegment = pc.v),
pt AS (SELECT pc.v, pc.bin, greatest(coalesce(c.n, 0) - {lap(per_table, "('c_mktsegment|root|' || CAST(pc.bin AS VARCHAR))")}, 0.0) AS noisy, 1 AS one
   FROM pc LEFT JOIN (SELECT rb, count(*) AS n FROM pb GROUP BY rb) c ON pc.bin = c.rb),
pu AS (SELECT pc.bin AS parent_bin, k.b AS bin, lo + k.b * ((hi - lo) / 10) AS bin_lo, lo + (k.b + 1) * ((hi - lo) / 10) AS bin_hi,
   greatest(coalesce(c.n, 0) - {lap(per_table, "('c_nationkey|' || CAST(pc.bin AS VARCHAR) || '|' || CAST(k.b AS VARCHAR))")}, 0.0) AS noisy
   FROM pc CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS b) k CROSS JOIN pr
   LEFT JOIN (SELECT rb, cb, count(*) AS n FROM pb GROUP BY rb, cb) c ON pc.bin = c.rb AND k.b = c.cb),
pm AS (SELECT 'c_mktsegment' AS column, 'cat' AS kind, NULL AS parent, NULL::BIGINT AS parent_bin, bin, v::DOUBLE AS bin_lo, v::DOUBLE AS bin_hi, noisy, {shares('one')} FROM pt
   UNION ALL SELECT 'c_nationkey', 'hist', 'c_mktsegment', parent_bin, bin, bin_lo, bin_hi, noisy, {shares('parent_bin')} FROM pu)
SELECT column, kind, parent, parent_bin, bin, round(bin_lo, 6) AS bin_lo, round(bin_hi, 6) AS bin_hi, round(noisy, 6) AS noisy, round(p, 6) AS p, n_train FROM pm, pn"""


@query("private_fit", _private_sql(8.0))
def private_fit_q(spark, d):
    """Ranges, categories, tree and tables, each from its part of epsilon."""
    model, _ = PV.private_fit(cust_enc(spark, d), 8.0, SEED, _PRIVATE)
    return rounded(model.select("column", "kind", "parent", "parent_bin", "bin", "bin_lo", "bin_hi", "noisy", "p", "n_train"))


@query("privacy_ledger", f"""SELECT step, detail, epsilon::DOUBLE AS epsilon, delta::DOUBLE AS delta FROM (VALUES ('rows', 'number of rows', {0.05 * 4!r}, 0.0), ('edges', 'c_acctbal', {0.1 * 4!r}, 0.0),
('categories', 'c_mktsegment', {0.1 * 4!r}, 1e-06), ('tree', '2 edges', {0.25 * 4!r}, 0.0), ('tables', '3 tables', 2.0, 0.0)) t(step, detail, epsilon, delta)
WHERE EXISTS (SELECT 1 FROM customer)""")
def privacy_ledger(spark, d):
    """What each step of a private fit spent; nations have a declared range."""
    _, ledger = PV.private_fit(cust_enc(spark, d), 4.0, SEED, FEATS, domain={"c_nationkey": (0, 25)})
    return rounded(ledger.table(spark).drop("delta")).join(ledger.table(spark).select("step", "delta"), "step").select("step", "detail", "epsilon", "delta")


def _adj_sql(seed=SEED) -> str:
    off = dsql(seed, "offset", "('c_acctbal|' || CAST(bin AS VARCHAR))")
    return f"""WITH {CUST_ENC}, {roles_sql()},
prof AS (SELECT least(10, count(DISTINCT c_acctbal)) AS k, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM real),
rb AS (SELECT CAST(least(greatest(floor((c_acctbal - lo) * CAST(k AS DOUBLE) / (hi - lo)), 0), k - 1) AS BIGINT) AS bin FROM real, prof),
sb AS (SELECT syn.*, CAST(least(greatest(floor((c_acctbal - lo) * CAST(k AS DOUBLE) / (hi - lo)), 0), k - 1) AS BIGINT) AS bin FROM syn, prof),
nr AS (SELECT bin, count(*) AS nr FROM rb GROUP BY bin), ns AS (SELECT bin, count(*) AS ns FROM sb GROUP BY bin),
w AS (SELECT nr.bin, (nr / (SELECT count(*) FROM real)) / (ns / (SELECT count(*) FROM syn)) AS w FROM nr JOIN ns ON nr.bin = ns.bin),
r AS (SELECT sb.*, w.w, row_number() OVER (PARTITION BY sb.bin ORDER BY sb.row_id) - 1 AS r FROM sb JOIN w ON sb.bin = w.bin),
c AS (SELECT *, CAST(floor(w * (r + 1) + {off}) - floor(w * r + {off}) AS INTEGER) AS copies FROM r)
SELECT row_id, c_nationkey, c_acctbal, c_mktsegment, unnest(generate_series(1, copies)) AS _copy FROM c WHERE copies > 0"""


@query("adjust_marginals", _adj_sql())
def adjust_marginals(spark, d):
    real, syn = cust_roles(spark, d)
    out = Y.adjust_marginals(syn, real, "c_acctbal", SEED)
    return out.select("row_id", "c_nationkey", "c_acctbal", "c_mktsegment", F.col("_copy").cast("long").alias("_copy"))


@query("guard_identifiable", f"""WITH {CUST_ENC}, {roles_sql()},
p AS (SELECT s.row_id, r.row_id AS nn, {dist_sql('s', 'r', FEATS)} AS d FROM syn s, real r),
nn AS (SELECT row_id, arg_min(nn, (d, nn)) AS nn_id, min(d) AS d_gen FROM p GROUP BY row_id),
own AS (SELECT a.row_id, min({dist_sql('a', 'b', FEATS)}) AS d_own FROM real a, real b WHERE a.row_id <> b.row_id GROUP BY a.row_id),
bad AS (SELECT nn.row_id FROM nn JOIN own ON nn.nn_id = own.row_id WHERE d_gen < 0.5 * d_own)
SELECT * FROM syn WHERE row_id NOT IN (SELECT row_id FROM bad)""")
def guard_identifiable(spark, d):
    real, syn = cust_roles(spark, d)
    return Y.guard_identifiable(syn, real, FEATS, 0.5)


@query("ads_generate")
def ads_generate(spark, d):
    real, _ = cust_roles(spark, d)
    model = Y.ads_fit(real, 2.0, SEED, FEATS)
    return rounded(Y.ads_generate(model, real, 500, SEED, weight=0.5, cols=FEATS))


def _log_frequency_sql(brand: str) -> str:
    return f"""WITH
l AS (SELECT p_partkey AS row_id, 'p_brand' AS column, {brand} AS category FROM part
      UNION ALL SELECT p_partkey, 'p_type', p_type FROM part),
cats AS (SELECT column, category, count(*) AS size FROM l GROUP BY column, category),
pm AS (SELECT *, ln(1 + size) / sum(ln(1 + size)) OVER (PARTITION BY column) AS p FROM cats),
cm AS (SELECT *, sum(p) OVER (PARTITION BY column ORDER BY category NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ch,
              row_number() OVER (PARTITION BY column ORDER BY category DESC NULLS LAST) AS rl FROM pm),
pmf AS (SELECT column, category, size, coalesce(lag(ch) OVER (PARTITION BY column ORDER BY category NULLS FIRST), 0.0) AS cum_lo,
               CASE WHEN rl = 1 THEN 1.0 ELSE ch END AS cum_hi FROM cm),
s AS (SELECT range AS sample_id,
        CASE WHEN CAST(floor({dsql(SEED, 'col', 'range')} * 2) AS INTEGER) = 0 THEN 'p_brand' ELSE 'p_type' END AS column,
        {dsql(SEED, 'cat', 'range')} AS u, {dsql(SEED, 'row', 'range')} AS w FROM range(1000)),
pick AS (SELECT s.sample_id, s.column, pmf.category, CAST(floor(s.w * pmf.size) AS BIGINT) AS rk
         FROM s JOIN pmf ON s.column = pmf.column AND s.u >= pmf.cum_lo AND s.u < pmf.cum_hi),
rl AS (SELECT *, row_number() OVER (PARTITION BY column, category ORDER BY row_id) - 1 AS rk FROM l)
SELECT pick.sample_id, pick.column, pick.category, rl.row_id FROM pick JOIN rl
  ON pick.column = rl.column AND pick.category IS NOT DISTINCT FROM rl.category AND pick.rk = rl.rk"""


@query("log_frequency_sample", _log_frequency_sql("p_brand"))
def log_frequency_sample(spark, d):
    part = T(spark, d, "part").withColumnRenamed("p_partkey", "row_id")
    return Y.log_frequency_sample(part, ["p_brand", "p_type"], 1000, SEED)


@query("log_frequency_sample_nulls", _log_frequency_sql("CASE WHEN p_size >= 10 THEN p_brand END"))
def log_frequency_sample_nulls(spark, d):
    """Null is a category: no sample is lost."""
    part = T(spark, d, "part").withColumnRenamed("p_partkey", "row_id")
    part = part.withColumn("p_brand", F.when(F.col("p_size") >= 10, F.col("p_brand")))
    return Y.log_frequency_sample(part, ["p_brand", "p_type"], 1000, SEED)


def _rules(spark):
    from mirage.operators.prep import RULE_SCHEMA
    return spark.createDataFrame([("c_acctbal", "gt", None, 0.0), ("c_nationkey", "lt", None, 20.0)], RULE_SCHEMA)


def _batches_sql(count: int, distinct: bool) -> str:
    """The first ``count`` accepted rows of whole draws, which four draws hold."""
    draws = ", ".join(gen_sql("m_model", count, SEED, FEATS, attempt=str(i), prefix=f"g{i}") for i in range(4))
    union = " UNION ALL ".join(f"SELECT {i} AS batch, * FROM g{i}_t WHERE c_acctbal > 0 AND c_nationkey < 20" for i in range(4))
    once = f"QUALIFY row_number() OVER (PARTITION BY {', '.join(FEATS)} ORDER BY batch, row_id) = 1" if distinct else ""
    return f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, 2.0, SEED)}, {draws}, u AS ({union}), k AS (SELECT * FROM u {once}),
f AS (SELECT * FROM k ORDER BY batch, row_id LIMIT {count})
SELECT (row_number() OVER (ORDER BY batch, row_id) - 1)::BIGINT AS row_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATS)} FROM f"""


@query("generate_constrained", _batches_sql(600, True))
def generate_constrained(spark, d):
    real, _ = cust_roles(spark, d)
    model = Y.dp_fit(real, 2.0, SEED, FEATS)
    return rounded(Y.generate_constrained(model, 600, _rules(spark), SEED, strict=True))


@query("accumulate", _batches_sql(800, False))
def accumulate_q(spark, d):
    real, _ = cust_roles(spark, d)
    model = Y.dp_fit(real, 2.0, SEED, FEATS)
    from mirage.operators.prep import match_constraints
    rules = _rules(spark)
    return rounded(Y.accumulate(lambda i, n: match_constraints(Y.generate(model, n, SEED, attempt=i), rules), 800))


_EV = """ev AS (SELECT user_id, event_id, event_type, value, {u} AS u FROM events)""".format(u=dsql(SEED, "split", "event_id"))


@query("stack_sequences", f"""WITH {_EV},
b0 AS (SELECT * FROM ev WHERE u >= 0.5), b1 AS (SELECT * FROM ev WHERE u < 0.5),
s AS (SELECT user_id, event_id, event_type, value FROM b0
      UNION ALL SELECT user_id + (SELECT max(user_id) + 1 FROM b0), event_id, event_type, value FROM b1),
k AS (SELECT DISTINCT user_id FROM s ORDER BY user_id LIMIT 200)
SELECT * FROM s WHERE user_id IN (SELECT user_id FROM k)""")
def stack_sequences(spark, d):
    ev = T(spark, d, "events").select("user_id", "event_id", "event_type", "value").withColumn(
        "_u", draw(SEED, "split", F.col("event_id")))
    b0 = ev.filter(F.col("_u") >= 0.5).drop("_u")
    b1 = ev.filter(F.col("_u") < 0.5).drop("_u")
    return Y.stack_sequences([b0, b1], "user_id", 200)


# --- merging --------------------------------------------------------------------------

SUP_COLS = ["s_nationkey", "s_acctbal"]


def _sup_roles(spark, d):
    sup = T(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), *SUP_COLS)
    return roles(sup)


_SUP = f"""sup AS (SELECT s_suppkey AS row_id, s_nationkey, s_acctbal FROM supplier),
cur AS (SELECT * FROM sup WHERE {dsql(ROLE_SEED, 'role', 'row_id')} < 0.5),
don AS (SELECT * FROM sup WHERE {dsql(ROLE_SEED, 'role', 'row_id')} >= 0.5)"""


@query("privacy_merge_step", f"""WITH {_SUP},
j1 AS (SELECT a.row_id, avg({dist_sql('a', 'b', SUP_COLS)}) AS m FROM cur a, cur b GROUP BY a.row_id),
j2 AS (SELECT a.row_id, avg({dist_sql('a', 'b', SUP_COLS)}) AS m FROM don a, cur b GROUP BY a.row_id),
alike AS (SELECT row_id FROM j1 ORDER BY m, row_id LIMIT 5),
unlike AS (SELECT row_id FROM j2 ORDER BY m DESC, row_id LIMIT 5),
u AS (SELECT 0 AS src, * FROM cur WHERE row_id NOT IN (SELECT row_id FROM alike)
      UNION ALL SELECT 1, * FROM don WHERE row_id IN (SELECT row_id FROM unlike))
SELECT (row_number() OVER (ORDER BY src, row_id) - 1)::BIGINT AS row_id, s_nationkey, s_acctbal FROM u""")
def privacy_merge_step(spark, d):
    cur, donor = _sup_roles(spark, d)
    return G.privacy_merge_step(cur, donor, 50, 0.1, SUP_COLS)


@query("donor_gate", f"""WITH {CUST_ENC}, {roles_sql()},
p AS (SELECT b.c_mktsegment AS donor, a.row_id, min({dist_sql('a', 'b', FEATS)}) AS d FROM real a, syn b GROUP BY 1, 2),
s AS (SELECT donor, CASE WHEN max(d) = min(d) THEN 0.0 ELSE (avg(d) - min(d)) / (max(d) - min(d)) END AS score FROM p GROUP BY donor),
c AS (SELECT a.row_id, min({dist_sql('a', 'b', FEATS)}) AS d FROM real a, syn b GROUP BY a.row_id),
cs AS (SELECT CASE WHEN max(d) = min(d) THEN 0.0 ELSE (avg(d) - min(d)) / (max(d) - min(d)) END AS score FROM c)
SELECT donor, round(score, 6) AS score FROM s WHERE score >= (SELECT score FROM cs)""")
def donor_gate(spark, d):
    real, syn = cust_roles(spark, d)
    cur = M.nearest_neighbor_distance(real, syn, FEATS).first()[0]
    donors = syn.withColumn("donor", F.col("c_mktsegment"))
    scores = M.nearest_neighbor_distance(real, donors, FEATS, by=["donor"]).withColumnRenamed(
        "nearest_neighbor_distance", "score")
    return rounded(G.donor_gate(cur, scores))


def _fill_inputs(spark, d):
    real, syn = cust_roles(spark, d)
    return real, syn.filter(F.col("c_acctbal") > 3000), syn.filter(F.col("c_acctbal") <= 3000)


def _bins_sql(src: str) -> str:
    return f"""(SELECT {src}.*, CASE WHEN c_acctbal >= lo AND c_acctbal <= hi THEN
        lo + CAST(least(floor((c_acctbal - lo) * CAST(k AS DOUBLE) / (hi - lo)), k - 1) AS DOUBLE) * ((hi - lo) / CAST(k AS DOUBLE)) END AS bin
        FROM {src}, prof)"""


_FILL_BASE = f"""{CUST_ENC}, {roles_sql()}, cur AS (SELECT * FROM syn WHERE c_acctbal > 3000),
don AS (SELECT * FROM syn WHERE c_acctbal <= 3000),
{freqs_sql('real', 'cur', ['c_acctbal'])},
prof AS (SELECT least(10, count(DISTINCT c_acctbal)) AS k, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM real),
n AS (SELECT count(*) AS n FROM cur)"""


@query("fill_bins", f"""WITH {_FILL_BASE},
need AS (SELECT bin, CAST(ceil((p_real - 0.05 - p_syn) * (SELECT n FROM n)) AS BIGINT) AS need FROM f_al WHERE p_syn < p_real - 0.05),
db AS {_bins_sql('don')},
q AS (SELECT need.bin, least(c.have, need.need) AS q FROM need JOIN (SELECT bin, count(*) AS have FROM db GROUP BY bin) c ON need.bin = c.bin),
picked AS (SELECT row_id, c_nationkey, c_acctbal, c_mktsegment FROM
           (SELECT db.*, q.q, row_number() OVER (PARTITION BY db.bin ORDER BY db.row_id) AS rn FROM db JOIN q ON db.bin = q.bin) WHERE rn <= q),
dropped AS (SELECT row_id FROM cur ORDER BY {dsql(SEED, 'drop', 'row_id')}, row_id LIMIT (SELECT count(*) FROM picked)),
u AS (SELECT 0 AS src, * FROM cur WHERE row_id NOT IN (SELECT row_id FROM dropped) UNION ALL SELECT 1, * FROM picked)
SELECT (row_number() OVER (ORDER BY src, row_id) - 1)::BIGINT AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM u""")
def fill_bins(spark, d):
    real, cur, donor = _fill_inputs(spark, d)
    return G.fill_bins(cur, donor, real, "c_acctbal", SEED, 0.05)


@query("thin_bins", f"""WITH {_FILL_BASE},
over AS (SELECT bin, CAST(ceil((p_syn - p_real - 0.05) * (SELECT n FROM n)) AS BIGINT) AS x FROM f_al WHERE p_syn > p_real + 0.05),
cb AS {_bins_sql('cur')},
q AS (SELECT over.bin, least(c.have, over.x) AS q FROM over JOIN (SELECT bin, count(*) AS have FROM cb GROUP BY bin) c ON over.bin = c.bin),
removed AS (SELECT row_id FROM (SELECT cb.*, q.q, row_number() OVER (PARTITION BY cb.bin ORDER BY cb.row_id) AS rn
            FROM cb JOIN q ON cb.bin = q.bin) WHERE rn <= q),
fb AS (SELECT * FROM {_bins_sql('real')} WHERE bin IS NULL OR bin NOT IN (SELECT bin FROM q)),
added AS (SELECT row_id, c_nationkey, c_acctbal, c_mktsegment FROM fb ORDER BY row_id LIMIT (SELECT count(*) FROM removed)),
u AS (SELECT 0 AS src, * FROM cur WHERE row_id NOT IN (SELECT row_id FROM removed) UNION ALL SELECT 1, * FROM added)
SELECT (row_number() OVER (ORDER BY src, row_id) - 1)::BIGINT AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM u""")
def thin_bins(spark, d):
    real, cur, _ = _fill_inputs(spark, d)
    return G.thin_bins(cur, real, real, "c_acctbal", 0.05)


def _merging(spark, d, start_eps: float, donor_eps: list, size: int):
    """(start table, donors, scorer) from models of the real customers."""
    real, _ = cust_roles(spark, d)
    start = Y.generate(Y.dp_fit(real, start_eps, SEED, FEATS), size, SEED)
    donors = [lambda a, m=Y.dp_fit(real, e, SEED + i, FEATS): Y.generate(m, size, SEED, attempt=a) for i, e in enumerate(donor_eps)]
    return start, donors, TM.Scorer(real, FEATS)


def _merged(out: DataFrame | None, history: DataFrame, size: int, needs: list) -> DataFrame:
    """What a merge has to keep, as one row: size, requirements met by the returned
    table's own scores, some round won, utility or privacy not below the start."""
    rounds = {r["round"] for r in history.collect()}  # a few rows per round
    start = history.filter("step = 'start'").first()
    won = history.filter("chosen").orderBy(F.desc("round")).first()
    rows = -1 if out is None else out.count()
    return history.sparkSession.createDataFrame(
        [(out is not None, rows == size, won["step"] != "start", won["shortfall"] == 0.0, won["shortfall"] <= start["shortfall"], len(rounds) <= TM.MAX_ROUNDS)],
        "found boolean, size_kept boolean, merged boolean, met boolean, not_worse boolean, in_rounds boolean")


_MERGED_SQL = "SELECT true AS found, true AS size_kept, true AS merged, true AS met, true AS not_worse, true AS in_rounds"


@query("increase_privacy", _MERGED_SQL)
def increase_privacy(spark, d):
    start, donors, scorer = _merging(spark, d, 8.0, [0.1, 0.05], 300)
    base = scorer.score(start.withColumn("t", F.lit(0)), ["t"])[(0,)]["nearestneighbordistance"]
    out, history = TM.increase_privacy(start, donors, TM.Requirement("nearestneighbordistance", base + 0.03, 0.028), scorer, 300, SEED)
    return _merged(out, history, 300, [])


@query("increase_utility", _MERGED_SQL)
def increase_utility(spark, d):
    start, donors, scorer = _merging(spark, d, 0.05, [8.0, 4.0], 300)
    base = scorer.score(start.withColumn("t", F.lit(0)), ["t"])[(0,)]["inversekldivergence"]
    out, history = TM.increase_utility(start, donors, TM.Requirement("inversekldivergence", base + 0.04, 0.01), scorer, 300, SEED)
    return _merged(out, history, 300, [])


@query("create_by_merging", _MERGED_SQL)
def create_by_merging(spark, d):
    start, donors, scorer = _merging(spark, d, 0.05, [8.0, 0.5], 300)
    base = scorer.score(start.withColumn("t", F.lit(0)), ["t"])[(0,)]
    out, history = TM.merge_tables(start, donors, scorer, 300,
                                   TM.Requirement("nearestneighbordistance", base["nearestneighbordistance"] - 0.05, 0.05),
                                   TM.Requirement("inversekldivergence", base["inversekldivergence"] + 0.05, 0.01), "merge", SEED)
    return _merged(out, history, 300, [])


# --- extension points (E2, E3) ---------------------------------------------------------

def _bootstrap_fit(df, seed=0, **kw):
    """A user synthesizer: per-column empirical marginals (exact counts)."""
    return Y.dp_fit(df, None, seed, kw.get("cols"), family="bootstrap")


@query("user_synthesizer", f"""WITH {CUST_ENC}, {roles_sql()}, {dp_sql('real', FEATS, None, SEED)}, {gen_sql('m_model', 500, SEED, FEATS)}
SELECT row_id, {', '.join(f'round({c}, 6) AS {c}' for c in FEATS)} FROM g_t""")
def user_synthesizer(spark, d):
    from mirage.plans import registry as REG
    from mirage.sources.io import Store
    from mirage.plans.catalog import scratch
    REG.register_synthesizer("bootstrap", _bootstrap_fit, Y.generate)
    fit, gen = REG.synthesizer("bootstrap")
    real, _ = cust_roles(spark, d)
    model = fit(real, seed=SEED, cols=FEATS)
    store = Store(spark, scratch(spark, "store"))
    store.save_model(model, "bootstrap", "boot")
    return rounded(gen(store.load_model("boot", "bootstrap"), 500, SEED))


def _donor_table(cur, donors, n_donors, k, scorer, seed):
    """A technique of a user: each donor's whole table is the proposal."""
    return donors.select("donor", "row_id", *scorer.cols)


@query("user_technique", _MERGED_SQL)
def user_technique(spark, d):
    """A merge technique registered by name and looked up by the rounds."""
    from mirage.plans import registry as REG
    REG.register_technique("donor", _donor_table, _donor_table)
    start, donors, scorer = _merging(spark, d, 0.05, [8.0], 200)
    base = scorer.score(start.withColumn("t", F.lit(0)), ["t"])[(0,)]["inversekldivergence"]
    out, history = TM.increase_utility(start, donors, TM.Requirement("inversekldivergence", base + 0.04, 0.01), scorer, 200, SEED, "donor")
    return _merged(out, history, 200, [])
