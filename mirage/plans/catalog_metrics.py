"""Catalog: privacy and utility metrics (M1-M9) and the metric registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirage.functions.draws import draw
from mirage.operators import distance as D
from mirage.operators import metrics as M
from mirage.plans import registry as REG
from mirage.plans.catalog import (CUST_ENC, FEATS, ROLE_SEED, T, roles, cust_enc, cust_roles, dist_sql, dsql, freqs_sql,
                                  query, roles_sql, rounded)

BASE = f"{CUST_ENC}, {roles_sql()}"

NN_SQL = f"""nn_d AS (SELECT a.row_id, min({dist_sql('a', 'b', FEATS)}) AS dist FROM real a, syn b GROUP BY a.row_id),
nn_s AS (SELECT avg(dist) m, min(dist) lo, max(dist) hi FROM nn_d),
m_nn AS (SELECT CASE WHEN hi = lo THEN 0.0 ELSE (m - lo) / (hi - lo) END AS v FROM nn_s)"""

KL_SQL = f"""{freqs_sql('real', 'syn', FEATS, prefix='k')},
kl_c AS (SELECT column, sum(p_real * ln(p_real / p_syn)) / sum(p_real) + ln(sum(p_syn) / sum(p_real)) AS kl
         FROM k_al GROUP BY column),
m_kl AS (SELECT avg(1.0 / (1.0 + kl)) AS v FROM kl_c)"""


@query("metric_nn", f"WITH {BASE}, {NN_SQL} SELECT round(v, 6) AS nearest_neighbor_distance FROM m_nn")
def metric_nn(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(M.nearest_neighbor_distance(real, syn, FEATS))


def _ident_sql(real_x: str, syn_x: str, name: str) -> str:
    return f"""ds AS (SELECT a.row_id, min({dist_sql('a', 'b', FEATS)}) AS d FROM {real_x} a, {syn_x} b GROUP BY a.row_id),
dr AS (SELECT a.row_id, min({dist_sql('a', 'b', FEATS)}) AS d FROM {real_x} a, {real_x} b WHERE a.row_id <> b.row_id GROUP BY a.row_id)
SELECT round(coalesce(avg(CASE WHEN ds.d < dr.d THEN 1.0 ELSE 0.0 END), 0.0), 6) AS {name}
FROM ds JOIN dr ON ds.row_id = dr.row_id"""


_ENT = f"""{freqs_sql('real', 'syn', FEATS, prefix='e')},
ent AS (SELECT column, -sum(p * ln(p)) AS h FROM e_r_f WHERE p > 0 GROUP BY column),
w AS (SELECT {', '.join(f"max(CASE WHEN column = '{c}' THEN CASE WHEN h <> 0 THEN 1.0 / h ELSE 0.0 END END) AS w_{c}" for c in FEATS)} FROM ent),
rw AS (SELECT row_id, {', '.join(f'CAST({c} AS DOUBLE) * w_{c} AS {c}' for c in FEATS)} FROM real, w),
sw AS (SELECT row_id, {', '.join(f'CAST({c} AS DOUBLE) * w_{c} AS {c}' for c in FEATS)} FROM syn, w)"""


@query("metric_ident", f"WITH {BASE}, {_ENT}, {_ident_sql('rw', 'sw', 'identifiability')}")
def metric_ident(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(M.identifiability(real, syn, FEATS))


_Z = f"""st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in FEATS)} FROM real),
rz AS (SELECT row_id, {', '.join(f'CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 0.0 ELSE (CAST({c} AS DOUBLE) - m_{c}) / s_{c} END AS {c}' for c in FEATS)} FROM real, st),
sz AS (SELECT row_id, {', '.join(f'CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 0.0 ELSE (CAST({c} AS DOUBLE) - m_{c}) / s_{c} END AS {c}' for c in FEATS)} FROM syn, st)"""


@query("metric_ident_oc", f"WITH {BASE}, {_Z}, {_ident_sql('rz', 'sz', 'identifiability_oc')}")
def metric_ident_oc(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(M.identifiability_oc(real, syn, FEATS))


@query("metric_ident_pca")
def metric_ident_pca(spark, d):
    """In the plane of the two leading principal axes of the real rows."""
    real, syn = cust_roles(spark, d)
    return rounded(M.identifiability_oc(real, syn, FEATS, pca=2))


def _so_sql(syn: str, target: str, prefix: str, cols=("c_nationkey", "c_acctbal", "c_mktsegment")) -> str:
    def long_form(src):
        return " UNION ALL ".join(f"SELECT '{c}' AS column, CAST({c} AS DOUBLE) AS v FROM {src}" for c in cols)
    key = "md5(concat_ws('|', column, op, coalesce(CAST(TRY_CAST(round(v * 1000000.0) AS BIGINT) AS VARCHAR), 'w' || CAST(TRY_CAST(round(v) AS HUGEINT) AS VARCHAR), 'null')))"
    return f"""{prefix}_sl AS ({long_form(syn)}), {prefix}_tl AS ({long_form(target)}),
{prefix}_p AS (
  SELECT column, 'eq' AS op, v FROM {prefix}_sl WHERE v IS NOT NULL GROUP BY column, v HAVING count(*) = 1
  UNION ALL SELECT column, 'le', min(v) FROM {prefix}_sl GROUP BY column HAVING min(v) IS NOT NULL
  UNION ALL SELECT column, 'ge', max(v) FROM {prefix}_sl GROUP BY column HAVING max(v) IS NOT NULL
  UNION ALL SELECT column, 'null', NULL FROM {prefix}_sl GROUP BY column HAVING sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) = 1),
{prefix}_a AS (SELECT *, {key} AS key FROM {prefix}_p ORDER BY key, column, op, v LIMIT 500),
{prefix}_m AS (SELECT a.key, (SELECT count(*) FROM {prefix}_tl t WHERE t.column = a.column AND
        CASE a.op WHEN 'eq' THEN t.v = a.v WHEN 'le' THEN t.v <= a.v WHEN 'ge' THEN t.v >= a.v ELSE t.v IS NULL END) AS m
    FROM {prefix}_a a),
{prefix}_r AS (SELECT count(*) AS n, coalesce(sum(CASE WHEN m = 1 THEN 1 ELSE 0 END), 0) AS s FROM {prefix}_m),
{prefix}_risk AS (SELECT n, s, CASE WHEN n = 0 THEN 0.0 ELSE (s + 1.959964 * 1.959964 / 2) / (n + 1.959964 * 1.959964) END AS risk FROM {prefix}_r)"""


@query("metric_singling_out", f"""WITH {BASE}, {_so_sql('syn', 'real', 'so')}
SELECT round(risk, 6) AS singling_out, n::BIGINT AS n_attacks, s::BIGINT AS n_success FROM so_risk""")
def metric_singling_out(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(M.singling_out(real, syn, FEATS))


_STAMPED = f"""o AS (SELECT o_orderkey AS row_id, epoch_us(o_orderdate) + o_orderkey * 1000003 AS stamp, o_totalprice FROM orders),
real AS (SELECT * FROM o WHERE {dsql(ROLE_SEED, 'role', 'row_id')} < 0.5), syn AS (SELECT * FROM o WHERE {dsql(ROLE_SEED, 'role', 'row_id')} >= 0.5)"""


@query("singling_out_timestamp", f"""WITH {_STAMPED}, {_so_sql('syn', 'real', 'so', ('stamp', 'o_totalprice'))}
SELECT column, op, count(*) AS n FROM so_a GROUP BY column, op""")
def singling_out_timestamp(spark, d):
    """Which predicates the attacks test on a table with a microsecond stamp."""
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 1000003).alias("stamp"), "o_totalprice")
    _, syn = roles(o)
    return M.singling_out_attacks(syn, ["stamp", "o_totalprice"]).groupBy("column", "op").agg(F.count(F.lit(1)).alias("n"))


@query("distance_nearest_nulls", f"""WITH {CUST_ENC}, {roles_sql()},
a AS (SELECT row_id, CASE WHEN row_id % 13 = 0 THEN NULL ELSE c_acctbal END AS x, c_nationkey AS y FROM real),
b AS (SELECT row_id, CASE WHEN row_id % 11 = 0 THEN NULL ELSE c_acctbal END AS x, c_nationkey AS y FROM syn)
SELECT path, a.row_id, round(min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS dist
FROM a, b, (SELECT unnest(['broadcast', 'blocked']) AS path) GROUP BY path, a.row_id""")
def distance_nearest_nulls(spark, d):
    """Both paths with nulls on both sides."""
    real, syn = cust_roles(spark, d)
    a = real.select("row_id", F.when(F.col("row_id") % 13 != 0, F.col("c_acctbal")).alias("x"), F.col("c_nationkey").alias("y"))
    b = syn.select("row_id", F.when(F.col("row_id") % 11 != 0, F.col("c_acctbal")).alias("x"), F.col("c_nationkey").alias("y"))
    outs = []
    for path, limit in (("broadcast", "67108864"), ("blocked", "1000")):
        spark.conf.set("mirage.distance.broadcastBytes", limit)
        try:
            outs.append(D.nearest_distance(a, b, ["x", "y"]).select(F.lit(path).alias("path"), "row_id", "dist"))
        finally:
            spark.conf.unset("mirage.distance.broadcastBytes")
    return rounded(outs[0].unionByName(outs[1]))


def _three(spark, d):
    c = cust_enc(spark, d)
    u = draw(ROLE_SEED, "role", F.col("row_id"))
    return c.filter(u < 0.35), c.filter((u >= 0.35) & (u < 0.5)), c.filter(u >= 0.5)


_U = dsql(ROLE_SEED, "role", "row_id")


@query("metric_singling_out_control", f"""WITH {CUST_ENC},
real AS (SELECT * FROM cust_enc WHERE {_U} < 0.35), ctl AS (SELECT * FROM cust_enc WHERE {_U} >= 0.35 AND {_U} < 0.5),
syn AS (SELECT * FROM cust_enc WHERE {_U} >= 0.5),
{_so_sql('syn', 'real', 'so')}, {_so_sql('syn', 'ctl', 'sc')}
SELECT round(least(greatest(CASE WHEN c.risk >= 1 THEN 0.0 ELSE (r.risk - c.risk) / (1.0 - c.risk) END, 0.0), 1.0), 6) AS singling_out,
       r.n::BIGINT AS n_attacks, r.s::BIGINT AS n_success FROM so_risk r, sc_risk c""")
def metric_singling_out_control(spark, d):
    real, ctl, syn = _three(spark, d)
    return rounded(M.singling_out(real, syn, FEATS, control=ctl))


@query("metric_inverse_kl", f"WITH {BASE}, {KL_SQL} SELECT round(v, 6) AS inverse_kl FROM m_kl")
def metric_inverse_kl(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(M.inverse_kl(real, syn, FEATS))


_REG_SQL = """reg AS (SELECT * FROM (VALUES ('nearestneighbordistance', 'privacy', 0.0, 1.0, 1),
  ('identifiabilityscore', 'privacy', 0.0, 1.0, 0), ('dataleakage', 'privacy', 0.0, 1.0, 0),
  ('singlingout', 'privacy', 0.0, 1.0, 0), ('inversekldivergence', 'utility', 0.0, 1.0, 1)) t(metric, kind, lo, hi, direction))"""


def _results(spark, d):
    real, syn = cust_roles(spark, d)
    return (REG.compute_metric("nearestneighbordistance", real, syn, FEATS)
            .unionByName(REG.compute_metric("inversekldivergence", real, syn, FEATS))
            .unionByName(REG.compute_metric("singlingout", real, syn, FEATS)))


_RES_SQL = f"""{NN_SQL}, {KL_SQL}, {_so_sql('syn', 'real', 'so')},
res AS (SELECT 'nearestneighbordistance' AS metric, v AS value FROM m_nn
        UNION ALL SELECT 'inversekldivergence', v FROM m_kl UNION ALL SELECT 'singlingout', risk FROM so_risk)"""


@query("metric_normalize", f"""WITH {BASE}, {_RES_SQL}, {_REG_SQL}
SELECT res.metric, round(value, 6) AS value,
       round(CASE WHEN direction = 1 THEN (value - lo) / (hi - lo) ELSE 1.0 - (value - lo) / (hi - lo) END, 6) AS normalized
FROM res JOIN reg ON res.metric = reg.metric""")
def metric_normalize(spark, d):
    out = M.normalized(_results(spark, d), REG.metrics_table(spark))
    return rounded(out.select("metric", "value", "normalized"))


def _weights(spark):
    rows = [("privacy", 1, "nearestneighbordistance", 1.0), ("privacy", 2, "singlingout", 0.5),
            ("privacy", 3, "none", 0.0), ("utility", 1, "inversekldivergence", 1.0),
            ("utility", 2, "none", 0.0), ("utility", 3, "none", 0.0)]
    return spark.createDataFrame(rows, "kind string, slot int, metric string, weight double")


@query("metric_composite", f"""WITH {BASE}, {_RES_SQL}, {_REG_SQL},
wts AS (SELECT * FROM (VALUES ('privacy', 1, 'nearestneighbordistance', 1.0), ('privacy', 2, 'singlingout', 0.5),
        ('utility', 1, 'inversekldivergence', 1.0)) t(kind, slot, metric, weight))
SELECT wts.kind, round(sum(CASE WHEN direction = 1 THEN (value - lo) / (hi - lo) ELSE 1.0 - (value - lo) / (hi - lo) END * weight), 6) AS score
FROM res JOIN reg ON res.metric = reg.metric JOIN wts ON res.metric = wts.metric GROUP BY wts.kind""")
def metric_composite(spark, d):
    return rounded(M.composite(_results(spark, d), _weights(spark), REG.metrics_table(spark)))


@query("metric_leakage")
def metric_leakage(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(M.data_leakage(real, syn, ["c_mktsegment"], FEATS))


@query("metric_detection")
def metric_detection(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(M.detection_auc(real, syn, FEATS))


def _mean_gap(real, syn, cols, sensitive):
    c = cols[0]
    r = real.agg(F.avg(c).alias("a"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    s = syn.agg(F.avg(c).alias("b"))
    return M.side_by_side(r, s).select((F.abs(F.col("a") - F.col("b")) / (F.col("hi") - F.col("lo"))).alias("meangap"))


@query("user_metric", f"""WITH o AS (SELECT o_orderkey AS row_id, o_totalprice FROM orders),
real AS (SELECT * FROM o WHERE {dsql(ROLE_SEED, 'role', 'row_id')} < 0.5), syn AS (SELECT * FROM o WHERE {dsql(ROLE_SEED, 'role', 'row_id')} >= 0.5),
v AS (SELECT abs(r.a - s.b) / (r.hi - r.lo) AS value FROM (SELECT avg(o_totalprice) a, min(o_totalprice) lo, max(o_totalprice) hi FROM real) r,
      (SELECT avg(o_totalprice) b FROM syn) s)
SELECT 'meangap' AS metric, 'utility' AS kind, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS direction, round(value, 6) AS value FROM v""")
def user_metric(spark, d):
    from mirage.plans.catalog import roles
    REG.register_metric("meangap", "utility", _mean_gap, 0.0, 1.0, 0, "Gap of the column means over the real range.")
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    real, syn = roles(o)
    val = REG.compute_metric("meangap", real, syn, ["o_totalprice"])
    spec = REG.metric("meangap")
    return rounded(val.select("metric", F.lit(spec.kind).alias("kind"), F.lit(spec.lo).alias("lo"),
                              F.lit(spec.hi).alias("hi"), F.lit(spec.direction).alias("direction"), "value"))
