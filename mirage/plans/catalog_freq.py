"""Catalog: frequencies (A1-A6, A8, J7), distances (J1-J5), ranks (W1-W4), U1."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirage.operators import distance as D
from mirage.operators import frequencies as Q
from mirage.operators.anchors import extreme_mean_distance
from mirage.plans.catalog import (CUST_ENC, FEATS, T, cust_roles, dist_sql, freqs_sql, long_sql, query, roles,
                                  roles_sql, rounded)

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _li(spark, d):
    return T(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), *LI_COLS)


_LI = "li AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"


@query("column_profile", f"""
WITH {_LI}, l AS ({long_sql('li', LI_COLS)})
SELECT column, count(DISTINCT v) AS n_distinct, least(10, count(DISTINCT v)) AS n_bins,
       count(DISTINCT v) < 5 AS categorical, min(v) AS lo, max(v) AS hi, count(*) AS n_rows FROM l GROUP BY column""")
def column_profile(spark, d):
    return rounded(Q.column_profile(_li(spark, d), LI_COLS))


@query("value_freqs", """
SELECT 'o_orderpriority' AS column, o_orderpriority AS value, round(count(*) / (SELECT count(*) FROM orders), 6) AS freq
FROM orders GROUP BY o_orderpriority""")
def value_freqs(spark, d):
    return rounded(Q.value_freqs(T(spark, d, "orders"), "o_orderpriority"))


@query("histogram_freqs", f"""
WITH {_LI}, {roles_sql('li')}, {freqs_sql('real', 'syn', ['l_extendedprice'], force_hist=True)}
SELECT column, round(bin, 6) AS bin, round(p_real, 6) AS p_real, round(p_syn, 6) AS p_syn FROM f_al""")
def histogram_freqs(spark, d):
    real, syn = roles(_li(spark, d))
    return rounded(Q.histogram_freqs(real, syn, "l_extendedprice"))


@query("align_freqs", f"""
WITH {CUST_ENC}, {roles_sql()}, syn2 AS (SELECT * FROM syn WHERE c_acctbal < 5000),
{freqs_sql('real', 'syn2', ['c_acctbal', 'c_mktsegment'])}
SELECT column, round(bin, 6) AS bin, round(p_real, 6) AS p_real, round(p_syn, 6) AS p_syn FROM f_al""")
def align_freqs(spark, d):
    real, syn = cust_roles(spark, d)
    syn2 = syn.filter(F.col("c_acctbal") < 5000)
    cols = ["c_acctbal", "c_mktsegment"]
    prof = Q.column_profile(real, cols)
    rf = Q._freqs(Q.to_long(real, cols), prof, "p_real")
    sf = Q._freqs(Q.to_long(syn2, cols), prof, "p_syn")
    return rounded(Q.align_freqs(rf, sf))


@query("column_frequencies", f"""
WITH {CUST_ENC}, {roles_sql()}, {freqs_sql('real', 'syn', FEATS)}
SELECT column, round(bin, 6) AS bin, round(p_real, 6) AS p_real, round(p_syn, 6) AS p_syn FROM f_al""")
def column_frequencies(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(Q.column_frequencies(real, syn, FEATS))


def _biased(spark, d):
    real, syn = cust_roles(spark, d)
    return real, syn.filter(F.col("c_acctbal") > 3000)


_BIASED = f"{CUST_ENC}, {roles_sql()}, syn2 AS (SELECT * FROM syn WHERE c_acctbal > 3000), {freqs_sql('real', 'syn2', FEATS)}"


@query("validate_frequencies", f"""
WITH {_BIASED}
SELECT column, bool_and(p_syn BETWEEN p_real - 0.2 AND p_real + 0.2) AS ok FROM f_al GROUP BY column""")
def validate_frequencies(spark, d):
    real, syn = _biased(spark, d)
    return Q.validate_frequencies(Q.column_frequencies(real, syn, FEATS), 0.2)


@query("frequency_gaps", f"""
WITH {_BIASED}
SELECT column, round(bin, 6) AS bin, round(p_real, 6) AS p_real, round(p_syn, 6) AS p_syn,
       CASE WHEN p_syn < p_real - 0.05 THEN 'under' ELSE 'over' END AS kind,
       round(CASE WHEN p_syn < p_real - 0.05 THEN p_real - 0.05 - p_syn ELSE p_syn - p_real - 0.05 END, 6) AS gap
FROM f_al WHERE p_syn < p_real - 0.05 OR p_syn > p_real + 0.05""")
def frequency_gaps(spark, d):
    real, syn = _biased(spark, d)
    return rounded(Q.frequency_gaps(Q.column_frequencies(real, syn, FEATS), 0.05))


@query("marginal_comparison", f"""
WITH {CUST_ENC}, {roles_sql()}, {freqs_sql('real', 'syn', FEATS)}
SELECT column, round(bin, 6) AS bin, 'real' AS source, round(p_real, 6) AS p FROM f_al
UNION ALL SELECT column, round(bin, 6), 'synthetic', round(p_syn, 6) FROM f_al""")
def marginal_comparison(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(Q.marginal_comparison(real, syn, FEATS))


# --- distances ----------------------------------------------------------------------

SUP_COLS = ["s_nationkey", "s_acctbal"]
_SUP = "sup AS (SELECT s_suppkey AS row_id, s_nationkey, s_acctbal FROM supplier)"


def _sup(spark, d):
    return T(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), *SUP_COLS)


_J1 = f"j1 AS (SELECT a.row_id, avg({dist_sql('a', 'b', SUP_COLS)}) AS mean_dist FROM sup a, sup b GROUP BY a.row_id)"


@query("distance_self_mean", f"WITH {_SUP}, {_J1} SELECT row_id, round(mean_dist, 6) AS mean_dist FROM j1")
def distance_self_mean(spark, d):
    return rounded(D.mean_distance_self(_sup(spark, d), SUP_COLS))


_J2 = f"j2 AS (SELECT a.row_id, avg({dist_sql('a', 'b', FEATS)}) AS mean_dist FROM syn a, real b GROUP BY a.row_id)"


@query("distance_cross_mean", f"WITH {CUST_ENC}, {roles_sql()}, {_J2} SELECT row_id, round(mean_dist, 6) AS mean_dist FROM j2")
def distance_cross_mean(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(D.mean_distance_cross(syn, real, FEATS))


@query("distance_nearest", f"""
WITH {CUST_ENC}, {roles_sql()}
SELECT a.row_id, round(min({dist_sql('a', 'b', FEATS)}), 6) AS dist FROM real a, syn b GROUP BY a.row_id""")
def distance_nearest(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(D.nearest_distance(real, syn, FEATS))


@query("distance_nearest_neighbor", f"""
WITH {CUST_ENC}, {roles_sql()},
p AS (SELECT a.row_id, b.row_id AS nn_id, {dist_sql('a', 'b', FEATS)} AS dist FROM real a, syn b)
SELECT row_id, arg_min(nn_id, (dist, nn_id)) AS nn_id, round(min(dist), 6) AS dist FROM p GROUP BY row_id""")
def distance_nearest_neighbor(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(D.nearest_neighbor(real, syn, FEATS))


@query("distance_nearest_other", """
SELECT a.vec_id AS row_id,
       round(min(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
                 lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))), 6) AS dist
FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def distance_nearest_other(spark, d):
    emb = T(spark, d, "embeddings").withColumnRenamed("vec_id", "row_id")
    wide, cols = D.expand_vector(emb, "embedding")
    return rounded(D.nearest_other(wide, cols))


@query("drop_ranked", f"""
WITH {_SUP}, {_J1}, top AS (SELECT row_id FROM j1 ORDER BY mean_dist, row_id LIMIT 10)
SELECT * FROM sup WHERE row_id NOT IN (SELECT row_id FROM top)""")
def drop_ranked(spark, d):
    sup = _sup(spark, d)
    top = D.top_share(D.mean_distance_self(sup, SUP_COLS), 10, 1.0)
    return D.drop_ranked(sup, top)


@query("rank_similar", f"""
WITH {_SUP}, {_J1}
SELECT row_id, round(mean_dist, 6) AS mean_dist, row_number() OVER (ORDER BY mean_dist, row_id) AS rank FROM j1""")
def rank_similar(spark, d):
    return rounded(D.rank_similar(D.mean_distance_self(_sup(spark, d), SUP_COLS)))


@query("rank_dissimilar", f"""
WITH {CUST_ENC}, {roles_sql()}, {_J2}
SELECT row_id, round(mean_dist, 6) AS mean_dist, row_number() OVER (ORDER BY mean_dist DESC, row_id) AS rank FROM j2""")
def rank_dissimilar(spark, d):
    real, syn = cust_roles(spark, d)
    return rounded(D.rank_dissimilar(D.mean_distance_cross(syn, real, FEATS)))


@query("top_share", f"""
WITH {CUST_ENC}, {roles_sql()}, {_J2}, n AS (SELECT count(*) AS n FROM syn)
SELECT row_id, round(mean_dist, 6) AS mean_dist FROM j2
ORDER BY mean_dist DESC, row_id LIMIT (SELECT CAST(floor(n * 0.1) AS BIGINT) FROM n)""")
def top_share(spark, d):
    real, syn = cust_roles(spark, d)
    n = syn.count()
    return rounded(D.top_share(D.mean_distance_cross(syn, real, FEATS), n, 0.1, descending=True))


@query("extreme_mean_distance", f"""
WITH {CUST_ENC}, {roles_sql()}, {_J2},
s AS (SELECT a.row_id, avg({dist_sql('a', 'b', FEATS)}) AS mean_dist FROM real a, real b GROUP BY a.row_id)
SELECT * FROM (SELECT 'unlike' AS side, row_id, round(mean_dist, 6) AS mean_dist FROM j2 ORDER BY j2.mean_dist DESC, row_id LIMIT 40)
UNION ALL SELECT * FROM (SELECT 'alike', row_id, round(mean_dist, 6) FROM s ORDER BY s.mean_dist, row_id LIMIT 40)""")
def extreme_mean_distance_q(spark, d):
    """The 40 rows most unlike the real ones and the 40 real ones most alike, by bounds."""
    real, syn = cust_roles(spark, d)
    unlike = D.top_share(extreme_mean_distance(syn, real, FEATS, 40, True, exact_rows=0), 40, 1.0, descending=True)
    alike = D.top_share(extreme_mean_distance(real, real, FEATS, 40, exact_rows=0), 40, 1.0)
    return rounded(unlike.select(F.lit("unlike").alias("side"), "row_id", "mean_dist").unionByName(
        alike.select(F.lit("alike").alias("side"), "row_id", "mean_dist")))


@query("head", "SELECT c_custkey AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100")
def head_q(spark, d):
    from mirage.operators.synth import head
    from mirage.plans.catalog import cust_raw
    return head(cust_raw(spark, d), 100)


@query("merge_rows", f"""
WITH {CUST_ENC}, {roles_sql()},
sel AS (SELECT * FROM syn WHERE c_acctbal > 8000),
u AS (SELECT 0 AS src, * FROM real UNION ALL SELECT 1, * FROM sel)
SELECT (row_number() OVER (ORDER BY src, row_id) - 1)::BIGINT AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM u""")
def merge_rows(spark, d):
    real, syn = cust_roles(spark, d)
    return D.merge_rows(real, syn.filter(F.col("c_acctbal") > 8000))
