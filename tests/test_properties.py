"""Hand-computed micro tables and properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirage.functions.ordering import ordered_index, take_first, top_k_per_group
from mirage.operators import distance as D
from mirage.operators import frequencies as Q
from mirage.operators import merge as G
from mirage.operators import metrics as M
from mirage.operators import prep as P
from mirage.operators import synth as Y
from mirage.plans import requirements as R


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_identical_tables_have_perfect_utility_and_zero_distance(spark):
    df = _df(spark, [(i, float(i % 7), float(i * 3 % 11)) for i in range(60)], "row_id long, a double, b double")
    assert M.inverse_kl(df, df).first()[0] == pytest.approx(1.0)
    assert M.nearest_neighbor_distance(df, df).first()[0] == 0.0


def test_nearest_distance_micro(spark):
    real = _df(spark, [(1, 0.0, 0.0), (2, 3.0, 4.0)], "row_id long, x double, y double")
    syn = _df(spark, [(10, 0.0, 1.0), (11, 6.0, 8.0)], "row_id long, x double, y double")
    d = {r[0]: r[1] for r in D.nearest_distance(real, syn, ["x", "y"]).collect()}
    assert d == {1: pytest.approx(1.0), 2: pytest.approx(math.sqrt(9 + 9))}
    nn = {r[0]: r[1] for r in D.nearest_neighbor(real, syn, ["x", "y"]).collect()}
    assert nn == {1: 10, 2: 10}
    other = {r[0]: r[1] for r in D.nearest_other(real, ["x", "y"]).collect()}
    assert other == {1: pytest.approx(5.0), 2: pytest.approx(5.0)}
    mean = {r[0]: r[1] for r in D.mean_distance_self(real, ["x", "y"]).collect()}
    assert mean == {1: pytest.approx(2.5), 2: pytest.approx(2.5)}


def test_broadcast_and_blocked_paths_agree(spark):
    rng = np.random.default_rng(1)
    a = pd.DataFrame({"row_id": np.arange(300), "x": rng.normal(size=300), "y": rng.normal(size=300) * 100})
    b = pd.DataFrame({"row_id": np.arange(1000, 1250), "x": rng.normal(size=250), "y": rng.normal(size=250) * 100})
    A, B = spark.createDataFrame(a), spark.createDataFrame(b)
    fast = {r[0]: r[1] for r in D.nearest_distance(A, B, ["x", "y"]).collect()}
    mean_fast = {r[0]: r[1] for r in D.mean_distance_cross(A, B, ["x", "y"]).collect()}
    spark.conf.set("mirage.distance.broadcastBytes", "64")
    spark.conf.set("mirage.distance.blockRows", "64")
    try:
        slow = {r[0]: r[1] for r in D.nearest_distance(A, B, ["x", "y"]).collect()}
        mean_slow = {r[0]: r[1] for r in D.mean_distance_cross(A, B, ["x", "y"]).collect()}
        by = {(r[0], r[1]): r[2] for r in D.nearest_distance(A, B.withColumn("t", F.col("row_id") % 2), ["x", "y"], by=["t"]).collect()}
    finally:
        spark.conf.unset("mirage.distance.broadcastBytes")
        spark.conf.unset("mirage.distance.blockRows")
    for k in fast:
        assert slow[k] == pytest.approx(fast[k], abs=1e-6)
        assert mean_slow[k] == pytest.approx(mean_fast[k], abs=1e-6)
    brute = np.sqrt(((a[["x", "y"]].to_numpy()[:, None, :] - b[["x", "y"]].to_numpy()[None, :, :]) ** 2).sum(-1)).min(1)
    for i, k in enumerate(a.row_id):
        assert fast[k] == pytest.approx(brute[i], abs=1e-9)
        assert min(by[(k, 0)], by[(k, 1)]) == pytest.approx(brute[i], abs=1e-9)


def test_encode_decode_roundtrip(spark):
    df = _df(spark, [(1, "b", 2.5), (2, "a", None), (3, "c", 1.0), (4, "a", 7.0)], "row_id long, s string, v double")
    enc, e = P.encode(df)
    assert sorted(r["s"] for r in enc.collect()) == [0, 0, 1, 2]
    back = P.decode(enc, e)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    with pytest.raises(ValueError):
        P.decode(enc, None)


def test_constraints_subset_and_rules(spark):
    df = _df(spark, [(i, i % 10, f"k{i % 3}") for i in range(100)], "row_id long, n int, k string")
    rules = _df(spark, [("n", "ge", None, 3.0), ("n", "lt", None, 7.0), ("k", "in", "k1", None)], P.RULE_SCHEMA)
    kept = P.match_constraints(df, rules)
    rows = kept.collect()
    assert rows and all(3 <= r["n"] < 7 and r["k"] == "k1" for r in rows)
    assert P.satisfies(kept, rules).first()["ok"] is True
    assert P.satisfies(df, rules).first()["ok"] is False
    inferred = P.infer_schema_rules(df)
    assert P.satisfies(df, inferred).first()["ok"] is True


def test_sample_exact_size_and_error(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    assert P.sample_rows(df, 20, 3).count() == 20
    with pytest.raises(ValueError):
        P.sample_rows(df, 51, 3)


def test_ordered_index_is_consecutive(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id").withColumn("g", (F.col("row_id") % 3).cast("int"))
    out = ordered_index(df, ["row_id"], name="i").collect()
    assert sorted(r["i"] for r in out) == list(range(5000))
    assert all(r["i"] == r["row_id"] for r in out)
    grouped = ordered_index(df, ["row_id"], group_cols=["g"], name="i").collect()
    for g in range(3):
        ids = sorted((r["row_id"], r["i"]) for r in grouped if r["g"] == g)
        assert [i for _, i in ids] == list(range(len(ids)))
    assert [r["row_id"] for r in take_first(df, [F.col("row_id").desc()], 3).collect()] == [4999, 4998, 4997]


def test_top_k_with_a_hot_key(spark):
    # one unit holds a third of the rows: the salted top-k still keeps exactly cap rows
    n = 3000
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumn(
        "unit", F.when(F.col("row_id") < n // 3, F.lit(0)).otherwise(F.col("row_id")))
    out = Y.bound_contribution(df, "unit", 4, seed=1)
    counts = {r["unit"]: r["count"] for r in out.groupBy("unit").count().collect()}
    assert counts[0] == 4 and len(counts) == n - n // 3 + 1
    tk = top_k_per_group(df, ["unit"], ["row_id"], 2, name="r").filter(F.col("unit") == 0).collect()
    assert sorted(r["row_id"] for r in tk) == [0, 1]


def test_partition_count_does_not_change_results(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), "l_quantity", "l_extendedprice")
    outs = []
    for n in (1, 7, 200):
        df = base.repartition(n)
        f = Q.column_frequencies(df, df.filter(F.col("l_quantity") > 10))
        outs.append(sorted((r[0], round(r[1], 9), round(r[2], 9), round(r[3], 9)) for r in f.collect()))
    assert outs[0] == outs[1] == outs[2]


def test_exact_marginals_without_noise_and_noise_variance(spark):
    df = spark.range(2000).withColumnRenamed("id", "row_id").withColumn("v", (F.col("row_id") % 10).cast("double"))
    def against_truth(model, table, cols):
        true = {(r["column"], r["bin"]): r["count"] for r in Y.marginal_counts(table, cols).collect()}
        assert "count" not in model.columns
        return np.array([r["noisy"] - true[r["column"], r["bin"]] for r in model.collect()])

    m = Y.dp_fit(df, None, 5, ["v"])
    assert not against_truth(m, df, ["v"]).any() and {r["n_train"] for r in m.collect()} == {2000}
    # Laplace noise on a big zero-free table: variance close to 2 (k / eps)^2
    wide = spark.range(4000).withColumnRenamed("id", "row_id")
    wide = wide.select("row_id", *[((F.col("row_id") * (i + 7)) % 9973).cast("double").alias(f"c{i}") for i in range(40)])
    cols = [c for c in wide.columns if c != "row_id"]
    err = against_truth(Y.dp_fit(wide, 40.0, 11, n_bins=10), wide, cols)
    assert np.var(err) == pytest.approx(2.0, rel=0.35)


def test_generated_rows_follow_model_and_rules(spark):
    df = spark.range(3000).withColumnRenamed("id", "row_id").withColumn("v", (F.col("row_id") % 4).cast("double"))
    model = Y.dp_fit(df, None, 1, ["v"])
    g = Y.generate(model, 4000, 2)
    shares = {r["v"]: r["count"] / 4000 for r in g.groupBy("v").count().collect()}
    assert set(shares) == {0.0, 1.0, 2.0, 3.0}
    assert all(abs(s - 0.25) < 0.05 for s in shares.values())
    assert P.satisfies(g.select("row_id", "v"), P.infer_schema_rules(df)).first()["ok"] is True


def test_privacy_merge_keeps_row_count(spark):
    cur = spark.range(40).withColumnRenamed("id", "row_id").withColumn("x", (F.col("row_id") % 5).cast("double"))
    donor = spark.range(100, 140).withColumnRenamed("id", "row_id").withColumn("x", (F.col("row_id") % 13).cast("double"))
    out = G.privacy_merge_step(cur, donor, 40, 0.25, ["x"])
    assert out.count() == 40
    assert sorted(r["row_id"] for r in out.collect()) == list(range(40))


def test_singling_out_micro(spark):
    syn = _df(spark, [(1, 1.0), (2, 2.0), (3, 2.0), (4, 9.0)], "row_id long, a double")
    real = _df(spark, [(1, 1.0), (2, 5.0), (3, 9.0), (4, 9.0)], "row_id long, a double")
    # attacks: a=1 (1 real match), a=9 (2 matches), a<=1 (1 match), a>=9 (2 matches) -> s=2, n=4
    z2 = 1.959964 ** 2
    got = M.singling_out(real, syn).first()
    assert got["n_attacks"] == 4 and got["n_success"] == 2
    assert got["singling_out"] == pytest.approx((2 + z2 / 2) / (4 + z2))


def test_find_levels_first_entry_decides(spark):
    levels = _df(spark, [("L1", "privacy", 0, "m", 0.10, 0.12, 0), ("L1", "privacy", 1, "m", 0.50, 0.50, 0),
                         ("L2", "privacy", 0, "m", 0.50, 0.52, 1), ("L2", "utility", 0, "u", 0.7, 0.7, 1)],
                 R.LEVEL_SCHEMA)
    reqs = _df(spark, [(1, "x", 10, "m", 0.5, None, None, 0.01), (2, "x", 10, "m", 0.5, "u", 0.9, 0.01),
                       (3, "x", 10, None, None, None, None, 0.01)], R.REQUEST_SCHEMA)
    got = sorted(tuple(r) for r in R.find_levels(reqs, levels).select("request_id", "level").collect())
    assert got == [(1, "L2")]  # L1's first "m" entry (0.10/0.12) decides; request 2 fails on utility
    assert {r["request_id"]: r["status"] for r in R.validate_request(reqs).collect()}[3] == "rejected"


def test_next_epsilon_and_direction(spark):
    t = _df(spark, [(2.0, 0.1, 10.0, -0.5, "down"), (2.0, 0.1, 10.0, 0.25, "up"), (2.0, 2.0, 2.0, 0.3, "up")],
            "epsilon double, low double, high double, amount double, direction string")
    got = [(r["new_low"], r["new_high"], r["new_epsilon"]) for r in R.next_epsilon(t).collect()]
    assert got[0] == (0.1, 2.0, 1.1) and got[1] == (2.0, 10.0, 4.0) and got[2][2] is None
    d = _df(spark, [(0.5, 0.3, 0.0, 1.0, 1, 0.6, 0.9, 0.0, 1.0, 1, 0.05)],
            "p_req double, p_val double, p_lo double, p_hi double, p_dir int, u_req double, u_val double, "
            "u_lo double, u_hi double, u_dir int, tol double")
    r = R.epsilon_direction(d).first()
    assert r["move"] == "down" and r["step"] == pytest.approx(0.2)


def test_stream_equals_batch(spark):
    from mirage.plans.catalog_levels import _serve_levels, _serve_requests, _SERVE_EPS
    from mirage.plans.catalog import FEATS, SEED, cust_roles, scratch
    from mirage.plans.levels import serve
    from mirage.streaming.serve import serve_stream
    real, _ = cust_roles(spark, "/root/testdata/sf0.001")
    models = {n: Y.dp_fit(real, e, SEED, FEATS) for n, e in list(_SERVE_EPS.items())[:2]}
    reqs = _serve_requests(spark, "/root/testdata/sf0.001")
    lv = _serve_levels(spark)
    batch = sorted(tuple(r) for r in serve(real, reqs, lv, models, seed=SEED, cols=FEATS).collect())
    stream = sorted(tuple(r) for r in serve_stream(real, reqs, lv, models, scratch(spark, "t1"), SEED, FEATS, 3)
                    .select("request_id", "level", "attempt", "status").collect())
    assert batch == stream


def test_leakage_by_type(spark):
    """Text of 20 values or more is classified, a number of few values regressed."""
    from mirage.operators import metrics as M
    from mirage.operators.prep import encode
    rows = [(i, float(i * 37 % 101), f"t{k:02d}" if (k := i * 7 % 60) < 25 else "t00", float(i * 13 % 29 < 14)) for i in range(600)]
    enc, _ = encode(spark.createDataFrame(rows, "row_id long, x double, s string, n double"))
    real, syn = enc.filter("row_id < 300"), enc.filter("row_id >= 300")
    assert real.select("s").distinct().count() >= 20
    assert M.data_leakage(real, syn, ["s"], ["x", "s"]).first()[0] > 0.3
    assert M.data_leakage(real, syn, ["n"], ["x", "n"]).first()[0] < 0.2


def test_every_level_scored_on_a_new_metric(spark):
    from mirage.plans import catalog_levels as C
    assert {r["level"] for r in C.add_metric(spark, "/root/testdata/sf0.001").collect()} == set(C._SERVE_EPS)
