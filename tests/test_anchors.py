"""Extreme mean distances by bounds against numpy, and how many rows need exact ones."""

import numpy as np
import pytest

from mirage.operators import anchors as A
from mirage.operators import distance as D
from mirage.operators import merge as G

COLS = ["x", "y"]


def frame(spark, X, first=0):
    return spark.createDataFrame([(first + i, *map(float, x)) for i, x in enumerate(X)], "row_id long, x double, y double")


def cloud(n, seed):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 1, (n - n // 4, 2)), rng.normal(40, 3, (n // 4, 2))]) + 1e4


def mean(X, Y):
    return np.sqrt(((X[:, None, :] - Y[None, :, :]) ** 2).sum(2)).mean(1)


@pytest.mark.parametrize("descending", [False, True])
def test_the_first_rows_are_the_exact_ones(spark, descending):
    X, Y = cloud(400, 1), np.concatenate([cloud(900, 2), np.repeat(cloud(4, 3), 80, axis=0)])
    X = np.concatenate([X, X[:20], X[-20:]])  # ties
    a, b = frame(spark, X), frame(spark, Y)
    k = 30
    got = D.top_share(A.extreme_mean_distance(a, b, COLS, k, descending, anchors=64, exact_rows=0), k, 1.0, descending=descending).collect()
    want = D.top_share(D.mean_distance_cross(a, b, COLS), k, 1.0, descending=descending).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    d = mean(X, Y)
    assert np.allclose([r["mean_dist"] for r in got], np.sort(d)[::-1][:k] if descending else np.sort(d)[:k])


def test_bounds_hold_and_leave_few_rows(spark):
    X, Y = cloud(3000, 5), cloud(4000, 6)
    bounds = A.mean_distance_bounds(frame(spark, X), frame(spark, Y), COLS)
    rows = bounds.toPandas().sort_values("row_id")
    d = mean(X, Y)
    assert (rows["lo"] <= d).all() and (d <= rows["hi"]).all()
    for descending in (False, True):
        left = A.contenders(frame_of(spark, rows), 60, descending).count()
        assert 60 <= left < 0.1 * 3000  # of 3000 rows, those that get exact distances


def frame_of(spark, pdf):
    return spark.createDataFrame(pdf)


def test_groups_nulls_few_rows_and_empty(spark):
    X, Y = cloud(200, 1), cloud(300, 2)
    a = frame(spark, X).selectExpr("*", "row_id % 3 AS g").unionByName(
        spark.createDataFrame([(900, None, 1.0, 0), (901, 1e5, 1e5, None)], "row_id long, x double, y double, g long"))
    b = frame(spark, Y)
    got = {r["row_id"]: r["mean_dist"] for r in
           A.extreme_mean_distance(a, b, COLS, 5, True, anchors=32, group="g", exact_rows=0).collect()}
    d = mean(X, Y)
    for g in range(3):
        ids = np.arange(200)[np.arange(200) % 3 == g]
        for i in ids[np.argsort(-d[ids])][:5]:
            assert abs(got[i] - d[i]) < 1e-9
    assert got[900] is None and got[901] > 1e4 and len(got) < 120
    every = A.extreme_mean_distance(a, b, COLS, 1000, True, exact_rows=0)
    assert every.count() == 202
    none = A.extreme_mean_distance(a, b.filter("false"), COLS, 5, exact_rows=0).collect()
    assert len(none) == 202 and all(r["mean_dist"] is None for r in none)


def test_merge_step_is_the_same_by_bounds(spark):
    cur, donor = frame(spark, cloud(300, 1)), frame(spark, cloud(200, 2), 1000)
    plain = sorted(tuple(r) for r in G.privacy_merge_step(cur, donor, 300, 0.1, COLS).collect())
    spark.conf.set("mirage.distance.blockRows", "100")
    try:
        bounded = sorted(tuple(r) for r in G.privacy_merge_step(cur, donor, 300, 0.1, COLS, anchors=32).collect())
    finally:
        spark.conf.unset("mirage.distance.blockRows")
    assert plain == bounded and len(plain) == 300
