"""Identifiability on principal axes against numpy."""

import numpy as np

from mirage.operators import metrics as M

COLS = ["a", "b", "c", "d"]


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return np.column_stack([x[:, 0], x[:, 0] + 0.1 * rng.normal(size=n), 5 * x[:, 1], rng.normal(size=n) + x[:, 1]])


def frame(spark, X, first=0):
    return spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(X)], "row_id long, " + ", ".join(f"{c} double" for c in COLS))


def brute(R, S, k):
    m, s = R.mean(0), R.std(0, ddof=1)
    z, t = (R - m) / s, (S - m) / s
    axes = np.linalg.svd(z, full_matrices=False)[2][:k].T
    p, q = z @ axes, t @ axes
    own = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    own[np.arange(len(p)), np.arange(len(p))] = np.inf
    return (np.sqrt(((p[:, None] - q[None]) ** 2).sum(2)).min(1) < own.min(1)).mean()


def test_identifiability_on_two_axes_and_all_axes(spark):
    R, S = data(300, 1), data(200, 2)
    real, syn = frame(spark, R), frame(spark, S)
    for k in (1, 2, 4):
        assert abs(M.identifiability_oc(real, syn, COLS, pca=k).first()[0] - brute(R, S, k)) < 1e-9
    whole = M.identifiability_oc(real, syn, COLS).first()[0]
    assert abs(M.identifiability_oc(real, syn, COLS, pca=9).first()[0] - whole) < 0.01


def test_axes_leave_nulls_out(spark):
    R = data(400, 3)
    R -= R.mean(0)
    df = frame(spark, R)
    holes = df.unionByName(spark.createDataFrame([(999, None, 1e9, 0.0, 0.0)], df.schema))
    want = np.linalg.svd(R, full_matrices=False)[2][:2].T
    got = M.principal_axes(holes, COLS, 2)
    assert np.allclose(np.abs((got * want).sum(0)), 1.0) and got.shape == (4, 2)
    tagged = df.selectExpr("*", "cast(row_id % 2 as int) as tag")
    assert M.identifiability_oc(df, tagged, COLS, by=["tag"], pca=2).count() == 2
