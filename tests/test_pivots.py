"""Nearest neighbours by pivot cells against numpy, and how many parts are visited."""

import numpy as np
import pytest

from mirage.operators import distance as D
from mirage.operators import pivots as P

COLS = ["x", "y", "z"]


@pytest.fixture
def small(spark):
    spark.conf.set("mirage.distance.broadcastBytes", "64")
    spark.conf.set("mirage.distance.blockRows", "50")
    yield spark
    spark.conf.unset("mirage.distance.broadcastBytes")
    spark.conf.unset("mirage.distance.blockRows")


@pytest.fixture
def visits(monkeypatch):
    seen = []
    visit = P._visit

    def counted(rows, *a, **k):
        seen.append(rows.count())
        return visit(rows, *a, **k)

    monkeypatch.setattr(P, "_visit", counted)
    return seen


def clusters(n, seed=1, centres=12):
    rng = np.random.default_rng(seed)
    mid = np.random.default_rng(99).random((centres, 3)) * 1000
    return mid[rng.integers(0, centres, n)] + rng.normal(size=(n, 3))


def frame(spark, X, tag=None):
    rows = [(i, *map(float, x)) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "row_id long, x double, y double, z double")


def brute(A, B, other=False):
    d = np.sqrt(((A[:, None, :] - B[None, :, :]) ** 2).sum(2))
    if other:
        d[np.arange(len(A)), np.arange(len(A))] = np.inf
    return d


def test_exact_on_clusters_ties_and_copies(small):
    A, B = clusters(300, 1), np.concatenate([clusters(700, 2), np.repeat(clusters(3, 3), 60, axis=0), np.zeros((70, 3))])
    a, b = frame(small, A), frame(small, B)
    want = brute(A, B)
    got = {r["row_id"]: (r["nn_id"], r["dist"]) for r in D.nearest_neighbor(a, b, COLS).collect()}
    assert len(got) == 300
    for i in range(300):
        assert abs(got[i][1] - want[i].min()) < 1e-9 and abs(want[i][got[i][0]] - want[i].min()) < 1e-12
        assert got[i][0] == np.flatnonzero(want[i] == want[i].min())[0] or want[i][got[i][0]] <= want[i].min()
    own = {r["row_id"]: r["dist"] for r in D.nearest_other(b, COLS).collect()}
    assert np.allclose([own[i] for i in range(len(B))], brute(B, B, True).min(1), atol=1e-9)


def test_tags_nulls_and_empty(small):
    A, B = clusters(120, 1), clusters(400, 2)
    a = frame(small, A).unionByName(small.createDataFrame([(500, None, 1.0, 1.0)], "row_id long, x double, y double, z double"))
    b = frame(small, B).selectExpr("*", "CASE WHEN row_id % 3 = 0 THEN NULL ELSE cast(row_id % 3 as int) END as tag")
    got = {(r["row_id"], r["tag"]): r["dist"] for r in D.nearest_distance(a, b, COLS, by=["tag"]).collect()}
    assert len(got) == 363 and all(got[500, t] is None for t in (None, 1, 2))
    d = brute(A, B)
    for t, k in ((None, 0), (1, 1), (2, 2)):
        assert np.allclose([got[i, t] for i in range(120)], d[:, k::3].min(1), atol=1e-9)
    alone = frame(small, np.repeat(A[:1], 200, axis=0))
    assert {r["dist"] for r in D.nearest_other(alone, COLS).collect()} == {0.0}
    assert {r["dist"] for r in P.pivot_nearest(a, b.filter("false").withColumnRenamed("row_id", "_bid"), COLS, "row_id", "dist",
                                               D._kernel("min", False), False, 50).collect()} == {None}


def test_visits_grow_with_the_rows_on_clustered_data(small, visits):
    """Eight times the rows make about eight times the visits; all pairs of blocks
    would make 64 times as many."""
    total = []
    for n in (500, 4000):
        visits.clear()
        X = clusters(n, 5, centres=n // 20)
        D.nearest_other(frame(small, X), COLS).count()
        total.append(sum(visits))
    assert total[1] < 12 * total[0] and total[1] < 0.5 * 4000 * 4000 / 50


def test_visits_of_a_value_many_rows_share(small, visits):
    """Rows that equal half of the other table visit a few of its rows, not all parts of
    its copies; the neighbour is still the lowest id, or the next where that is the row's own."""
    X = np.concatenate([np.zeros((1500, 3)), clusters(1500, 5, centres=75)])
    a = frame(small, X)
    got = {r["row_id"]: (r["nn_id"], r["dist"]) for r in D.nearest_neighbor(a, a, COLS, exclude_self=True).collect()}
    assert sum(visits) < 10 * len(X)
    assert got[0] == (1, 0.0) and all(got[i] == (0, 0.0) for i in range(1, 1500))
    assert all(abs(got[1500 + i][1] - np.delete(np.sqrt(((X[1500 + i] - X) ** 2).sum(1)), 1500 + i).min()) < 1e-9 for i in range(0, 1500, 25))


def test_equal_rows_with_one_id(small):
    """A row that comes often under one id is not its own neighbour."""
    b = frame(small, np.concatenate([np.zeros((1, 3)), clusters(300, 2) + 50]))
    many = b.filter("row_id = 0").crossJoin(small.range(200)).drop("id").unionByName(b.filter("row_id > 0"))
    got = {r["row_id"]: r["dist"] for r in D.nearest_other(many, COLS).collect()}
    want = {r["row_id"]: r["dist"] for r in D.nearest_other(b, COLS).collect()}
    assert got == want and got[0] > 0
