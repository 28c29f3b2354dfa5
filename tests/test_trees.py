"""Trees under the distance kernels: same results as direct measuring, little work."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from mirage.operators import distance as D
from mirage.operators import trees as T


def _table(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, 25, n).astype(float), np.round(rng.uniform(-999, 9999, n), 2), rng.integers(0, 5, n).astype(float)], axis=1)


@pytest.mark.parametrize("grid", [False, True])  # on the grid most distances are ties
@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_equals_direct(grid, exclude_self):
    B, A = _table(3000, 1), _table(500, 2)
    if grid:
        A[:, 1], B[:, 1] = A[:, 1] // 2000, B[:, 1] // 2000
    idb = np.arange(3000) % 2500  # ids repeat
    ida = np.arange(500)
    A[:100] = B[:100]
    A[7, 1] = np.nan
    d, i = T.NearTree(B, idb).query(A, ida, exclude_self, True)
    want_d, want_i = D._argmin_sq(A, ida, B, idb, exclude_self)
    whole = np.arange(500) != 7
    np.testing.assert_array_equal(d[whole], want_d[whole])
    np.testing.assert_array_equal(i[whole], want_i[whole])
    np.testing.assert_array_equal(T.NearTree(B, idb).query(A, ida, exclude_self, False)[0][whole], want_d[whole])
    assert np.isinf(d[7])


def test_one_row_has_no_other():
    d, i = T.NearTree(np.ones((4, 2)), np.full(4, 9)).query(np.ones((2, 2)), np.array([9, 8]), True, True)
    assert np.isinf(d[0]) and i[0] == T._NONE and d[1] == 0 and i[1] == 9


class _Counted(T.NearTree):
    pairs = 0

    def _visit(self, X, idx, exclude_self, want_id, q, *rest):
        self.pairs += len(q) * self.size
        super()._visit(X, idx, exclude_self, want_id, q, *rest)


def test_nearest_work_grows_with_the_rows_only():
    work = []
    for n in (20_000, 160_000):
        tree = _Counted(_table(n, 3), np.arange(n))
        tree.query(_table(2000, 4), np.arange(2000), False, False)
        work.append(tree.pairs / 2000)
    assert work[1] < 1.5 * work[0] and work[1] < 1000  # of 160,000 rows


def test_mean_equals_direct_and_equal_rows_get_equal_sums():
    B, A = _table(30_000, 5), _table(300, 6)
    A[200:] = A[:100]
    A[0, 1] = 1e6  # far from every box
    tree = T.MeanTree(B)
    got = tree.sums(A[::-1])[::-1]
    np.testing.assert_allclose(got, D._sum_dist(A, B), rtol=1e-13)
    np.testing.assert_array_equal(got[201:], got[1:100])
    one = T.MeanTree(np.repeat(B[:1], 20_000, axis=0))
    np.testing.assert_allclose(one.sums(A), 20_000 * D._sum_dist(A, B[:1]), rtol=1e-13)


def test_mean_of_blocks_with_repeated_ids(spark):
    """Every row keeps its own mean, also where its id repeats; equal rows get equal
    means though ranges and a hash cut the blocks."""
    B, A = _table(3000, 7), _table(400, 8)
    B[:1500, 1] = 5.0  # half of the rows in one place of the widest column
    A[200:] = A[:200]
    cols = ["x", "y", "z"]
    frame = lambda X: pd.DataFrame(X, columns=cols).assign(row_id=np.arange(len(X)) % 200)[["row_id", *cols]]
    spark.conf.set("mirage.distance.broadcastBytes", "1000")
    spark.conf.set("mirage.distance.blockRows", "500")
    try:
        got = D.mean_distance_cross(spark.createDataFrame(frame(A)), spark.createDataFrame(frame(B)), cols).toPandas()
    finally:
        spark.conf.unset("mirage.distance.broadcastBytes")
        spark.conf.unset("mirage.distance.blockRows")
    want = D._sum_dist(A, B) / len(B)
    assert len(got) == 400 and got.groupby("row_id")["mean_dist"].nunique().max() == 1
    np.testing.assert_allclose(got.sort_values("row_id")["mean_dist"].to_numpy()[::2], want[:200], rtol=1e-12)
