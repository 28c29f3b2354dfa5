"""Value modes: two peaks found and generated, null and constant columns, dependence between modes."""

import numpy as np
import pytest

from mirage.operators import synth as Y
from mirage.operators.modes import fit_value_modes
from mirage.plans import registry as REG


@pytest.fixture(scope="module")
def peaks(spark):
    rng = np.random.default_rng(4)
    n = 4000
    side = rng.random(n) < 0.3
    x = np.where(side, rng.normal(-50, 1, n), rng.normal(50, 2, n))
    y = np.where(side, rng.normal(1000, 10, n), rng.normal(3000, 10, n))
    rows = [(i, float(x[i]), None if i % 97 == 0 else float(y[i]), 7.0, "a" if side[i] else "b") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, x double, y double, c double, t string"), side, x, y


def test_modes_of_every_column_at_once(peaks):
    df, side, x, y = peaks
    got = fit_value_modes(df, ["x", "y", "c"], 2, 30).collect()
    by = {}
    for r in got:
        by.setdefault(r["column"], []).append(r)
    assert [(r["weight"], r["mean"], r["sd"]) for r in by["c"]] == [(1.0, 7.0, 0.0)]
    ok = np.arange(len(x)) % 97 != 0
    for c, v, m in (("x", x, side), ("y", y[ok], side[ok])):
        low, high = sorted(by[c], key=lambda r: r["mean"])
        for r, part in ((low, v[m]), (high, v[~m])):
            assert abs(r["weight"] - len(part) / len(v)) < 1e-3
            assert abs(r["mean"] - part.mean()) < 0.05 and abs(r["sd"] - part.std()) < 0.05 * part.std()


def test_many_modes_keep_the_mixture(peaks):
    df, _, x, _ = peaks
    modes = fit_value_modes(df, ["x"], 10, 30).collect()
    assert abs(sum(r["weight"] for r in modes) - 1) < 1e-9 and all(r["sd"] > 0 for r in modes)
    assert abs(sum(r["weight"] * r["mean"] for r in modes) - x.mean()) < 1.0
    assert sum(r["weight"] for r in modes if -40 < r["mean"] < 30) < 0.01


def test_generated_rows_have_both_peaks_and_the_gap(peaks):
    df, side, *_ = peaks
    from mirage.operators.prep import encode
    enc, _ = encode(df)
    model = Y.modes_fit(enc, 50.0, 9, ["x", "y", "t"], modes=2, passes=30)
    assert {(r["column"], r["kind"]) for r in model.select("column", "kind").distinct().collect()} == {
        ("x", "mode"), ("y", "mode"), ("t", "cat")}
    rows = Y.generate(model, 3000, 5).collect()
    gx, gy = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    assert ((gx > -55) & (gx < -45) | (gx > 40) & (gx < 60)).all()
    assert abs((gx < 0).mean() - side.mean()) < 0.04
    assert ((gx < 0) == (gy < 2000)).mean() > 0.98
    assert abs(gy[gx < 0].mean() - 1000) < 5 and abs(gx[gx > 0].std() - 2) < 0.3


def test_condition_on_a_mode_column_and_the_registered_family(peaks, spark):
    df, *_ = peaks
    from mirage.operators.prep import encode
    enc, _ = encode(df)
    model = Y.modes_fit(enc, 50.0, 9, ["x", "y"], cond="x", modes=2, passes=30)
    cond = spark.createDataFrame([(0, -49.0), (1, 52.0), (2, -500.0)], "row_id long, x double")
    got = {r["row_id"]: r for r in Y.generate(model, 3, 5, cond=cond).collect()}
    assert got[0]["y"] < 2000 < got[1]["y"] and got[2]["y"] is not None
    fit, gen = REG.synthesizer("modes")
    reg = fit(enc, epsilon=50.0, seed=9, cols=["x", "c"])
    assert {r["kind"] for r in reg.select("kind").distinct().collect()} == {"mode", "cat"}
    assert gen(reg, 50, 1, 0).count() == 50


def test_integers_stay_whole_and_empty_tables(spark):
    ints = spark.range(500).selectExpr("id as row_id", "cast(id % 40 as int) as k")
    got = Y.generate(Y.modes_fit(ints, None, 3, ["k"], modes=4), 400, 2).collect()
    assert all(r["k"] == int(r["k"]) for r in got) and len({r["k"] for r in got}) > 20
    assert fit_value_modes(ints.filter("false"), ["k"]).collect() == []
