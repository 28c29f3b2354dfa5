"""Private tree: budget adds up, structure doesn't follow single rows, dependence is kept."""

import math

import numpy as np
import pytest

from mirage.operators import private as P
from mirage.operators import synth as Y
from mirage.operators.prep import encode
from mirage.plans import registry as REG


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    n = 6000
    x = rng.normal(100, 20, n)
    rows = [(i, float(x[i]), float(2 * x[i] + rng.normal()), float(rng.random()), "hi" if x[i] > 100 else "lo") for i in range(n)]
    rows.append((n, 1e15, 5.0, 0.5, "only me"))
    raw = spark.createDataFrame(rows, "row_id long, x double, y double, u double, t string")
    return encode(raw)[0]


def test_ledger_adds_up_to_epsilon(spark, table):
    for kw in ({}, {"domain": {"x": (0, 200), "y": (0, 400), "u": (0, 1)}}, {"cols": ["x"]},
               {"cols": ["t"], "categories": {"t": [0.0, 1.0]}}):
        _, ledger = P.private_fit(table, 3.0, 1, **kw)
        eps, delta = ledger.total()
        assert abs(eps - 3.0) < 1e-12 and delta <= P.DELTA and all(e[2] > 0 for e in ledger.entries)
        assert ledger.table(spark).count() == len(ledger.entries)


def test_one_row_shows_in_no_range_category_or_bin(table):
    fits = [P.private_fit(t, 8.0, 5)[0] for t in (table, table.filter("row_id < 6000"))]
    places = [{(r["column"], r["kind"], r["bin"], r["bin_lo"], r["bin_hi"], r["parent"], r["parent_bin"]) for r in m.collect()} for m in fits]
    assert places[0] == places[1]
    assert max(p[4] for p in places[0]) < 2000  # not 1e15
    assert len({p[2] for p in places[0] if p[0] == "t"}) == 2  # "only me" isn't listed
    assert all(r["noisy"] != round(r["noisy"]) or r["noisy"] == 0 for r in fits[0].collect())


def test_tree_links_what_depends(table):
    dom = {"x": (0, 200), "y": (0, 400), "u": (0, 1)}
    model, _ = P.private_fit(table, 20.0, 3, domain=dom)
    pairs = {frozenset((r["column"], r["parent"])) for r in model.select("column", "parent").distinct().collect() if r["parent"]}
    assert frozenset(("x", "y")) in pairs or frozenset(("t", "x")) in pairs and frozenset(("t", "y")) in pairs
    got = Y.generate(model, 4000, 1).toPandas()
    assert np.corrcoef(got["x"], got["y"])[0, 1] > 0.6
    assert got["t"].nunique() == 2 and got["x"].between(0, 200).all()


def test_noisy_maximum_follows_epsilon():
    mi = {("a", "b"): 1.0, ("a", "c"): 0.9, ("b", "c"): 0.0}
    sure = [P.private_tree(mi, ["a", "b", "c"], 1e6, 1000, s) for s in range(30)]
    assert all(t == {"a": None, "b": "a", "c": "a"} for t in sure)
    loose = {tuple(sorted((k, v) for k, v in P.private_tree(mi, ["a", "b", "c"], 1e-6, 1000, s).items() if v)) for s in range(60)}
    assert len(loose) == 3
    n = 50
    assert abs(P.mutual_information_sensitivity(n) - (2 / n * math.log(51 / 2) + 49 / n * math.log(51 / 49))) < 1e-12


def test_ranges_cover_signs_zero_and_nothing(spark):
    rows = [(i, float(v), 0.0, None) for i, v in enumerate([-3.0] * 400 + [0.0] * 400 + [70.0] * 400)]
    df = spark.createDataFrame(rows, "row_id long, a double, z double, e double")
    got = P.private_ranges(df, ["a", "z", "e"], 6.0, 1, 32)
    assert got == {"a": (-4.0, 128.0), "z": (-1.0, 1.0), "e": (-1.0, 1.0)}


def test_wide_text_nulls_and_the_registered_family(spark):
    raw = spark.range(6000).selectExpr("id as row_id", "concat('v', id % 300) as w", "if(id % 5 = 0, null, cast(id % 7 as double)) as k")
    enc = encode(raw)[0]
    model, ledger = P.private_fit(enc, 400.0, 2, ["w", "k"], domain={"k": (0, 7)})
    kinds = {(r["column"], r["kind"]) for r in model.select("column", "kind").distinct().collect()}
    assert kinds == {("w", "wide"), ("k", "hist")} and abs(ledger.total()[0] - 400.0) < 1e-9
    assert Y.generate(model, 3000, 1).select("w").distinct().count() > 250
    fit, gen = REG.synthesizer("private")
    assert gen(fit(enc, epsilon=5.0, cols=["k"]), 20, 1, 0).count() == 20
    with pytest.raises(ValueError):
        P.private_fit(enc.filter("false"), 1.0, 1, ["w"])
