"""Functional dependencies in two passes against pandas; counterexamples outside the first pass."""

import numpy as np
import pandas as pd

from mirage.operators import prep as P


def brute(pdf, cols):
    out = {}
    for a in cols:
        g = pdf.groupby(a, dropna=False)
        if g.ngroups == len(pdf):
            continue
        out[a] = {b for b in cols if b != a and (g[b].nunique(dropna=False) == 1).all()}
    return out


def frame(spark, pdf):
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)],
                                 "row_id long, key string, city string, land string, x double, y double, r long")


def table(n=5000, seed=1):
    rng = np.random.default_rng(seed)
    city = rng.integers(0, 2500, n)
    x = (city % 7).astype(float)
    return pd.DataFrame({"row_id": range(n), "key": [f"k{i}" for i in range(n)],
                         "city": [None if c == 3 else f"c{c}" for c in city],
                         "land": [None if c % 40 == 1 else f"l{c % 40}" for c in city],
                         "x": x, "y": np.where(x == 0, -0.0, x * 2), "r": rng.integers(0, 3, n)})


def test_same_as_brute_force_with_nulls_and_signed_zero(spark):
    pdf = table()
    cols = list(pdf.columns[1:])
    df = frame(spark, pdf)
    got = P.functional_dependencies(df, cols, len(pdf), {c: pdf[c].nunique() for c in cols})
    want = {a: b for a, b in brute(pdf, cols).items()}
    assert {a: b for a, b in got.items() if b} == {a: b for a, b in want.items() if b}
    assert want["city"] == {"land", "x", "y"}


def test_a_single_counterexample_counts(spark):
    pdf = table()
    row = pdf.index[pdf["city"].duplicated(keep=False) & pdf["city"].notna()][0]
    pdf.loc[row, "land"] = "elsewhere"
    df = frame(spark, pdf)
    _, ctx = P.compress(df)
    assert ("city", "land") not in ctx.derived and ("city", "x") in ctx.derived and ctx.constants == {}
    back = P.decompress(*P.compress(df)).toPandas().sort_values("row_id").reset_index(drop=True)
    assert back["y"].abs().tolist() == pdf["y"].abs().tolist() and back["x"].tolist() == pdf["x"].tolist()


def test_jobs_do_not_grow_with_the_columns(spark, monkeypatch):
    seen = []
    real = P._grouped_same
    monkeypatch.setattr(P, "_grouped_same", lambda *a: seen.append(len(a[1])) or real(*a))
    wide = spark.range(400).selectExpr("id as row_id", *[f"cast(id * {i + 3} % {i + 5} as int) as c{i}" for i in range(12)])
    P.compress(wide)
    assert len(seen) <= 2 and seen[0] == 12


def test_one_column_and_no_rows(spark):
    df = spark.range(5).selectExpr("id as row_id", "id % 2 as a")
    assert P.compress(df)[1].derived == []
    assert P.compress(df.filter("false"))[1].derived == []
