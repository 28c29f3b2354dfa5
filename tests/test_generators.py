"""Generators: text columns are categories at any width."""

import pytest
from pyspark.sql import functions as F

from mirage.operators import synth as Y
from mirage.operators.prep import decode, encode


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, ["red", "green", "blue", "grey", "white", "black", "pink"][min(i % 11, 6)], f"name {i % 900:04d}", float(i % 37)) for i in range(1800)]
    return encode(spark.createDataFrame(rows, "row_id long, colour string, name string, size double"))


def test_every_category_is_generated(spark, people):
    real, encoding = people
    out = decode(Y.generate(Y.dp_fit(real, None, 5), 6000, 5), encoding)
    share = {r["colour"]: r["n"] / 6000 for r in out.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r["colour"]: r["n"] / 1800 for r in decode(real, encoding).groupBy("colour").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(share) == set(want) and all(abs(share[c] - want[c]) < 0.03 for c in want)
    assert out.select("name").distinct().count() > 850


def test_wide_columns_equal_inlined_ones(people, monkeypatch):
    """The guide table draws the same categories as the CASE chain."""
    real, _ = people
    wide = Y.dp_fit(real, 4.0, 5)
    assert {r["column"] for r in wide.filter("kind = 'wide'").select("column").distinct().collect()} == {"name"}
    a = sorted(map(tuple, Y.generate(wide, 2000, 5).select("row_id", "colour", "name", "size").collect()))
    monkeypatch.setattr(Y, "INLINE_CATEGORIES", 10 ** 6)
    flat = Y.dp_fit(real, 4.0, 5)
    assert flat.filter("kind = 'wide'").count() == 0
    assert wide.first()["n_train"] == flat.first()["n_train"]
    assert a == sorted(map(tuple, Y.generate(flat, 2000, 5).select("row_id", "colour", "name", "size").collect()))


def test_only_wide_columns_and_trees(people, monkeypatch):
    real, _ = people
    only = Y.dp_fit(real, None, 5, ["name"])
    got = Y.generate(only, None, 5)
    assert got.count() == 1800 and got.columns == ["row_id", "name"]
    tree = Y.modes_fit(real, 4.0, 5)
    assert {r["column"] for r in tree.filter("parent is null").select("column").distinct().collect()} >= {"name"}
    out = Y.generate(tree, 500, 5)
    assert out.count() == 500 and set(out.columns) == {"row_id", "colour", "name", "size"} and out.filter("name is null").count() == 0
    with pytest.raises(ValueError):
        Y.modes_fit(real, 4.0, 5, cond="name")
