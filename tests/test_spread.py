"""Work that one file's task did alone is spread, with the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirage.functions import ordering as O
from mirage.operators import distance as D
from mirage.operators import metrics as M
from mirage.operators import synth as Y

COLS = ["x", "y"]


def _points(spark, n, shift=0.0):
    return spark.range(0, n, 1, 1).select(F.col("id").alias("row_id"), (F.col("id") * 37 % 101 + shift).cast("double").alias("x"),
                                         (F.col("id") * 53 % 97).cast("double").alias("y"))


def test_dealt_and_over_cores(spark):
    one = spark.range(0, 1000, 1, 1).withColumnRenamed("id", "k")
    parts = O.dealt(one, "k", rows=10).withColumn("p", F.spark_partition_id())
    assert parts.select("p").distinct().count() > 50
    assert parts.groupBy("k").agg(F.countDistinct("p").alias("n")).filter("n > 1").count() == 0
    assert O.over_cores(one, 1000) is one
    spread = O.over_cores(one, 100)
    assert len(spread.inputFiles()) == 10 and spread.agg(F.sum("k")).first()[0] == 499_500


def test_tagged_summary_equals_the_rows(spark):
    a = _points(spark, 200).withColumn("x", F.when(F.col("row_id") % 7 > 0, F.col("x")))
    b = _points(spark, 120, 0.5).withColumn("t", F.when(F.col("row_id") % 3 > 0, F.col("row_id") % 3))  # null is a tag
    want = {r["t"]: r for r in D.nearest_distance(a, b, COLS, by=["t"]).groupBy("t").agg(
        F.count("dist").alias("n"), F.avg("dist").alias("mean"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    for limit in (None, "64"):
        if limit:
            spark.conf.set("mirage.distance.broadcastBytes", limit)
        try:
            part = D._pair_stat_by(a, b, COLS, "row_id", "min", False, "dist", ["t"], fold=True)
            if not limit:  # a row a task and tag, not a row a row and tag
                assert part.count() <= 3 * 2 * spark.sparkContext.defaultParallelism
            got = D.nearest_summary(a, b, COLS, ["t"]).collect()
        finally:
            spark.conf.unset("mirage.distance.broadcastBytes")
        assert len(got) == 3
        for r in got:
            w = want[None if r["t"] is None or r["t"] != r["t"] else r["t"]]
            assert r["n"] == w["n"] and abs(r["mean"] - w["mean"]) < 1e-12 and (r["lo"], r["hi"]) == (w["lo"], w["hi"])
    nothing = a.withColumn("x", F.lit(None).cast("double"))
    assert [r[1] for r in M.nearest_neighbor_distance(nothing, b.fillna(0), COLS, by=["t"]).collect()] == [None] * 3


def test_guard_asks_only_rows_that_were_met(spark, monkeypatch):
    asked = []
    other = Y.nearest_other

    def counted(a, *args, **k):
        asked.append(a.count())
        return other(a, *args, **k)

    monkeypatch.setattr(Y, "nearest_other", counted)
    real, syn = _points(spark, 500), _points(spark, 20, 0.25)
    left = {r["row_id"] for r in Y.guard_identifiable(syn, real, COLS, 0.5).collect()}
    assert asked and asked[0] <= 20
    R = {r["row_id"]: (r["x"], r["y"]) for r in real.collect()}
    far = lambda p, q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5
    for r in syn.collect():
        d, i = min((far((r["x"], r["y"]), q), i) for i, q in R.items())
        own = min(far(R[i], q) for j, q in R.items() if j != i)
        assert (r["row_id"] in left) == (d >= 0.5 * own)
