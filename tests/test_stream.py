"""Batches of a stream: scores kept, replays, pending requests served later."""

import pytest
from pyspark.sql import functions as F

from mirage.operators import synth as Y
from mirage.plans import levels as L
from mirage.plans.requirements import REQUEST_SCHEMA
from mirage.streaming import serve as S

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def real(spark):
    return spark.createDataFrame([(i, float((i * 37) % 100), float(min(i % 13, 6))) for i in range(300)], "row_id long, a double, b double")


def requests(spark, rows):
    """(id, level, size, wanted utility)"""
    return spark.createDataFrame([(i, lv, s, None, None, "inversekldivergence", u, 0.3) for i, lv, s, u in rows], REQUEST_SCHEMA)


def level(spark, name, created):
    return L.create_level(spark, name, [("nearestneighbordistance", (0.2, 0.2))], [("inversekldivergence", (0.8, 0.8))], created=created)


@pytest.fixture
def drawn(monkeypatch):
    seen = []
    make = L._candidates

    def counted(real, combos, *a):
        seen.append(sorted(combos))
        return make(real, combos, *a)

    monkeypatch.setattr(L, "_candidates", counted)
    return seen


def outcomes(spark, out):
    return {r["request_id"]: (r["level"], r["attempt"], r["status"]) for r in S.served_requests(spark, out).collect()}


def test_second_batch_draws_nothing_and_replay_changes_nothing(spark, real, drawn, tmp_path):
    out = f"file://{tmp_path}/a"
    levels, models = level(spark, "l1", 0), {"l1": Y.dp_fit(real, 8.0, 1, COLS)}
    first = requests(spark, [(1, "l1", 100, 0.8), (2, "any", 200, 0.8), (3, "any", 100, 0.01)])
    S.serve_batch(first, 0, out, real, levels, models, seed=4, cols=COLS)
    assert drawn == [[("l1", 100), ("l1", 200)]]
    S.serve_batch(requests(spark, [(4, "any", 200, 0.8), (5, "l1", 100, 0.8)]), 1, out, real, levels, models, seed=4, cols=COLS)
    assert len(drawn) == 1
    got, scores = outcomes(spark, out), S.known_scores(spark, out).count()
    assert got[1][2] == got[4][2] == "served" and got[2][1:] == got[4][1:] and scores == 2 * L.ATTEMPTS
    both = first.unionByName(requests(spark, [(4, "any", 200, 0.8), (5, "l1", 100, 0.8)]))
    want = {r["request_id"]: (r["level"], r["attempt"], r["status"]) for r in
            L.serve(real, both, levels, models, seed=4, cols=COLS).collect()}
    assert got == want
    drawn.clear()  # ``serve`` above draws its own
    S.serve_batch(first, 0, out, real, levels, models, seed=4, cols=COLS)
    assert outcomes(spark, out) == got and S.known_scores(spark, out).count() == scores and drawn == []
    S.serve_batch(requests(spark, [(6, "any", 150, 0.8)]), 2, out, real, levels, models, seed=4, cols=COLS)
    assert drawn == [[("l1", 150)]]


def test_pending_requests_are_served_when_a_level_comes(spark, real, drawn, tmp_path):
    out = f"file://{tmp_path}/b"
    none = level(spark, "l1", 0).limit(0)
    S.serve_batch(requests(spark, [(1, "new", 100, 0.8), (2, "any", 50, 0.8)]), 0, out, real, none, {}, seed=4, cols=COLS)
    assert {r["request_id"] for r in S.pending_requests(spark, out).collect()} == {1, 2} and drawn == []
    levels, models = level(spark, "new", 3), {"new": Y.dp_fit(real, 8.0, 1, COLS)}
    S.serve_pending(out, 0, real, levels, models, seed=4, cols=COLS)
    got = outcomes(spark, out)
    assert {v[2] for v in got.values()} == {"served"} and S.pending_requests(spark, out).count() == 0
    S.serve_pending(out, 1, real, levels, models, seed=4, cols=COLS)
    assert outcomes(spark, out) == got


def test_a_level_made_again_is_scored_anew(spark, real, drawn, tmp_path):
    out = f"file://{tmp_path}/c"
    ask = lambda i: requests(spark, [(i, "any", 100, 0.8)])
    S.serve_batch(ask(1), 0, out, real, level(spark, "l1", 0), {"l1": Y.dp_fit(real, 8.0, 1, COLS)}, seed=4, cols=COLS)
    S.serve_batch(ask(2), 1, out, real, level(spark, "l1", 5), {"l1": Y.dp_fit(real, 0.5, 2, COLS)}, seed=4, cols=COLS)
    assert len(drawn) == 2
    assert S.known_scores(spark, out).groupBy("created").count().orderBy("created").collect() == [(0, L.ATTEMPTS), (5, L.ATTEMPTS)]


def test_an_empty_batch_and_a_rejected_request(spark, real, tmp_path):
    out = f"file://{tmp_path}/d"
    levels, models = level(spark, "l1", 0), {"l1": Y.dp_fit(real, 8.0, 1, COLS)}
    assert S.serve_batch(requests(spark, []), 0, out, real, levels, models, cols=COLS).count() == 0
    bad = spark.createDataFrame([(9, "any", 100, None, None, None, None, 0.1)], REQUEST_SCHEMA)
    assert [r["status"] for r in S.serve_batch(bad, 1, out, real, levels, models, cols=COLS).collect()] == ["rejected"]
    assert S.pending_requests(spark, out).filter(F.col("request_id") == 9).count() == 0
