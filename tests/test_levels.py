"""Published levels, merging rounds, epsilon search and preparation."""

import pytest
from pyspark.sql import functions as F

from mirage.operators import merge as G
from mirage.operators import synth as Y
from mirage.operators import tournament as TM
from mirage.plans import levels as L
from mirage.plans import search as S
from mirage.sources.io import Store


@pytest.fixture(scope="module")
def real(spark):
    rows = [(i, float((i * 37) % 100), float(min(i % 13, 6)), float((i * i) % 50)) for i in range(400)]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double")


COLS = ["a", "b", "c"]


def rows_of(spark, level, value):
    return L.create_level(spark, level, [("nearestneighbordistance", (value, value))], [("inversekldivergence", (0.9, 0.9))])


# --- publication ---------------------------------------------------------------------

def test_publish_is_all_or_nothing(spark, real, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    model = Y.dp_fit(real, 4.0, 1, COLS)
    assert store.publish("x/ y'", rows_of(spark, "x/ y'", 0.2), model=model, family="dp", cache=real, report=rows_of(spark, "r", 0.1))
    assert store.read_levels().select("level").distinct().collect()[0][0] == "x/ y'"
    assert store.load_model("x/ y'", "dp").count() == model.count() and store.cache_get("x/ y'").count() == 400
    assert [r["level"] for r in store.cached_levels().collect()] == ["x/ y'"] and store.report_of("x/ y'").count() == 2

    def stop(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # fails after the parts are written, before the commit
        m.setattr(store, "_commit", stop)
        with pytest.raises(RuntimeError):
            store.publish("z", rows_of(spark, "z", 0.5), cache=real)
    assert "z" not in store.published() and store.cache_get("z") is None
    assert store.read_levels().filter("level = 'z'").count() == 0
    assert store.publish("z", rows_of(spark, "z", 0.6), cache=real.limit(7))  # the retry
    assert store.cache_get("z").count() == 7 and store.read_levels().filter("level = 'z'").count() == 2


def test_two_writers_of_one_level(spark, real, tmp_path, monkeypatch):
    a, b = Store(spark, f"file://{tmp_path}/store"), Store(spark, f"file://{tmp_path}/store")
    assert a.publish("x", rows_of(spark, "x", 0.1), cache=real.limit(3))
    commit, seen = b._commit, []

    def late(folder, number, entry):  # the other writer commits the same number first
        if not seen:
            seen.append(a.publish("x", rows_of(spark, "x", 0.2), cache=real.limit(4)))
        return commit(folder, number, entry)

    monkeypatch.setattr(b, "_commit", late)
    assert not b.publish("x", rows_of(spark, "x", 0.3), cache=real.limit(5))
    assert seen == [True] and a.cache_get("x").count() == 4
    a.remove_level("x")
    assert a.published() == {} and a.read_levels().count() == 0 and a.cache_get("x") is None
    assert a.publish("x", rows_of(spark, "x", 0.4)) and a.read_levels().count() == 2


# --- merging -----------------------------------------------------------------------------

def donors(real, *eps, size=200):
    return [lambda a, m=Y.dp_fit(real, e, 3 + i, COLS): Y.generate(m, size, 5, attempt=a) for i, e in enumerate(eps)]


def test_utility_rounds_act_and_keep_the_size(spark, real):
    start = Y.generate(Y.dp_fit(real, 0.02, 2, COLS), 200, 5)
    scorer = TM.Scorer(real, COLS)
    base = scorer.score(start.withColumn("t", F.lit(0)), ["t"])[(0,)]["inversekldivergence"]
    out, history = TM.increase_utility(start, donors(real, None, 8.0), TM.Requirement("inversekldivergence", base + 0.05, 0.02), scorer, 200, 5)
    rows = history.collect()
    assert out.count() == 200 and out.select("row_id").distinct().count() == 200
    assert out.select(COLS).exceptAll(start.select(COLS)).count() > 0
    assert scorer.score(out.withColumn("t", F.lit(0)), ["t"])[(0,)]["inversekldivergence"] > base + 0.03
    assert [r for r in rows if r["chosen"] and r["step"] == "utility"] and {r["step"] for r in rows} == {"start", "donor", "utility"}


def test_privacy_proposals_swap_alike_for_unlike(spark, real):
    """The proposal equals the one-donor step (G1) on the same tables."""
    scorer = TM.Scorer(real, COLS)
    cur = real.filter("row_id < 60")
    other = [real.filter("row_id >= 300"), real.filter("row_id between 200 and 280")]
    drawn = None
    for i, o in enumerate(other):
        d = o.select(F.lit(i).alias("donor"), (F.col("row_id") + (i + 1) * TM._DONOR_IDS).alias("row_id"), *COLS)
        drawn = d if drawn is None else drawn.unionByName(d)
    got = TM.privacy_proposals(cur, drawn, 2, 6, scorer, 1)
    for i, o in enumerate(other):
        want = G.privacy_merge_step(cur, o, 60, 0.1, COLS)
        assert sorted(map(tuple, got.filter(F.col("donor") == i).select(COLS).collect())) == sorted(map(tuple, want.select(COLS).collect()))


def test_rounds_without_a_way_end(spark, real):
    """Three rounds without a winner are the end; a requirement met from the start needs none."""
    out, history = TM.increase_privacy(real, donors(real, 8.0), TM.Requirement("nearestneighbordistance", 0.99, 0.0), TM.Scorer(real, COLS), 200)
    assert out is None and max(r["round"] for r in history.collect()) < TM.MAX_ROUNDS
    met, history = TM.merge_tables(real, donors(real, 8.0), TM.Scorer(real, COLS), 400, utility=TM.Requirement("inversekldivergence", 0.5, 0.0))
    assert met.count() == 400 and [r["step"] for r in history.collect()] == ["start"]  # one-sided: better is met


def test_thinned_bins_keep_the_size(spark, real):
    heavy = real.filter("a < 50").withColumn("row_id", F.monotonically_increasing_id())
    few = real.filter("a >= 90").limit(5)
    out = G.thin_bins(heavy, few, real, "a", 0.05)
    assert out.count() == heavy.count() and out.filter("a >= 90").count() == 5
    drawn = G.thin_bins(heavy, lambda attempt: real.filter((F.col("a") >= 60) & (F.col("row_id") % 4 == attempt)), real, "a", 0.05)
    assert drawn.count() == heavy.count() and drawn.filter("a >= 60").count() > 5


# --- search and preparation -----------------------------------------------------------------

def wanted(spark, *rows):
    return spark.createDataFrame(rows, "level string, privacy_metric string, privacy_value double, utility_metric string, utility_value double, tol double")


def test_search_ends_inside_or_failed(spark, real):
    w = wanted(spark, ("easy", None, None, "inversekldivergence", 0.9, 0.12), ("never", None, None, "inversekldivergence", 0.2, 0.01))
    got = {r["level"]: r for r in S.search_epsilons(real, w, 200, 4, COLS, restarts=1).collect()}
    assert got["easy"]["status"] == "done" and abs(got["easy"]["u_val"] - 0.9) <= 0.12 and S.LOW <= got["easy"]["epsilon"] <= S.HIGH
    assert got["never"]["status"] == "failed" and got["never"]["restarts"] == 1
    assert S.search_epsilons(real, w.filter("false"), 200, 4, COLS).count() == 0


def test_prepared_level_serves_what_was_pending(spark, real, tmp_path):
    models = {"weak": Y.dp_fit(real, 0.05, 1, COLS), "fine": Y.dp_fit(real, 8.0, 2, COLS)}
    store = Store(spark, f"file://{tmp_path}/store")
    reqs = spark.createDataFrame([(1, "new", 150, None, None, "inversekldivergence", 0.97, 0.05), (2, "new", 150, None, None, "inversekldivergence", 0.97, 0.05)],
                                 "request_id long, level string, size int, privacy_metric string, privacy_value double, utility_metric string, "
                                 "utility_value double, tol double")
    none = L.create_level(spark, "weak", [], [("inversekldivergence", (0.5, 0.5))])
    assert {r["status"] for r in L.serve(real, reqs, none, models, store, 2, 3, COLS).collect()} == {"pending"}
    out = S.prepare(real, reqs, none, models, store, size=300, seed=3, cols=COLS, sizes=(100, 200), repeats=2)
    assert {(r["request_id"], r["outcome"]) for r in out.collect()} <= {(1, "merged"), (2, "merged"), (1, "searched"), (2, "searched")} and out.count() == 2
    levels = none.unionByName(store.read_levels())
    assert "new" in store.published()
    served = L.serve(real, reqs, levels, models, store, 3, 3, COLS).collect()
    assert {(r["level"], r["status"]) for r in served} == {("new", "served")}
    again = S.prepare(real, reqs, levels, models, store, size=300, seed=3, cols=COLS)
    assert {r["outcome"] for r in again.collect()} == {"exists"}


def test_pending_requests_are_computed_once(spark, real):
    """Pending requests may be the end of a whole serve: preparation doesn't run it anew for every use."""
    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for p in it:
            seen.add(len(p))
            yield p

    reqs = spark.createDataFrame([(i, "weak", 150, None, None, "inversekldivergence", 0.97, 0.05) for i in range(40)],
                                 "request_id long, level string, size int, privacy_metric string, privacy_value double, utility_metric string, "
                                 "utility_value double, tol double")
    levels = L.create_level(spark, "weak", [], [("inversekldivergence", (0.5, 0.5))])
    out = S.prepare(real, reqs.mapInPandas(count, reqs.schema), levels, {}, seed=3, cols=COLS).collect()
    assert sorted((r["request_id"], r["outcome"]) for r in out) == [(i, "exists") for i in range(40)]
    assert seen.value == 40
