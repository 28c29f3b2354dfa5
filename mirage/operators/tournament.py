"""Merging in rounds, as a tournament.

A round draws one table from every donor. A technique (E3) proposes, for all donors
at once, the current table with some rows swapped for the donor's; the current
table, the donors' tables and all proposals carry the tags (step, donor), are
written together and scored by every metric in one grouped job. One row of the
scores decides what the next current table is:

* a privacy proposal counts if its donor passes ``donor_gate`` (G2) and its own
  composite privacy is not below the current one, a utility proposal if composite
  utility is not;
* of those, the least shortfall of the requirements (one-sided, R2, as a share of
  the metrics' ranges) wins, if it is below the current one.

Rounds end when no requirement is short, after ``MAX_IDLE`` rounds without a winner
or after ``MAX_ROUNDS``. Swaps keep the table's size; how many rows are swapped is
the requirement's amount (R3). The plans grow with the donors, not with the rows,
and nothing but scores (candidates x metrics) reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.draws import draw
from mirage.functions.ordering import TOPK_MAX, ordered_index, top_k_per_group
from mirage.operators.anchors import extreme_mean_distance
from mirage.operators.frequencies import bin_profile, column_frequencies, frequency_gaps
from mirage.operators.merge import FREQ_ERR, donor_gate
from mirage.session import cut_lineage

MAX_ROUNDS = 9
MAX_IDLE = 3
MAX_SHARE = 0.5  # of a table swapped in one round
_DONOR_IDS = 1 << 40


@dataclass
class Requirement:
    metric: str
    value: float
    tol: float

    def shortfall(self, v: float) -> float:
        """How far ``v`` is from "at least as good" (R2), as a share of the range;
        0 means met."""
        from mirage.plans.registry import metric
        s = metric(self.metric)
        gap = (self.value - self.tol - v) if s.direction == 1 else (v - self.value - self.tol)
        return max(gap, 1e-12) / (s.hi - s.lo) if gap >= 0 else 0.0

    def amount(self, v: float) -> float:
        """Share of the metric's range still to move."""
        from mirage.plans.registry import metric
        s = metric(self.metric)
        return ((self.value - v) if s.direction == 1 else (v - self.value)) / (s.hi - s.lo)


@dataclass
class Scorer:
    """The real table and the weights of the composite scores (M9)."""
    real: DataFrame
    cols: list
    privacy_weights: list = field(default_factory=lambda: [("nearestneighbordistance", 1.0)])
    utility_weights: list = field(default_factory=lambda: [("inversekldivergence", 1.0)])
    sensitive: list = field(default_factory=list)

    def __post_init__(self):
        self.real = cut_lineage(self.real.select("row_id", *self.cols))  # every round reads it

    def score(self, tagged: DataFrame, by: list, extra=()) -> dict:
        """{tag: {metric: value, "privacy": composite, "utility": composite}} of
        every tagged table, from one grouped job."""
        from mirage.plans.levels import score_tagged
        from mirage.plans.registry import metric
        weights = [("privacy", n, w) for n, w in self.privacy_weights] + [("utility", n, w) for n, w in self.utility_weights]
        weights = [x for x in weights if x[1] not in (None, "none")]
        names = sorted({n for _, n, _ in weights} | set(extra))
        out: dict = {}
        for r in score_tagged(self.real, tagged, names, by, self.cols, self.sensitive).collect():  # candidates x metrics
            out.setdefault(tuple(r[b] for b in by), {})[r["metric"]] = float(r["value"])
        for s in out.values():
            for kind in ("privacy", "utility"):
                s[kind] = 0.0
                for k, n, w in weights:
                    if k == kind:
                        m = metric(n)
                        share = (s[n] - m.lo) / (m.hi - m.lo)
                        s[kind] += w * (share if m.direction == 1 else 1.0 - share)
        return out


# --- proposals ---------------------------------------------------------------------

def _ranked(df: DataFrame, order: list, k: int, group: list | None = None) -> DataFrame:
    """The first ``k`` rows (of every group) with their ``rank`` from 1."""
    if k > TOPK_MAX:
        every = ordered_index(df, order, group_cols=group or [], name="rank").withColumn("rank", F.col("rank") + 1)
        return every.filter(F.col("rank") <= k)
    if group:
        return top_k_per_group(df, group, order, k)
    return top_k_per_group(df.withColumn("_all", F.lit(0)), ["_all"], order, k).drop("_all")  # at most k rows a salt


def swapped(cur: DataFrame, leaving: DataFrame, entering: DataFrame, donors: int) -> DataFrame:
    """(donor, row_id, ...): ``cur`` once per donor, with the first rows of
    ``leaving`` (row_id, rank) replaced by the donor's rows of ``entering`` (donor,
    rank, row_id, ...), as many as both have."""
    cols = [c for c in cur.columns if c != "row_id"]
    leaving = cut_lineage(leaving.select("row_id", F.col("rank").alias("_rank")))
    gone = leaving.count()
    given = entering.groupBy("donor").agg(F.max("rank").alias("_given"))
    every = cur.join(leaving, "row_id", "left").withColumn("donor", F.explode(F.array(*[F.lit(d) for d in range(donors)])))
    stay = every.join(F.broadcast(given), "donor", "left").filter(  # one row per donor
        F.col("_rank").isNull() | (F.col("_rank") > F.coalesce("_given", F.lit(0))))
    come = entering.filter(F.col("rank") <= gone)
    return stay.select("donor", "row_id", *cols).unionByName(come.select("donor", "row_id", *cols))


def privacy_proposals(cur: DataFrame, donors: DataFrame, n_donors: int, k: int, scorer: Scorer, seed) -> DataFrame:
    """Rows most alike to the rest of ``cur`` make way for the donor's rows most
    unlike ``cur`` (G1 for all donors in one pass over the distances)."""
    leaving = _ranked(extreme_mean_distance(cur, cur, scorer.cols, k), ["mean_dist", "row_id"], k)
    unlike = extreme_mean_distance(donors, cur, scorer.cols, k, True, group="donor").join(donors.select("row_id", "donor"), "row_id")
    chosen = _ranked(unlike, [F.desc("mean_dist"), "row_id"], k, ["donor"])
    return swapped(cur, leaving, donors.join(chosen.select("row_id", "rank"), "row_id"), n_donors)


def utility_proposals(cur: DataFrame, donors: DataFrame, n_donors: int, k: int, scorer: Scorer, seed, err: float = FREQ_ERR) -> DataFrame:
    """Rows in over-represented bins make way for the donor's rows in
    under-represented ones, all columns at once: a row weighs the gaps of its bins
    (A6), the heaviest leave, the donor's lightest enter. The gaps of columns with a
    bin outside the band (A5) count, those of all columns if there is none."""
    freqs = column_frequencies(scorer.real, cur, scorer.cols)
    gaps = frequency_gaps(freqs, 0.0).collect()  # at most columns x bins rows
    broken = {g["column"] for g in gaps if g["gap"] > err}
    gaps = [g for g in gaps if not broken or g["column"] in broken]
    prof = {r["column"]: r for r in bin_profile(scorer.real, scorer.cols).collect()}
    weight = F.lit(0.0)
    for g in gaps:
        p, v = prof[g["column"]], F.col(g["column"]).cast("double")
        if p["categorical"]:
            inside = v == F.lit(g["bin"])
        else:
            width = (p["hi"] - p["lo"]) / p["n_bins"]
            last = g["bin"] > p["hi"] - 1.5 * width
            inside = (v >= F.lit(g["bin"])) & ((v <= F.lit(p["hi"])) if last else (v < F.lit(g["bin"] + width)))
        size = g["gap"] if g["kind"] == "over" else -g["gap"]
        weight = weight + F.when(inside, F.lit(float(size))).otherwise(F.lit(0.0))
    heavy = cur.select("row_id", weight.alias("_w"), draw(seed, "leave", F.col("row_id")).alias("_u")).filter("_w > 0")
    leaving = _ranked(heavy, [F.desc("_w"), "_u", "row_id"], k)
    light = donors.select("row_id", "donor", weight.alias("_w")).filter("_w < 0")
    chosen = _ranked(light, ["_w", "row_id"], k, ["donor"])
    return swapped(cur, leaving, donors.join(chosen.select("row_id", "rank"), "row_id"), n_donors)


# --- rounds ----------------------------------------------------------------------------

HISTORY = ("round int, step string, donor int, privacy double, utility double, privacy_score double, utility_score double, "
           "shortfall double, chosen boolean")


def merge_round(cur: DataFrame, donors: list, scorer: Scorer, needs: dict, score: dict | None, size: int, technique: str, seed: int,
                number: int) -> tuple[DataFrame, dict, tuple | None]:
    """One round: (all tagged tables as written, their scores, the winner's tag)."""
    from mirage.plans.registry import technique as technique_of
    metrics = [r.metric for r in needs.values()]
    tables = [make(seed + number).select(F.lit(i).alias("donor"), (F.col("row_id") + F.lit((i + 1) * _DONOR_IDS)).alias("row_id"), *scorer.cols)
              for i, make in enumerate(donors)]
    drawn = cut_lineage(reduce(DataFrame.unionByName, tables))
    if score is None:  # the start: later rounds know the scores of what won
        score = scorer.score(cur.withColumn("step", F.lit("current")), ["step"], metrics)[("current",)]
    propose = dict(zip(("privacy", "utility"), technique_of(technique), strict=True))
    parts = [drawn.withColumn("step", F.lit("donor"))]
    for kind, need in needs.items():
        if need.shortfall(score[need.metric]) > 0:
            share = min(max(abs(need.amount(score[need.metric])), 1.0 / size), MAX_SHARE)
            parts.append(propose[kind](cur, drawn, len(donors), max(int(size * share), 1), scorer, seed + number).withColumn("step", F.lit(kind)))
    every = cut_lineage(reduce(DataFrame.unionByName, [p.select("step", "donor", "row_id", *scorer.cols) for p in parts]))
    scores = scorer.score(every, ["step", "donor"], metrics)
    scores["current", -1] = score
    spark = cur.sparkSession
    gate = {r["donor"] for r in donor_gate(score["privacy"], spark.createDataFrame(
        [(d, s["privacy"]) for (step, d), s in scores.items() if step == "donor"], "donor int, score double")).collect()}
    fit = [(sum(r.shortfall(s[r.metric]) for r in needs.values()), step, d) for (step, d), s in scores.items()
           if step == "privacy" and d in gate and s["privacy"] >= score["privacy"] or step == "utility" and s["utility"] >= score["utility"]]
    now = sum(r.shortfall(score[r.metric]) for r in needs.values())
    best = min(fit, default=None)
    return every, scores, best[1:] if best is not None and best[0] < now else None


def merge_tables(start: DataFrame, donors: list, scorer: Scorer, size: int, privacy: Requirement | None = None,
                 utility: Requirement | None = None, technique: str = "merge", seed: int = 0,
                 rounds: int = MAX_ROUNDS) -> tuple[DataFrame | None, DataFrame]:
    """Rounds from ``start`` until both requirements are met. ``donors``:
    callables ``make(attempt) -> DataFrame``. Returns (the merged table or None,
    the rounds' scores)."""
    spark = start.sparkSession
    needs = {k: r for k, r in (("privacy", privacy), ("utility", utility)) if r is not None}
    cur, score, idle, history = cut_lineage(start.select("row_id", *scorer.cols)), None, 0, []

    def met(s) -> bool:
        return all(r.shortfall(s[r.metric]) == 0 for r in needs.values())

    def note(number, step, donor, s, chosen):
        history.append((number, step, donor, s.get(privacy.metric) if privacy else None, s.get(utility.metric) if utility else None,
                        s["privacy"], s["utility"], float(sum(r.shortfall(s[r.metric]) for r in needs.values())), chosen))

    for number in range(rounds):
        if score is not None and (met(score) or idle >= MAX_IDLE):
            break
        if score is None:
            score = scorer.score(cur.withColumn("step", F.lit("current")), ["step"], [r.metric for r in needs.values()])[("current",)]
            note(-1, "start", -1, score, True)
            if met(score):
                break
        every, scores, winner = merge_round(cur, donors, scorer, needs, score, size, technique, seed, number)
        for (step, donor), s in sorted(scores.items()):
            if step != "current":
                note(number, step, donor, s, (step, donor) == winner)
        if winner is None:
            idle += 1
            continue
        idle, score = 0, scores[winner]
        won = every.filter((F.col("step") == winner[0]) & (F.col("donor") == winner[1])).select("row_id", *scorer.cols)
        cur = cut_lineage(_renumbered(won))
    return (cur if met(score) else None), spark.createDataFrame(history, HISTORY)


def _renumbered(df: DataFrame) -> DataFrame:
    return ordered_index(df.withColumnRenamed("row_id", "_old"), ["_old"], name="row_id").drop("_old")


def increase_privacy(cur: DataFrame, donors: list, req: Requirement, scorer: Scorer, size: int, seed: int = 0,
                     technique: str = "merge") -> tuple[DataFrame | None, DataFrame]:
    """Rounds with the privacy step alone."""
    return merge_tables(cur, donors, scorer, size, privacy=req, technique=technique, seed=seed)


def increase_utility(cur: DataFrame, donors: list, req: Requirement, scorer: Scorer, size: int, seed: int = 0,
                     technique: str = "merge") -> tuple[DataFrame | None, DataFrame]:
    """Rounds with the utility step alone."""
    return merge_tables(cur, donors, scorer, size, utility=req, technique=technique, seed=seed)
