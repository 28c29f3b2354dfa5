"""Extension surface (E1-E3): metrics, synthesizers and merge techniques by name.

The metric registry is also a table - ``metrics_table(spark)`` - with
(metric, kind, lo, hi, direction, information); composite scores (M9) join it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.operators import metrics as M
from mirage.operators import synth as Y
from mirage.operators import tournament
from mirage.operators.modes import MODES
from mirage.operators.private import private_fit


@dataclass
class MetricSpec:
    name: str
    kind: str            # 'privacy' | 'utility'
    fn: Callable         # (real, syn, cols, sensitive) -> one-row DataFrame, first column = value
    lo: float
    hi: float
    direction: int       # 1: large is good, 0: small is good
    information: str


_METRICS: dict[str, MetricSpec] = {}
_SYNTHS: dict[str, tuple] = {}
_TECHNIQUES: dict[str, tuple] = {}


def register_metric(name: str, kind: str, fn: Callable, lo: float = 0.0, hi: float = 1.0,
                    direction: int = 1, information: str = "") -> MetricSpec:
    """Add (or replace) a metric; ``fn(real, syn, cols, sensitive)`` returns
    a one-row DataFrame whose first column is the value."""
    if kind not in ("privacy", "utility"):
        raise ValueError("kind must be 'privacy' or 'utility'")
    spec = MetricSpec(name, kind, fn, float(lo), float(hi), int(direction), information)
    _METRICS[name] = spec
    return spec


def metric(name: str) -> MetricSpec:
    if name not in _METRICS:
        raise KeyError(f"unknown metric {name!r}")
    return _METRICS[name]


def metrics_table(spark: SparkSession) -> DataFrame:
    """``show_metrics()``: the registry as a table."""
    rows = [(s.name, s.kind, s.lo, s.hi, s.direction, s.information) for s in _METRICS.values()]
    return spark.createDataFrame(rows, "metric string, kind string, lo double, hi double, direction int, information string")


def compute_metric(name: str, real: DataFrame, syn: DataFrame, cols=None, sensitive=()) -> DataFrame:
    """(metric, value) for one metric."""
    out = metric(name).fn(real, syn, cols, list(sensitive or []))
    return out.select(F.lit(name).alias("metric"), F.col(out.columns[0]).cast("double").alias("value"))


_GROUPED = {
    "nearestneighbordistance": lambda r, s, c, by: M.nearest_neighbor_distance(r, s, c, by=by),
    "identifiabilityscore": lambda r, s, c, by: M.identifiability_oc(r, s, c, by=by),
    "inversekldivergence": lambda r, s, c, by: M.inverse_kl(r, s, c, by=by),
}


def compute_metric_by(name: str, real: DataFrame, syn: DataFrame, by, cols=None, sensitive=()) -> DataFrame:
    """(*by, metric, value): one metric for many tagged synthetic tables. Built-in
    distance and frequency metrics score every tag in the same scan; other
    metrics run once per tag (tags are few: sizes x attempts)."""
    by = list(by)
    if name in _GROUPED and _METRICS.get(name) is not None and _METRICS[name].fn is _DEFAULT_FN.get(name):
        out = _GROUPED[name](real, syn, cols, by)
        val = [c for c in out.columns if c not in by][0]
        return out.select(*by, F.lit(name).alias("metric"), F.col(val).cast("double").alias("value"))
    from functools import reduce
    parts = []
    for tg in syn.select(*by).distinct().collect():
        cond = None
        for t in by:
            c = F.col(t) == F.lit(tg[t])
            cond = c if cond is None else cond & c
        sub = syn.filter(cond).drop(*by)
        parts.append(compute_metric(name, real, sub, cols, sensitive).select(
            *[F.lit(tg[t]).alias(t) for t in by], "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def register_synthesizer(name: str, fit: Callable, gen: Callable) -> None:
    """``fit(df, **kw) -> model DataFrame``; ``gen(model, count, seed, attempt) -> DataFrame``."""
    _SYNTHS[name] = (fit, gen)


def synthesizer(name: str) -> tuple:
    if name not in _SYNTHS:
        raise KeyError(f"unknown synthesizer {name!r}")
    return _SYNTHS[name]


def generator_of(family: str | None) -> Callable:
    """The generator registered for a family; the built-in one for others."""
    return _SYNTHS[family][1] if family in _SYNTHS else Y.generate


def register_technique(name: str, privacy_proposals: Callable, utility_proposals: Callable) -> None:
    """A merge technique: two functions ``(cur, donors, n_donors, k, scorer,
    seed) -> (donor, row_id, features)`` that propose, for every donor, the table
    with up to ``k`` rows swapped. ``merge_tables`` looks its technique up here."""
    _TECHNIQUES[name] = (privacy_proposals, utility_proposals)


def technique(name: str) -> tuple:
    if name not in _TECHNIQUES:
        raise KeyError(f"unknown technique {name!r}")
    return _TECHNIQUES[name]


# Metric names, kinds, ranges and directions as the requests use them.
register_metric("nearestneighbordistance", "privacy",
                lambda r, s, c, z: M.nearest_neighbor_distance(r, s, c), 0.0, 1.0, 1,
                "Mean distance from each real row to its closest synthetic row, min-max scaled.")
register_metric("identifiabilityscore", "privacy",
                lambda r, s, c, z: M.identifiability_oc(r, s, c), 0.0, 1.0, 0,
                "Share of real rows closer to a synthetic row than to any other real row.")
register_metric("dataleakage", "privacy",
                lambda r, s, c, z: M.data_leakage(r, s, z, c), 0.0, 1.0, 0,
                "How well a model trained on synthetic rows predicts sensitive columns of real rows.")
register_metric("singlingout", "privacy",
                lambda r, s, c, z: M.singling_out(r, s, c).select("singling_out"), 0.0, 1.0, 0,
                "Risk that a predicate built from synthetic rows isolates exactly one real row.")
register_metric("inversekldivergence", "utility",
                lambda r, s, c, z: M.inverse_kl(r, s, c), 0.0, 1.0, 1,
                "Mean over columns of 1 / (1 + KL divergence) of the column frequencies.")

_DEFAULT_FN = {n: _METRICS[n].fn for n in _METRICS}

register_synthesizer("dp", lambda df, **kw: Y.dp_fit(df, **kw), Y.generate)
register_synthesizer("modes", lambda df, **kw: Y.modes_fit(df, **{"modes": MODES, **kw}), Y.generate)
register_synthesizer("private", lambda df, **kw: private_fit(df, **kw)[0], Y.generate)
register_technique("merge", tournament.privacy_proposals, tournament.utility_proposals)
register_synthesizer("ads", lambda df, **kw: Y.ads_fit(df, **kw), Y.generate)
