"""Requirement arithmetic as column expressions.

All of these work on a column per metric value so a whole table of candidates,
levels or requests is judged in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def satisfied(required, value, err) -> Column:
    """Two-sided, required - err <= value <= required + err."""
    return _c(value).between(_c(required) - _c(err), _c(required) + _c(err))


def at_least(required, value, err, direction) -> Column:
    """R2: strict one-sided "at least as good": dir 1 v > req - e, dir 0 v < req + e."""
    return (F.when(_c(direction) == 1, _c(value) > _c(required) - _c(err))
            .otherwise(_c(value) < _c(required) + _c(err)))


def amount(required, value, lo, hi, direction) -> Column:
    """Signed share of the metric range still to move."""
    span = _c(hi) - _c(lo)
    return (F.when(_c(direction) == 1, (_c(required) - _c(value)) / span)
            .otherwise((_c(value) - _c(required)) / span))


def normalize(value, lo, hi, direction) -> Column:
    """M8: scale to [0, 1] and flip so that 1 is always the good end."""
    n = (_c(value) - _c(lo)) / (_c(hi) - _c(lo))
    return F.when(_c(direction) == 1, n).otherwise(F.lit(1.0) - n)
