"""Deterministic uniform draws.

``draw(seed, tag, id)`` maps a (seed, tag, id) triple to a uniform number in
(0, 1) through the first 32 bits of an md5 digest. It never returns 0 or 1, so
``ln`` of it or of ``1 - it`` is always defined. Being a pure function of its
inputs it is stable under recomputation (lost executors, retried stages), which
``rand()`` is not, and another engine can reproduce it exactly:

    (('0x' || substr(md5(concat_ws('|', seed, tag, id)), 1, 8))::BIGINT + 0.5) / 4294967296
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def draw(seed, tag, id_, bits: int = 32) -> Column:
    """``bits`` 52 takes 13 hex digits instead of 8: for noise that must not be
    guessed from its grain (secret seeds)."""
    key = F.concat_ws("|", _c(seed).cast("string"), _c(tag).cast("string"), _c(id_).cast("string"))
    word = F.conv(F.substring(F.md5(key), 1, bits // 4), 16, 10).cast("bigint")
    return (word.cast("double") + F.lit(0.5)) / F.lit(float(1 << bits))


def draw_sql(seed: str, tag: str, id_: str) -> str:
    """The same draw as a DuckDB SQL expression (for oracles)."""
    return (f"((('0x' || substr(md5(concat_ws('|', {seed}, {tag}, {id_})), 1, 8))::BIGINT + 0.5)"
            f" / 4294967296.0)")


def fresh_seed() -> int:
    """A seed nobody can predict; use it when noise protects real data."""
    return secrets.randbits(52)
