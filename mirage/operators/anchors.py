"""Rows of the least or greatest mean distance without all pairs.

A mean distance needs every row of the other table, but the first k rows of an order
by mean distance need it for few rows only:

1. anchors (the rows of least draw) cut the other table into cells; a cell's count,
   centroid c and variance V are one map-side combined aggregate per anchor;
2. for a row x, Jensen's inequality bounds its mean distance to a cell from below by
   |x - c| and from above by sqrt(|x - c|^2 + V), so the cells' shares give an
   interval for its mean distance: rows x anchors arithmetic;
3. the k-th best guaranteed end is a cut; only rows whose interval reaches it get
   their exact mean distance.

The result holds every row that can be among the first k, with exact distances, so an
order over it begins as the order over all rows does, ties included. Intervals are
widened by more than rounding can move them. Rows with a null feature have a null
distance and stay. Tables of up to one distance block are measured exactly at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.draws import draw
from mirage.functions.ordering import TOPK_MAX, ordered_index, take_first, top_k_per_group
from mirage.operators.distance import DEFAULT_BLOCK_ROWS, _conf_int, _spread, mean_distance_cross
from mirage.session import cut_lineage

ANCHORS = 256
_SLACK = 1e-9


def _numbers(df: DataFrame, cols, id_col: str, extra=()) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(id_col), *extra, *[F.col(c).cast("double").alias(c) for c in cols])


def _blocks(n: int, m: int, c: int):
    step = max(1, (1 << 21) // max(1, m * c))
    return ((i, min(i + step, n)) for i in range(0, n, step))


def _cells(b: DataFrame, cols, anchors: int, id_col: str):
    """(shares, centroids, variances, largest coordinate) of the cells of ``b``: at
    most ``anchors`` rows reach the driver. None for a table without whole rows."""
    spark, c = b.sparkSession, len(cols)
    whole = _numbers(b, cols, id_col).dropna(subset=list(cols))
    first = whole.orderBy(draw(0, "anchor", F.col(id_col)), id_col, *cols).limit(anchors).select(*cols).collect()
    if not first:
        return None
    places = spark.sparkContext.broadcast(np.unique(np.array([list(map(float, r)) for r in first]), axis=0))
    sums = [f"s{i}" for i in range(c)]

    def assign(it):
        A = places.value
        total = np.zeros((len(A), c + 2))
        top = 0.0
        for p in it:
            X = p[list(cols)].to_numpy(np.float64)
            if len(X):
                top = max(top, float(np.abs(X).max()))
            for i, j in _blocks(len(X), len(A), c):
                diff = X[i:j, None, :] - A[None, :, :]
                d2 = np.einsum("ijk,ijk->ij", diff, diff)
                near = d2.argmin(axis=1)
                rows = np.arange(j - i)
                np.add.at(total, near, np.concatenate([np.ones((j - i, 1)), diff[rows, near], d2[rows, near][:, None]], axis=1))
        used = np.flatnonzero(total[:, 0])
        out = pd.DataFrame(total[used], columns=["n", *sums, "q"])
        out.insert(0, "cell", used.astype(np.int64))
        out["top"] = top
        yield out

    part = whole.select(*cols).mapInPandas(assign, "cell long, n double, " + ", ".join(f"{s} double" for s in sums) + ", q double, top double")
    got = part.groupBy("cell").agg(*[F.sum(x).alias(x) for x in ["n", *sums, "q"]], F.max("top").alias("top")).toPandas()
    n = got["n"].to_numpy()
    shift = got[sums].to_numpy() / n[:, None]
    spread = got["q"].to_numpy() / n
    var = np.maximum(spread - (shift ** 2).sum(axis=1), 0.0) + 1e-12 * spread
    return n / n.sum(), places.value[got["cell"].to_numpy()] + shift, var, float(got["top"].max())


def mean_distance_bounds(a: DataFrame, b: DataFrame, cols, anchors: int = ANCHORS, id_col: str = "row_id", extra=()) -> DataFrame:
    """(row id, extra..., lo, hi): an interval that holds the mean distance of each
    row of ``a`` to the rows of ``b``; null ends for a row with a null feature."""
    cols, extra = list(cols), list(extra)
    found = _cells(b, cols, anchors, id_col)
    asel = _numbers(a, cols, id_col, extra)
    if found is None:
        return asel.select(id_col, *extra, F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    cells = a.sparkSession.sparkContext.broadcast(found)  # at most `anchors` rows
    types = {f.name: f.dataType.simpleString() for f in asel.schema.fields}

    def bound(it):
        share, centre, var, top = cells.value
        for p in it:
            X = p[cols].to_numpy(np.float64)
            lo, hi = np.empty(len(X)), np.empty(len(X))
            for i, j in _blocks(len(X), len(share), len(cols)):
                diff = X[i:j, None, :] - centre[None, :, :]
                d2 = np.einsum("ijk,ijk->ij", diff, diff)
                lo[i:j] = np.sqrt(d2) @ share
                hi[i:j] = np.sqrt(d2 + var) @ share
            out = p[[id_col, *extra]].copy()
            room = _SLACK * hi + 1e-12 * np.maximum(np.abs(X).max(axis=1, initial=0.0), top)
            out["lo"], out["hi"] = lo - room, hi + room
            yield out

    schema = ", ".join(f"`{x}` {types[x]}" for x in [id_col, *extra]) + ", lo double, hi double"
    return _spread(asel).mapInPandas(bound, schema)


def contenders(bounds: DataFrame, k: int, descending: bool, id_col: str = "row_id", group: str | None = None) -> DataFrame:
    """Ids of the rows of ``bounds`` that can be among the first ``k`` (of their
    group): those not worse at best than k others are at worst."""
    order = [F.col("lo").desc(), F.col(id_col)] if descending else [F.col("hi").asc(), F.col(id_col)]
    whole = bounds.filter(F.col("lo").isNotNull())
    if group is None:
        first = take_first(whole, order, k)
        cut = first.agg(F.count(F.lit(1)).alias("_n"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        row = cut.first()
        if row["_n"] < k:
            return bounds.select(id_col)
        inside = F.col("hi") >= F.lit(row["_lo"]) if descending else F.col("lo") <= F.lit(row["_hi"])
        return bounds.filter(F.col("lo").isNull() | inside).select(id_col)
    first = (top_k_per_group(whole, [group], order, k) if k <= TOPK_MAX
             else ordered_index(whole, order, group_cols=[group], name="rank").filter(F.col("rank") < k))
    cut = first.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    far = F.col("hi") < F.col("_lo") if descending else F.col("lo") > F.col("_hi")
    out = bounds.join(F.broadcast(cut), F.col(group).eqNullSafe(F.col("_g")), "left")  # groups are donors
    return out.filter(~F.coalesce(far & (F.col("_n") >= k), F.lit(False))).select(id_col)


def extreme_mean_distance(a: DataFrame, b: DataFrame, cols, k: int, descending: bool = False, anchors: int = ANCHORS,
                          id_col: str = "row_id", name: str = "mean_dist", group: str | None = None,
                          exact_rows: int | None = None) -> DataFrame:
    """(row id, mean distance to ``b``) of every row of ``a`` that can be among the
    first ``k`` by it (of its ``group`` column's value), and of few others. Tables
    ``b`` of up to ``exact_rows`` rows (default: a distance block) need no bounds."""
    block = exact_rows if exact_rows is not None else _conf_int(a.sparkSession, "mirage.distance.blockRows", DEFAULT_BLOCK_ROWS)
    if k <= 0 or b.limit(block + 1).count() <= block:
        return mean_distance_cross(a, b, cols, id_col, name)
    bounds = cut_lineage(mean_distance_bounds(a, b, cols, anchors, id_col, [group] if group else []))
    return mean_distance_cross(a.join(contenders(bounds, k, descending, id_col, group), id_col, "left_semi"), b, cols, id_col, name)
