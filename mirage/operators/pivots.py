"""Exact nearest neighbours of large tables by pivot cells.

0. Of equal rows of B the two of least id are enough: a row of A needs one of them, or
   the other where the first is its own. Values that many rows share add no visits.
1. Pivots: rows of B, the first by hash of their id, about two per block of B and at
   most ``MAX_PIVOTS``. Every row of B goes to the cell of its nearest pivot; a cell
   has its radius (largest distance to its pivot) and, if it has more rows than a
   block, several parts.
2. Round one: every row of A visits one part of its own cell (the nearest pivot's).
   The least distance there is an upper bound of its result.
3. Round two: it visits the other parts and cells whose distance to their pivot less
   their radius is not above that bound; by the triangle inequality no other cell can
   have a closer row. The least of both rounds is exact.

Visits are rows (row of A, cell, part). On clustered data a row visits a few parts
however many there are; nothing is replicated to parts it can't need. Both sides of a
visit are bounded: parts of B by the block, rows of A by splitting a busy part's
visitors, to each split of which the part is sent. Pivots and the cells' sizes and
radii (at most ``MAX_PIVOTS`` rows a tag) are all that the driver sees.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirage.session import cut_lineage

MAX_PIVOTS = 16384
VISITOR_ROWS = 65536
_CHUNK = 1024


def _distances(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (X * X).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * (X @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _slack(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What rounding may add to a distance computed as above."""
    return 1e-7 * (np.sqrt((X * X).sum(1)) + math.sqrt(float((pivots * pivots).sum(1).max())) + 1e-30)


def _two_of_equals(b: DataFrame, cols, by) -> DataFrame:
    """Of equal rows (of a tag) the two of least id. The rank's limit also runs before
    the shuffle, so a value that most rows hold doesn't meet in one task."""
    w = Window.partitionBy(*by, *cols).orderBy("_bid")
    return b.dropDuplicates(["_bid", *by, *cols]).withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= 2).drop("_nth")


def _visit(visits: DataFrame, b: DataFrame, cols, id_col: str, by, kernel, argmin: bool) -> DataFrame:
    """(id, by, _v[, _a]) of every visit: the least squared distance in that part."""
    keys = [*by, "_cell", "_part"]
    busy = visits.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / VISITOR_ROWS).cast("long").alias("_splits"))
    tagged = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    busy = busy.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_splits")
    on = reduce(lambda x, y: x & y, tagged)
    drop = [f"_k{i}" for i in range(len(keys))]
    left = visits.join(busy, on).drop(*drop).withColumn("_split", F.pmod(F.xxhash64(id_col), F.col("_splits"))).drop("_splits")
    right = b.join(busy, on).drop(*drop).withColumn("_split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_splits") - 1))).drop("_splits")
    types = {f.name: f.dataType.simpleString() for f in visits.schema.fields}

    def pair(x, y):
        A, ida = x[cols].to_numpy(np.float64), x[id_col].to_numpy(np.int64)
        got = kernel(A, ida, y[cols].to_numpy(np.float64), y["_bid"].to_numpy(np.int64))
        out = x[[id_col, *by]].copy()
        out["_v"] = got[0] if argmin else got
        if argmin:
            out["_a"] = got[1]
        return out

    schema = ", ".join([f"{id_col} long", *[f"`{t}` {types[t]}" for t in by], "_v double", *(["_a long"] if argmin else [])])
    return left.groupBy(*keys, "_split").cogroup(right.groupBy(*keys, "_split")).applyInPandas(pair, schema).filter(F.col("_v") < F.lit(float("inf")))


def pivot_nearest(a: DataFrame, b: DataFrame, cols, id_col: str, name: str, kernel, argmin: bool, block: int, by=()) -> DataFrame:
    """(id, by, [nn_id,] name) for every row of ``a`` and tag of ``b``. ``a``: (id,
    cols), null distance where a feature is null; ``b``: (_bid, by, cols) without
    nulls. ``kernel(A, ida, B, idb)``: least squared distances [and ids]."""
    if not by:
        return _nearest(a, b, cols, id_col, name, kernel, argmin, block, [])
    # Tags (sizes x attempts, a few) travel as their number: a null is a tag too.
    tags = b.select(*by).distinct().collect()
    fields = ", ".join([f"`_t{i}` {f.dataType.simpleString()}" for i, f in enumerate(b.select(*by).schema.fields)] + ["_tag long"])
    table = F.broadcast(a.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(tags)], fields))
    on = reduce(lambda x, y: x & y, [F.col(t).eqNullSafe(F.col(f"_t{i}")) for i, t in enumerate(by)])
    out = _nearest(a, b.join(table, on).select("_bid", "_tag", *cols), cols, id_col, name, kernel, argmin, block, ["_tag"])
    return out.join(table, "_tag").select(id_col, *[F.col(f"_t{i}").alias(t) for i, t in enumerate(by)], *(["nn_id"] if argmin else []), name)


def _nearest(a: DataFrame, b: DataFrame, cols, id_col: str, name: str, kernel, argmin: bool, block: int, by: list) -> DataFrame:
    spark, cols = a.sparkSession, list(cols)
    types = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    value = [F.col("_b._a").alias("nn_id")] if argmin else []
    null_id = [F.lit(None).cast("long").alias("nn_id")] if argmin else []
    b = cut_lineage(_two_of_equals(b, cols, by))
    n = b.count()
    if not n:
        return a.select(id_col, *[F.lit(None).cast(types[t]).alias(t) for t in by], *null_id, F.lit(None).cast("double").alias(name))
    few = b.orderBy(F.xxhash64("_bid"), "_bid").limit(min(MAX_PIVOTS, max(8, 2 * math.ceil(n / block)))).select(*cols).toPandas()
    pivots = np.unique(few.to_numpy(np.float64), axis=0)
    a = cut_lineage(a)

    def assign(it):
        for p in it:
            X = p[cols].to_numpy(np.float64)
            cell, far = np.zeros(len(X), np.int64), np.zeros(len(X))
            for i in range(0, len(X), _CHUNK):
                D = _distances(X[i:i + _CHUNK], pivots)
                cell[i:i + _CHUNK] = D.argmin(1)
                far[i:i + _CHUNK] = D.min(1)
            yield p.assign(_cell=cell, _far=far + _slack(X, pivots) if len(X) else far)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.schema.fields) + ", _cell long, _far double"
    placed = cut_lineage(b.mapInPandas(assign, ddl))
    cells = placed.groupBy(*by, "_cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("_parts"), F.max("_far").alias("_radius"))
    cells = spark.createDataFrame(cells.collect(), cells.schema)  # at most MAX_PIVOTS rows a tag
    same = reduce(lambda x, y: x & y, [F.col(t).eqNullSafe(F.col(f"_t{i}")) for i, t in enumerate([*by, "_cell"])])
    sized = cells.select(*[F.col(t).alias(f"_t{i}") for i, t in enumerate([*by, "_cell"])], "_parts")
    placed = placed.join(F.broadcast(sized), same).withColumn("_part", F.pmod(F.xxhash64("_bid"), F.col("_parts"))).select("_bid", *by, "_cell", "_part", *cols)
    groups: dict = {}
    for r in cells.collect():
        groups.setdefault(tuple(r[t] for t in by), []).append((r["_cell"], r["_parts"], r["_radius"]))
    tags = [(tag, np.array([c for c, _, _ in g]), np.array([k for _, k, _ in g]), np.array([x for _, _, x in g])) for tag, g in groups.items()]

    def tagged(frame, tag):
        for t, v in zip(by, tag, strict=True):
            frame[t] = v
        return frame

    def homes(it):
        for p in it:
            p = p.dropna(subset=cols)
            for i in range(0, len(p), _CHUNK):
                q = p.iloc[i:i + _CHUNK]
                D = _distances(q[cols].to_numpy(np.float64), pivots)
                for tag, cell, _, _ in tags:
                    yield tagged(q.assign(_cell=cell[D[:, cell].argmin(1)], _part=0), tag)[order]

    order = [id_col, *by, *cols, "_cell", "_part"]
    visit_ddl = ", ".join([f"{id_col} long", *[f"`{t}` {types[t]}" for t in by], *[f"`{c}` double" for c in cols], "_cell long", "_part long"])
    first = cut_lineage(a.mapInPandas(homes, visit_ddl))
    least = F.min(F.struct("_v", "_a")) if argmin else F.min("_v")
    one = cut_lineage(_visit(first, placed, cols, id_col, by, kernel, argmin))
    bound = one.groupBy(id_col, *by).agg(F.sqrt(F.min("_v")).alias("_bound")).select(
        F.col(id_col).alias("_i"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(by)], "_bound")
    on = reduce(lambda x, y: x & y, [F.col(id_col) == F.col("_i"), *[F.col(t).eqNullSafe(F.col(f"_t{i}")) for i, t in enumerate(by)]])
    asked = first.join(bound, on, "left").select(*order, "_bound")

    def others(it):
        for p in it:
            for i in range(0, len(p), _CHUNK):
                q = p.iloc[i:i + _CHUNK]
                X = q[cols].to_numpy(np.float64)
                D = _distances(X, pivots)
                limit = np.nan_to_num(q["_bound"].to_numpy(np.float64), nan=np.inf) * (1 + 1e-9) + _slack(X, pivots)
                own = q["_cell"].to_numpy(np.int64)
                for tag, cell, parts, radius in tags:
                    in_tag = (q[by[0]] == tag[0]).to_numpy() if by else np.ones(len(q), dtype=bool)
                    row, at = np.nonzero((D[:, cell] - radius[None, :] <= limit[:, None]) & in_tag[:, None])
                    k = parts[at]
                    row, at = np.repeat(row, k), np.repeat(at, k)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                    keep = (cell[at] != own[row]) | (part != 0)
                    if keep.any():
                        yield q.iloc[row[keep]].assign(_cell=cell[at[keep]], _part=part[keep])[order]

    second = cut_lineage(asked.mapInPandas(others, visit_ddl))
    every = one.unionByName(_visit(second, placed, cols, id_col, by, kernel, argmin))
    best = every.groupBy(id_col, *by).agg(least.alias("_b"))
    best = best.select(id_col, *by, *value, F.sqrt(F.col("_b._v") if argmin else F.col("_b")).alias(name))
    # Rows of a without a result (null features, no other row): null per tag.
    arr = F.array(*[F.struct(*[F.lit(v).cast(types[t]).alias(t) for t, v in zip(by, tag, strict=True)], F.lit(0).alias("_one")) for tag in groups])
    whole = a.select(id_col, F.explode(arr).alias("_g")).select(id_col, *[F.col(f"_g.{t}").alias(t) for t in by])
    found = best.select(F.col(id_col).alias("_i"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(by)], *(["nn_id"] if argmin else []), name)
    return whole.join(found, on, "left").select(id_col, *by, *(["nn_id"] if argmin else []), name)
