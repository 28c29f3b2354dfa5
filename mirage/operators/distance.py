"""Distance operators (J1-J5), rank and cut (W1-W3) and row merging.

Nearest-neighbour and mean distances are all-pairs by definition, so the work
is O(|A| * |B|) arithmetic; what matters at scale is that no pair is ever a row
and no side passes whole through one task or the driver:

* **broadcast path** - when B (rows x features x 8 bytes) is under
  ``mirage.distance.broadcastBytes`` (default 64 MiB; for mean distances also at most
  ``MEAN_BLOCK_ROWS`` rows), B is broadcast once as a k-d tree and every partition of A
  is scanned by ``mapInPandas``. A is not shuffled at all.
* **pivot path** - nearest neighbours of larger tables visit only the cells of B
  that can hold a closer row (``mirage.operators.pivots``).
* **blocked path** - for mean distances of larger tables B is cut into ranges of its
  widest column of about ``mirage.distance.blockRows`` rows, A into hash blocks; block
  pairs ``(ia, ib)`` are co-grouped and the per-block partial sums are reduced by row.
  Every task holds two bounded blocks, whatever the table sizes.

Inside a block the work goes by k-d trees (``mirage.operators.trees``): a row meets
the leaves near it, not the block. Nearest distances are exact; mean distances of
blocks over ``DIRECT_ROWS`` rows stand for a direct sum to about its own rounding.
Tables of more than ``MAX_TREE_COLUMNS`` columns are measured directly, where minimum
distances use the ``|a|^2 + |b|^2 - 2ab`` product for speed and then
recompute the exact distance for every candidate within rounding tolerance of
the minimum, so the result equals a direct computation.

Null (or NaN) features: a row of B with one is no neighbour (it is left out before
either path), a row of A with one has a null distance.
"""

from __future__ import annotations

import math
import pickle
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.ordering import ordered_index, rank_column, take_first
from mirage.operators.pivots import pivot_nearest
from mirage.operators.trees import MeanTree, NearTree
from mirage.session import cut_lineage

DEFAULT_BROADCAST_BYTES = 64 << 20
DEFAULT_BLOCK_ROWS = 8192
MEAN_BLOCK_ROWS = 1 << 19  # rows of B under one tree of mean distances
MAX_TREE_COLUMNS = 8  # in more columns boxes rule out too little
DIRECT_ROWS = 8192
_B_CHUNK = 65536


def _conf_int(spark, key, default):
    try:
        return int(spark.conf.get(key, str(default)))
    except Exception:  # noqa: BLE001
        return default


# --- numpy kernels (run inside tasks) ----------------------------------------

def _min_sq(A, ida, B, idb, exclude_self):
    """Exact min squared distance from every row of A to rows of B."""
    out = np.full(len(A), np.inf)
    if len(A) == 0 or len(B) == 0:
        return out
    aa = np.einsum("ij,ij->i", A, A)
    ca = max(1, min(4096, (1 << 20) // max(1, min(len(B), _B_CHUNK))))
    for j0 in range(0, len(B), _B_CHUNK):
        Bj, idj = B[j0:j0 + _B_CHUNK], idb[j0:j0 + _B_CHUNK]
        bb = np.einsum("ij,ij->i", Bj, Bj)
        bmax = bb.max()
        for i0 in range(0, len(A), ca):
            Ai = A[i0:i0 + ca]
            # In place: g = |b|^2 - 2ab (= d2 - |a|^2, same order per row).
            g = Ai @ Bj.T
            g *= -2.0
            g += bb[None, :]
            if exclude_self:
                g[ida[i0:i0 + ca, None] == idj[None, :]] = np.inf
            m = g.min(axis=1)
            tol = 1e-12 * (aa[i0:i0 + ca] + bmax) + 1e-300
            r, c = np.nonzero(g <= (m + tol)[:, None])
            if len(r):
                exact = ((Ai[r] - Bj[c]) ** 2).sum(axis=1)
                blk = out[i0:i0 + ca]
                np.minimum.at(blk, r, exact)
                out[i0:i0 + ca] = blk
    return out


def _argmin_sq(A, ida, B, idb, exclude_self):
    """(min squared distance, id of that B row; ties -> lowest id) per A row."""
    best = np.full(len(A), np.inf)
    arg = np.full(len(A), -1, dtype=np.int64)
    if len(A) == 0 or len(B) == 0:
        return best, arg
    aa = np.einsum("ij,ij->i", A, A)
    ca = max(1, min(4096, (1 << 20) // max(1, min(len(B), _B_CHUNK))))
    for j0 in range(0, len(B), _B_CHUNK):
        Bj, idj = B[j0:j0 + _B_CHUNK], idb[j0:j0 + _B_CHUNK]
        bb = np.einsum("ij,ij->i", Bj, Bj)
        bmax = bb.max()
        for i0 in range(0, len(A), ca):
            Ai = A[i0:i0 + ca]
            d2 = aa[i0:i0 + ca, None] + bb[None, :] - 2.0 * (Ai @ Bj.T)
            if exclude_self:
                d2[ida[i0:i0 + ca, None] == idj[None, :]] = np.inf
            m = d2.min(axis=1)
            tol = 1e-12 * (aa[i0:i0 + ca] + bmax) + 1e-300
            r, c = np.nonzero(d2 <= (m + tol)[:, None])
            if not len(r):
                continue
            exact = ((Ai[r] - Bj[c]) ** 2).sum(axis=1)
            ids = idj[c]
            order = np.lexsort((ids, exact, r))
            r, exact, ids = r[order], exact[order], ids[order]
            first = np.ones(len(r), dtype=bool)
            first[1:] = r[1:] != r[:-1]
            r, exact, ids = r[first], exact[first], ids[first]
            g = i0 + r
            better = (exact < best[g]) | ((exact == best[g]) & (ids < arg[g]))
            best[g[better]] = exact[better]
            arg[g[better]] = ids[better]
    return best, arg


def _sum_dist(A, B):
    """Sum of exact Euclidean distances from every row of A to all rows of B."""
    out = np.zeros(len(A))
    if len(A) == 0 or len(B) == 0:
        return out
    ca = max(1, min(2048, (1 << 21) // max(1, min(len(B), _B_CHUNK))))
    for j0 in range(0, len(B), _B_CHUNK):
        Bj = B[j0:j0 + _B_CHUNK]
        for i0 in range(0, len(A), ca):
            diff = A[i0:i0 + ca, None, :] - Bj[None, :, :]
            out[i0:i0 + ca] += np.sqrt(np.einsum("ijk,ijk->ij", diff, diff)).sum(axis=1)
    return out


class _Near:
    """Least squared distances (and ids) to the rows of one block of B."""

    def __init__(self, B, idb):
        self.rows = None if B.shape[1] <= MAX_TREE_COLUMNS else (B, idb)
        self.tree = NearTree(B, idb) if self.rows is None else None

    def min_sq(self, A, ida, exclude_self):
        return self.tree.query(A, ida, exclude_self, False)[0] if self.tree else _min_sq(A, ida, *self.rows, exclude_self)

    def argmin_sq(self, A, ida, exclude_self):
        if not self.tree:
            return _argmin_sq(A, ida, *self.rows, exclude_self)
        best, arg = self.tree.query(A, ida, exclude_self, True)
        return best, np.where(np.isfinite(best), arg, -1)

    def distances(self, A, ida, exclude_self):
        v = np.sqrt(self.min_sq(A, ida, exclude_self))
        v[~np.isfinite(v)] = np.nan
        return v


class _Sums:
    """Sums of distances to the rows of one block of B."""

    def __init__(self, B):
        self.rows = B
        self.tree = MeanTree(B) if len(B) > DIRECT_ROWS and B.shape[1] <= MAX_TREE_COLUMNS else None
        self.n = len(B)
        if self.tree:
            self.rows = None

    def sums(self, A):
        return self.tree.sums(A) if self.tree else _sum_dist(A, self.rows)

    def means(self, A):
        return self.sums(A) / self.n if self.n else np.full(len(A), np.nan)


# --- plans ------------------------------------------------------------------

def _spread(df: DataFrame) -> DataFrame:
    """Each row of A costs |B| distance evaluations, so A must use every core: it
    is dealt round-robin over twice the cluster's parallelism (id and features
    only - little next to |B| evaluations a row). Counting the partitions of its
    plan first would run every shuffle above it."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2)


def _pair_stat(a: DataFrame, b: DataFrame, cols, id_col: str, kind: str, exclude_self: bool,
               name: str, by=()) -> DataFrame:
    """Per row of ``a``: ``kind`` = 'min' (nearest distance) or 'mean' (mean distance).

    ``by``: tag columns of ``b`` (e.g. size, attempt); the statistic is then
    computed per row of ``a`` and per tag group of ``b`` in the same scan.
    """
    if by:
        return _pair_stat_by(a, b, cols, id_col, kind, exclude_self, name, list(by))
    spark = a.sparkSession
    cols = list(cols)
    limit = _conf_int(spark, "mirage.distance.broadcastBytes", DEFAULT_BROADCAST_BYTES)
    block = _conf_int(spark, "mirage.distance.blockRows", DEFAULT_BLOCK_ROWS)
    bsel = b.select(F.col(id_col).cast("long").alias("_bid"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    asel = a.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c).cast("double").alias(c) for c in cols])
    schema = f"{id_col} long, {name} double" if kind != "argmin" else f"{id_col} long, nn_id long, {name} double"
    max_rows = max(1, limit // ((len(cols) + 1) * 8))
    if kind == "mean":
        max_rows = min(max_rows, MEAN_BLOCK_ROWS)
    pdf = bsel.limit(max_rows + 1).toPandas()  # at most max_rows + 1 rows reach the driver
    nb = len(pdf)
    if nb <= max_rows:
        B = pdf[cols].to_numpy(np.float64)
        bc = spark.sparkContext.broadcast(cloudpickle.dumps(_Sums(B) if kind == "mean" else _Near(B, pdf["_bid"].to_numpy(np.int64))))

        def scan(it):
            rows = pickle.loads(bc.value)
            for p in it:
                A, ida = p[cols].to_numpy(np.float64), p[id_col].to_numpy(np.int64)
                if kind == "argmin":
                    d2, arg = rows.argmin_sq(A, ida, exclude_self)
                    v = np.sqrt(d2)
                    v[~np.isfinite(v)] = np.nan
                    yield pd.DataFrame({id_col: ida, "nn_id": np.where(arg < 0, None, arg), name: v}
                                       ).astype({"nn_id": "Int64"})
                    continue
                yield pd.DataFrame({id_col: ida, name: rows.distances(A, ida, exclude_self) if kind == "min" else rows.means(A)})
        return _spread(asel).mapInPandas(scan, schema)

    del pdf
    if kind != "mean":
        return pivot_nearest(asel, bsel, cols, id_col, name, _kernel(kind, exclude_self), kind == "argmin", block)
    block = _conf_int(spark, "mirage.distance.blockRows", MEAN_BLOCK_ROWS)
    asel = cut_lineage(asel.withColumn("_row", F.monotonically_increasing_id()))  # ids may repeat
    na = asel.count()
    bblk, blocks, nb = _ranges(bsel, cols, block)
    ka = max(1, math.ceil(na / block))
    ablk = (asel.withColumn("_ia", F.pmod(F.xxhash64("_row"), F.lit(ka)))
            .withColumn("_ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    bblk = bblk.withColumn("_ia", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ka - 1).cast("long"))))

    def pair(left, right):
        v = _Sums(right[cols].to_numpy(np.float64)).sums(left[cols].to_numpy(np.float64))
        return pd.DataFrame({"_row": left["_row"], id_col: left[id_col], "_v": v})

    part = (ablk.groupBy("_ia", "_ib").cogroup(bblk.groupBy("_ia", "_ib"))
            .applyInPandas(pair, f"_row long, {id_col} long, _v double"))
    # One number a block, added in one order: equal rows get equal means.
    total = F.aggregate(F.array_sort(F.collect_list("_v")), F.lit(0.0), lambda x, y: x + y)
    return part.groupBy("_row", id_col).agg((total / F.lit(float(nb))).alias(name)).drop("_row")


def _ranges(b: DataFrame, cols, block: int) -> tuple[DataFrame, int, int]:
    """(``b`` with its block ``_ib``, number of blocks, rows): ranges of the widest
    column, those with too many equal values split by hash."""
    st = b.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    n = st["n"]
    widest = max(range(len(cols)), key=lambda i: st[f"hi{i}"] - st[f"lo{i}"])
    k = max(1, math.ceil(n / block))
    ends = sorted(set(b.approxQuantile(cols[widest], [i / k for i in range(1, k)], 0.1 / k))) if k > 1 else []
    part = reduce(lambda x, y: x + y, [(F.col(cols[widest]) > F.lit(e)).cast("int") for e in ends], F.lit(0))
    b = b.withColumn("_ib", part)
    parts = [1] * (len(ends) + 1)
    for r in b.groupBy("_ib").count().collect():  # one row a range
        parts[r["_ib"]] = max(1, round(r["count"] / block))
    first = [sum(parts[:i]) for i in range(len(parts))]
    at = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("_ib") + 1)
    return b.withColumn("_ib", at(first) + F.pmod(F.xxhash64("_bid", *cols), at(parts))), sum(parts), n


def _kernel(kind: str, exclude_self: bool):
    if kind == "argmin":
        return lambda A, ida, B, idb: _Near(B, idb).argmin_sq(A, ida, exclude_self)
    return lambda A, ida, B, idb: _Near(B, idb).min_sq(A, ida, exclude_self)


def _pair_stat_by(a, b, cols, id_col, kind, exclude_self, name, by, fold: bool = False):
    """``fold``: (by, n, total, lo, hi) of the distances instead, one row a task and
    tag where ``b`` is broadcast - not a row for every row of ``a`` and tag."""
    spark = a.sparkSession
    cols = list(cols)
    limit = _conf_int(spark, "mirage.distance.broadcastBytes", DEFAULT_BROADCAST_BYTES)
    block = _conf_int(spark, "mirage.distance.blockRows", DEFAULT_BLOCK_ROWS)
    bsel = b.select(F.col(id_col).cast("long").alias("_bid"), *by, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    asel = a.select(F.col(id_col).cast("long").alias(id_col), *[F.col(c).cast("double").alias(c) for c in cols])
    tag_types = {f.name: f.dataType.simpleString() for f in bsel.schema.fields if f.name in by}
    schema = f"{id_col} long, " + ", ".join(f"`{t}` {tag_types[t]}" for t in by) + f", {name} double"
    nb = bsel.count()
    if nb * (len(cols) + 1 + len(by)) * 8 <= limit:
        pdf = bsel.toPandas()  # bounded by the size check above
        groups = [(key if isinstance(key, tuple) else (key,), _Near(g[cols].to_numpy(np.float64), g["_bid"].to_numpy(np.int64))
                   if kind == "min" else _Sums(g[cols].to_numpy(np.float64))) for key, g in pdf.groupby(by, sort=True, dropna=False)]
        bc = spark.sparkContext.broadcast(cloudpickle.dumps(groups))

        def scan(it):
            gs = pickle.loads(bc.value)
            for p in it:
                A, ida = p[cols].to_numpy(np.float64), p[id_col].to_numpy(np.int64)
                for key, rows in gs:
                    v = rows.distances(A, ida, exclude_self) if kind == "min" else rows.means(A)
                    out = {id_col: ida}
                    for t, val in zip(by, key):
                        out[t] = np.repeat(np.array([val], dtype=object), len(A))
                    out[name] = v
                    yield pd.DataFrame(out)

        def folded(it):
            gs = pickle.loads(bc.value)
            sums = [[0, 0.0, np.inf, -np.inf] for _ in gs]
            rows = 0
            for p in it:
                A, ida = p[cols].to_numpy(np.float64), p[id_col].to_numpy(np.int64)
                rows += len(A)
                for t, (_, near) in zip(sums, gs, strict=True):
                    v = near.distances(A, ida, exclude_self)
                    v = v[~np.isnan(v)]
                    if len(v):
                        t[:] = [t[0] + len(v), t[1] + v.sum(), min(t[2], v.min()), max(t[3], v.max())]
            if rows and gs:
                out = {t: np.array([key[i] for key, _ in gs], dtype=object) for i, t in enumerate(by)}
                n, total, lo, hi = zip(*sums, strict=True)
                none = np.array(n) == 0
                yield pd.DataFrame({**out, "n": n, "total": total, "lo": np.where(none, np.nan, lo), "hi": np.where(none, np.nan, hi)})
        if fold:
            return _spread(asel).mapInPandas(folded, ", ".join(f"`{t}` {tag_types[t]}" for t in by) + ", n long, total double, lo double, hi double")
        return _spread(asel).mapInPandas(scan, schema)
    if kind == "min":
        out = pivot_nearest(asel, bsel, cols, id_col, name, _kernel(kind, exclude_self), False, block, by)
        return out.groupBy(*by).agg(F.count(name).alias("n"), F.sum(name).alias("total"), F.min(name).alias("lo"), F.max(name).alias("hi")) if fold else out
    # Blocked: tag groups become part of the block key.
    na = asel.count()
    tags = [tuple(r) for r in bsel.select(*by).distinct().collect()]  # tag values are few (sizes x attempts)
    ka = max(1, math.ceil(na / block))
    kb = max(1, math.ceil(nb / (block * max(1, len(tags)))))
    tag_arr = F.array(*[F.struct(*[F.lit(v).cast(tag_types[t]).alias(t) for t, v in zip(by, tg)]) for tg in tags])
    ablk = (asel.withColumn("_ia", F.pmod(F.xxhash64(id_col), F.lit(ka)))
            .withColumn("_ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(kb - 1).cast("long"))))
            .withColumn("_tag", F.explode(tag_arr)).select("*", *[F.col(f"_tag.{t}").alias(t) for t in by]).drop("_tag"))
    bblk = (bsel.withColumn("_ib", F.pmod(F.xxhash64("_bid"), F.lit(kb)))
            .withColumn("_ia", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ka - 1).cast("long")))))

    def pair(left, right):
        A, ida = left[cols].to_numpy(np.float64), left[id_col].to_numpy(np.int64)
        B = right[cols].to_numpy(np.float64)
        v = _sum_dist(A, B)
        out = left[[id_col, *by]].copy()
        out["_v"] = v
        out["_n"] = len(B)
        return out

    keys = ["_ia", "_ib", *by]
    part = (ablk.groupBy(*keys).cogroup(bblk.groupBy(*keys))
            .applyInPandas(pair, f"{id_col} long, " + ", ".join(f"`{t}` {tag_types[t]}" for t in by) + ", _v double, _n long"))
    return part.groupBy(id_col, *by).agg((F.sum("_v") / F.sum("_n")).alias(name))


def nearest_distance(a: DataFrame, b: DataFrame, cols, id_col: str = "row_id",
                     name: str = "dist", by=()) -> DataFrame:
    """(row id of a[, tags of b], Euclidean distance to the closest row of b)."""
    return _pair_stat(a, b, cols, id_col, "min", False, name, by)


def nearest_summary(a: DataFrame, b: DataFrame, cols, by, id_col: str = "row_id") -> DataFrame:
    """(tags of b, n, mean, lo, hi) of the rows' distances (J3), without a row per row
    of ``a`` and tag."""
    part = _pair_stat_by(a, b, cols, id_col, "min", False, "dist", list(by), fold=True)
    s = part.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").alias("_t"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return s.select(*by, "n", F.when(F.col("n") > 0, F.col("_t") / F.col("n")).alias("mean"), "lo", "hi")


def nearest_neighbor(a: DataFrame, b: DataFrame, cols, id_col: str = "row_id", name: str = "dist",
                     exclude_self: bool = False) -> DataFrame:
    """J3 with the neighbour: (row id, nn_id, dist); ties go to the lowest id."""
    return _pair_stat(a, b, cols, id_col, "argmin", exclude_self, name)


def nearest_other(a: DataFrame, cols, id_col: str = "row_id", name: str = "dist", among: DataFrame | None = None) -> DataFrame:
    """Distance to the closest *other* row (different row id) of the same table;
    ``among``: the table, where only some of its rows (``a``) are asked for."""
    return _pair_stat(a, a if among is None else among, cols, id_col, "min", True, name)


def mean_distance_self(df: DataFrame, cols, id_col: str = "row_id", name: str = "mean_dist") -> DataFrame:
    """Mean distance of every row to all rows of the same table (itself included)."""
    return _pair_stat(df, df, cols, id_col, "mean", False, name)


def mean_distance_cross(new: DataFrame, cur: DataFrame, cols, id_col: str = "row_id",
                        name: str = "mean_dist") -> DataFrame:
    """Mean distance of every row of ``new`` to all rows of ``cur``."""
    return _pair_stat(new, cur, cols, id_col, "mean", False, name)


def drop_ranked(df: DataFrame, ranked: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Remove the ranked rows (anti join on the row id)."""
    return df.join(ranked.select(id_col), id_col, "left_anti")


def rank_similar(dist: DataFrame, col: str = "mean_dist", id_col: str = "row_id") -> DataFrame:
    """1-based rank by ascending distance (most alike first), ties by row id."""
    return rank_column(dist, [F.col(col).asc(), F.col(id_col).asc()], name="rank")


def rank_dissimilar(dist: DataFrame, col: str = "mean_dist", id_col: str = "row_id") -> DataFrame:
    """1-based rank by descending distance (most unlike first), ties by row id."""
    return rank_column(dist, [F.col(col).desc(), F.col(id_col).asc()], name="rank")


def top_share(dist: DataFrame, size: int, amount: float, col: str = "mean_dist", descending: bool = False,
              id_col: str = "row_id") -> DataFrame:
    """The first int(size * amount) rows in distance order."""
    k = max(int(size * amount), 0)
    order = [F.col(col).desc() if descending else F.col(col).asc(), F.col(id_col).asc()]
    return take_first(dist, order, k)


def merge_rows(kept: DataFrame, selected: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Kept rows then selected rows, renumbered 0..n-1 in that order."""
    both = (kept.withColumn("_src", F.lit(0)).unionByName(selected.withColumn("_src", F.lit(1)))
            .withColumnRenamed(id_col, "_old"))
    out = ordered_index(both, ["_src", "_old"], name=id_col)
    return out.drop("_src", "_old").select(*kept.columns)


def expand_vector(df: DataFrame, col: str, dim: int | None = None, prefix: str = "x"):
    """Array feature -> one double column per element (distances take columns).
    Returns (DataFrame, column names); ``dim`` defaults to the first row's length."""
    if dim is None:
        dim = df.select(F.size(col)).first()[0]
    cols = [f"{prefix}{i}" for i in range(dim)]
    out = df.select(*[c for c in df.columns if c != col],
                    *[F.col(col)[i].cast("double").alias(n) for i, n in enumerate(cols)])
    return out, cols
