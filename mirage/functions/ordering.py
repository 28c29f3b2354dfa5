"""Ranks and cut-offs that never pull a whole table (or a hot group) into one task.

Spark's ``Window.orderBy(...)`` without ``partitionBy`` moves every row to one
task, and ``partitionBy(key)`` does the same for a key holding a third of the
rows. The helpers here are the distributed forms used throughout:

* ``ordered_index`` - consecutive 0-based positions in a global (or per small
  group) order: range partitioning + per-partition positions + a tiny offsets
  table (one row per partition and group) that is broadcast back.
* ``top_k_per_group`` - the first k rows of every group, k small: a salted
  first stage keeps at most k rows per (group, salt), the second stage ranks the
  at most salt * k survivors of each group.
* ``take_first`` - the first n rows in an order: TakeOrdered for small n, the
  positional cut above for large n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirage.session import shuffle_partitions

# Largest n for which a TakeOrdered (n rows held by the final task) is used.
TOPK_MAX = 100_000
_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def _cols(cs) -> list:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _add_offsets(part: DataFrame, offsets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Join the offsets of (_pid, groups) back; null group keys match null.

    Without groups the offsets table has one row per partition: broadcast it.
    With groups its size depends on the group count, so AQE decides at run time."""
    if not groups:
        return part.join(F.broadcast(offsets), "_pid")
    right = offsets.withColumnsRenamed({"_pid": "_o_pid", **{g: f"_o_{i}" for i, g in enumerate(groups)}})
    on = F.col("_pid") == F.col("_o_pid")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{i}"))
    return part.join(right, on).drop("_o_pid", *[f"_o_{i}" for i in range(len(groups))])


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """``df`` dealt by ``keys`` into parts of about ``rows`` rows: what is joined to or
    grouped by the keys afterwards stays in as many tasks, however few files it came
    from and however many rows each row grows into."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), -(-df.count() // rows)), *keys)


def over_cores(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` written once in parts of about ``rows`` rows, for repeated passes over a
    table that comes in one file; tables of up to ``rows`` rows stay as they are."""
    from mirage.session import cut_lineage
    parts = -(-df.count() // rows)
    return df if parts <= 1 else cut_lineage(df.repartition(parts))


def ordered_index(df: DataFrame, order_cols: Sequence, group_cols: Sequence[str] = (),
                  name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row inside its group in ``order_cols``.

    ``order_cols`` should make rows unique (append a row id); the group count
    must be small (the offsets table has at most partitions + groups rows).
    """
    from mirage.session import cut_lineage
    n = num_partitions or shuffle_partitions(df.sparkSession)
    keys = [*_cols(group_cols), *_cols(order_cols)]
    # Positions are assigned once and written out: recomputing a range shuffle
    # in two branches (counts and rows) may split it differently at run time
    # (adaptive coalescing), so both branches must read the same stored copy.
    part = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                       .withColumn("_mid", F.monotonically_increasing_id())
                       .withColumn("_pid", F.shiftright("_mid", _POS_BITS))
                       .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    counts = part.groupBy("_pid", *group_cols).agg(F.min("_pos").alias("_first"),
                                                   F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    offsets = offsets.select("_pid", *group_cols, "_first", "_off")
    out = _add_offsets(part, offsets, list(group_cols))
    return (out.withColumn(name, F.col("_off") + F.col("_pos") - F.col("_first"))
            .drop("_mid", "_pid", "_pos", "_first", "_off"))


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, k,
                    name: str = "rank", salt_buckets: int | None = None) -> DataFrame:
    """Rows ranked 1..k (``name``) inside each group; ``k`` is an int or a column.

    When ``k`` is a column its values must be small (they bound the second
    stage); callers pass bounded quotas (e.g. at most 10 rows per bin).
    """
    s = salt_buckets or max(shuffle_partitions(df.sparkSession), 1)
    kc = F.lit(k) if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(s)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*_cols(order_cols))
    first = salted.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= kc)
    w2 = Window.partitionBy(*group_cols).orderBy(*_cols(order_cols))
    return (first.withColumn(name, F.row_number().over(w2)).filter(F.col(name) <= kc)
            .drop("_salt", "_rn"))


def take_first(df: DataFrame, order_cols: Sequence, n: int) -> DataFrame:
    """First ``n`` rows in ``order_cols`` order (exact, ties by the given columns)."""
    if n <= TOPK_MAX:
        return df.orderBy(*_cols(order_cols)).limit(n)
    return ordered_index(df, order_cols, name="_idx").filter(F.col("_idx") < n).drop("_idx")


def rank_column(df: DataFrame, order_cols: Sequence, name: str = "rank") -> DataFrame:
    """1-based global rank without a single-task window."""
    return ordered_index(df, order_cols, name=name).withColumn(name, F.col(name) + 1)


def prefix_sum(df: DataFrame, order_cols: Sequence, value_col: str, group_cols: Sequence[str] = (),
               name: str = "cum", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = sum of ``value_col`` over the rows before this one (in
    ``order_cols`` order, inside its group) and ``name``_hi = that plus the
    row's own value. Range partitioned and written once like ``ordered_index``;
    each partition sums its own rows, a small table of partition totals gives
    the offsets. No group or table is summed in one task."""
    from mirage.session import cut_lineage
    n = num_partitions or shuffle_partitions(df.sparkSession)
    keys = [*_cols(group_cols), *_cols(order_cols)]
    part = cut_lineage(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                       .withColumn("_mid", F.monotonically_increasing_id())
                       .withColumn("_pid", F.shiftright("_mid", _POS_BITS)))
    local = Window.partitionBy("_pid", *group_cols).orderBy("_mid")
    part = (part.withColumn("_lo", F.coalesce(F.sum(value_col).over(local.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0.0)))
            .withColumn("_hi", F.sum(value_col).over(local.rowsBetween(Window.unboundedPreceding, 0))))
    tot = part.groupBy("_pid", *group_cols).agg(F.max("_hi").alias("_t"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.withColumn("_off", F.coalesce(F.sum("_t").over(w), F.lit(0.0))).select("_pid", *group_cols, "_off")
    out = _add_offsets(part, offsets, list(group_cols))
    return (out.withColumn(name, F.col("_off") + F.col("_lo")).withColumn(f"{name}_hi", F.col("_off") + F.col("_hi"))
            .drop("_mid", "_pid", "_lo", "_hi", "_off"))
