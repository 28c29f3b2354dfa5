"""Merging steps on one pair of tables (G1, G2, G4, G5): single Spark plans of
distance means, ranks and quota joins. ``mirage.operators.tournament`` runs them
in rounds (G3, G6, G7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.functions.draws import draw
from mirage.functions.ordering import take_first, top_k_per_group
from mirage.operators.anchors import ANCHORS, extreme_mean_distance
from mirage.operators.distance import drop_ranked, merge_rows, top_share
from mirage.operators.synth import accumulate
from mirage.operators.frequencies import bin_profile, column_frequencies, feature_columns

FREQ_ERR = 0.2


def privacy_merge_step(cur: DataFrame, donor: DataFrame, size: int, amount: float, cols=None, anchors: int = ANCHORS) -> DataFrame:
    """G1: drop the k rows most alike to the rest of ``cur``, add the k donor
    rows most unlike ``cur``; k = int(size * amount). Only rows that the bounds by
    ``anchors`` leave in question get exact mean distances."""
    cols = list(cols or feature_columns(cur))
    k = max(int(size * amount), 0)
    alike = top_share(extreme_mean_distance(cur, cur, cols, k, anchors=anchors), k, 1.0)
    unlike = top_share(extreme_mean_distance(donor, cur, cols, k, True, anchors), k, 1.0, descending=True)
    kept = drop_ranked(cur, alike)
    selected = donor.join(unlike.select("row_id"), "row_id", "left_semi")
    return merge_rows(kept, selected)


def donor_gate(cur_score: float, donor_scores: DataFrame) -> DataFrame:
    """Keep donors whose composite privacy is not below the current one.
    ``donor_scores``: (donor, score)."""
    return donor_scores.filter(F.col("score") >= F.lit(cur_score))


def _bin_key(prof_row, col: str):
    v = F.col(col).cast("double")
    if prof_row["categorical"]:
        return v
    k = int(prof_row["n_bins"])
    lo, hi = prof_row["lo"], prof_row["hi"]
    idx = F.least(F.floor((v - F.lit(lo)) * F.lit(float(k)) / F.lit(hi - lo)), F.lit(k - 1))
    inside = (v >= F.lit(lo)) & (v <= F.lit(hi))
    return F.when(inside, F.lit(lo) + idx.cast("double") * F.lit((hi - lo) / k))


def fill_bins(cur: DataFrame, donor: DataFrame, real: DataFrame, col: str, seed=0, err: float = FREQ_ERR,
              quota: int | None = None, freqs: DataFrame | None = None) -> DataFrame:
    """For under-represented bins of ``col`` take donor rows in the bin
    (row-id order, at most the gap, at most ``quota`` per bin if given) and remove
    as many current rows (draw order)."""
    prof = bin_profile(real, [col]).first()
    f = freqs if freqs is not None else column_frequencies(real, cur, [col])
    n = cur.count()
    need = (f.filter(F.col("p_syn") < F.col("p_real") - F.lit(err))
            .select(F.col("bin").alias("_bin"),
                    F.ceil((F.col("p_real") - F.lit(err) - F.col("p_syn")) * F.lit(float(n))).alias("_need")))
    d = donor.withColumn("_bin", _bin_key(prof, col))
    dcount = d.groupBy("_bin").agg(F.count(F.lit(1)).alias("_have"))
    q = (need.join(dcount, "_bin").select("_bin", F.least(*_quota(quota), F.col("_have"), F.col("_need")).cast("int").alias("_q"))
         .filter(F.col("_q") > 0))
    picked = top_k_per_group(d.join(F.broadcast(q), "_bin"), ["_bin"], ["row_id"], F.col("_q"), name="_r")  # q: one row per bin
    picked = picked.drop("_bin", "_q", "_r")
    total = picked.count()
    drop = take_first(cur.withColumn("_u", draw(seed, "drop", F.col("row_id"))), ["_u", "row_id"], total)
    kept = cur.join(drop.select("row_id"), "row_id", "left_anti")
    return merge_rows(kept, picked.select(*cur.columns))


def _quota(quota: int | None) -> list:
    return [] if quota is None else [F.lit(quota)]


def thin_bins(cur: DataFrame, fresh, real: DataFrame, col: str, err: float = FREQ_ERR,
              quota: int | None = None, freqs: DataFrame | None = None, patience: int = 10) -> DataFrame:
    """For over-represented bins remove the first rows (row-id order, at most
    the excess, at most ``quota`` per bin if given) and add as many ``fresh`` rows
    lying outside every over-represented bin, in row-id order. ``fresh`` is a table
    or a generator ``fresh(attempt)``, drawn until the gap is filled (at most
    ``patience`` times). Only rows with a substitute go: the size stays."""
    prof = bin_profile(real, [col]).first()
    f = freqs if freqs is not None else column_frequencies(real, cur, [col])
    n = cur.count()
    over = (f.filter(F.col("p_syn") > F.col("p_real") + F.lit(err))
            .select(F.col("bin").alias("_bin"),
                    F.ceil((F.col("p_syn") - F.col("p_real") - F.lit(err)) * F.lit(float(n))).alias("_x")))
    c = cur.withColumn("_bin", _bin_key(prof, col))
    have = c.groupBy("_bin").agg(F.count(F.lit(1)).alias("_have"))
    q = over.join(have, "_bin").select("_bin", F.least(*_quota(quota), F.col("_have"), F.col("_x")).cast("int").alias("_q"))
    removed = top_k_per_group(c.join(F.broadcast(q), "_bin"), ["_bin"], ["row_id"], F.col("_q"), name="_r")
    total = removed.count()

    def outside(table: DataFrame) -> DataFrame:
        keyed = table.withColumn("_bin", _bin_key(prof, col)).join(F.broadcast(q.select(F.col("_bin").alias("_over"))),
                                                                   F.col("_bin").eqNullSafe(F.col("_over")), "left_anti")
        return keyed.drop("_bin").select(*cur.columns)

    add = accumulate(lambda attempt, _: outside(fresh(attempt)), total, patience) if callable(fresh) else take_first(outside(fresh), ["row_id"], total)
    left = min(total, add.count())
    gone = removed if left == total else take_first(removed, ["row_id"], left)
    return merge_rows(cur.join(gone.select("row_id"), "row_id", "left_anti"), add.select(*cur.columns))
