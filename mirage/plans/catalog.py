"""The query catalog: every operator run over the given test tables.

Each entry reads whole tables (or tables Spark derives from them) and returns
a DataFrame. Fixture conventions shared with the SQL oracles
(``mirage.plans.oracle_sql``):

* encoded customers: row_id = c_custkey, c_nationkey, c_acctbal, c_mktsegment
  (code 0..k-1 in value order);
* roles: real = draw(7, 'role', row_id) < 0.5, synthetic = the rest, so every
  metric can be value-checked without a generator;
* doubles are rounded to 6 digits in results.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.functions.draws import draw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ROLE_SEED = 7
SEED = 42


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            # "column" is reserved in DuckDB: quote the identifier everywhere.
            ORACLE[name] = re.sub(r"(?<![\w'\"])column(?![\w'\"])", '"column"', sql)
        return fn
    return deco


# --- SQL fragments for the oracles (DuckDB) -------------------------------------

def dsql(seed, tag, id_) -> str:
    from mirage.functions.draws import draw_sql
    return draw_sql(str(seed), f"'{tag}'" if not tag.startswith("(") else tag, id_)


CUST_ENC = """cust_enc AS (
  SELECT c.c_custkey AS row_id, c.c_nationkey, c.c_acctbal, d.code AS c_mktsegment
  FROM customer c JOIN (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code
                        FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)) d ON c.c_mktsegment = d.v)"""


def roles_sql(src: str = "cust_enc") -> str:
    u = dsql(ROLE_SEED, "role", "row_id")
    return (f"real AS (SELECT * FROM {src} WHERE {u} < 0.5),\n"
            f"syn AS (SELECT * FROM {src} WHERE {u} >= 0.5)")


def dist_sql(a: str, b: str, cols) -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols) + ")"


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(d, f"{name}.parquet"))


def r6(c):
    """Round to 6 digits the way the oracle engine does (half away from zero on
    x * 1e6), so results compare bit for bit."""
    x = F.col(c) if isinstance(c, str) else c
    return F.signum(x) * F.floor(F.abs(x) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column to 6 digits."""
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.simpleString() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    from mirage.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex[:12]}")


def cust_raw(spark, d) -> DataFrame:
    return T(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_nationkey", "c_acctbal", "c_mktsegment")


def cust_enc(spark, d) -> DataFrame:
    from mirage.operators.prep import encode
    enc, _ = encode(cust_raw(spark, d))
    return enc


def roles(df: DataFrame, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    u = draw(ROLE_SEED, "role", F.col(key))
    return df.filter(u < 0.5), df.filter(u >= 0.5)


def cust_roles(spark, d):
    return roles(cust_enc(spark, d))


FEATS = ["c_nationkey", "c_acctbal", "c_mktsegment"]


def _load_all():
    # Importing the group modules fills QUERIES and ORACLE.
    import importlib
    for m in ("catalog_prep", "catalog_freq", "catalog_metrics", "catalog_levels", "catalog_synth"):
        try:
            importlib.import_module(f"mirage.plans.{m}")
        except ModuleNotFoundError as e:
            if m not in str(e):
                raise


def long_sql(src: str, cols, by=()) -> str:
    b = "".join(f"{x}, " for x in by)
    return " UNION ALL ".join(f"SELECT {b}'{c}' AS column, CAST({c} AS DOUBLE) AS v FROM {src}" for c in cols)


def freqs_sql(real: str, syn: str, cols, n_bins: int = 10, force_hist: bool = False, prefix: str = "f",
              by=()) -> str:
    """CTEs ending in ``{prefix}_al``: ([tags,] column, bin, p_real, p_syn) as in A4."""
    if by:
        return _freqs_by_sql(real, syn, cols, n_bins, prefix, list(by))
    k = f"least({n_bins}, nd)" if not force_hist else str(n_bins)
    cat = "nd < 5" if not force_hist else "false"
    binx = (f"CASE WHEN p.cat THEN l.v ELSE p.lo + CAST(least(floor((l.v - p.lo) * CAST(p.k AS DOUBLE) / (p.hi - p.lo)), p.k - 1) AS DOUBLE)"
            f" * ((p.hi - p.lo) / CAST(p.k AS DOUBLE)) END")
    inr = "(p.cat OR (l.v >= p.lo AND l.v <= p.hi))"

    def side(src, name):
        return f"""{prefix}_{name}_l AS ({long_sql(src, cols)}),
{prefix}_{name}_b AS (SELECT l.column, l.v, {binx} AS bin, p.cat, {inr} AS inr FROM {prefix}_{name}_l l JOIN {prefix}_prof p ON l.column = p.column),
{prefix}_{name}_c AS (SELECT column, bin, count(*) AS n, any_value(cat) AS cat FROM {prefix}_{name}_b WHERE inr AND v IS NOT NULL GROUP BY column, bin),
{prefix}_{name}_t AS (SELECT column, count(*) AS nrows, sum(CASE WHEN inr AND v IS NOT NULL THEN 1 ELSE 0 END) AS hits FROM {prefix}_{name}_b GROUP BY column),
{prefix}_{name}_f AS (SELECT c.column, c.bin, CASE WHEN c.cat THEN c.n / t.nrows ELSE c.n / (t.hits + 1e-8) END AS p
                      FROM {prefix}_{name}_c c JOIN {prefix}_{name}_t t ON c.column = t.column)"""
    return f"""{prefix}_rl0 AS ({long_sql(real, cols)}),
{prefix}_prof AS (SELECT column, nd, {k} AS k, {cat} AS cat, lo, hi FROM
   (SELECT column, count(DISTINCT v) AS nd, min(v) AS lo, max(v) AS hi FROM {prefix}_rl0 GROUP BY column)),
{side(real, 'r')},
{side(syn, 's')},
{prefix}_al AS (SELECT coalesce(r.column, s.column) AS column, coalesce(r.bin, s.bin) AS bin,
                   coalesce(nullif(r.p, 0.0), 1e-11) AS p_real, coalesce(nullif(s.p, 0.0), 1e-11) AS p_syn
                FROM {prefix}_r_f r FULL OUTER JOIN {prefix}_s_f s ON r.column = s.column AND r.bin = s.bin)"""


def _freqs_by_sql(real, syn, cols, n_bins, prefix, by) -> str:
    k = f"least({n_bins}, nd)"
    binx = (f"CASE WHEN p.cat THEN l.v ELSE p.lo + CAST(least(floor((l.v - p.lo) * CAST(p.k AS DOUBLE) / (p.hi - p.lo)), p.k - 1) AS DOUBLE)"
            f" * ((p.hi - p.lo) / CAST(p.k AS DOUBLE)) END")
    inr = "(p.cat OR (l.v >= p.lo AND l.v <= p.hi))"
    b = ", ".join(by)
    lb = ", ".join(f"l.{x}" for x in by)
    on = " AND ".join(f"r.{x} = s.{x}" for x in by)
    return f"""{prefix}_rl0 AS ({long_sql(real, cols)}),
{prefix}_prof AS (SELECT column, nd, {k} AS k, nd < 5 AS cat, lo, hi FROM
   (SELECT column, count(DISTINCT v) AS nd, min(v) AS lo, max(v) AS hi FROM {prefix}_rl0 GROUP BY column)),
{prefix}_rb AS (SELECT l.column, l.v, {binx} AS bin, p.cat, {inr} AS inr FROM {prefix}_rl0 l JOIN {prefix}_prof p ON l.column = p.column),
{prefix}_rc AS (SELECT column, bin, count(*) AS n, any_value(cat) AS cat FROM {prefix}_rb WHERE inr AND v IS NOT NULL GROUP BY column, bin),
{prefix}_rt AS (SELECT column, count(*) AS nrows, sum(CASE WHEN inr AND v IS NOT NULL THEN 1 ELSE 0 END) AS hits FROM {prefix}_rb GROUP BY column),
{prefix}_rf0 AS (SELECT c.column, c.bin, CASE WHEN c.cat THEN c.n / t.nrows ELSE c.n / (t.hits + 1e-8) END AS p
                 FROM {prefix}_rc c JOIN {prefix}_rt t ON c.column = t.column),
{prefix}_tags AS (SELECT DISTINCT {b} FROM {syn}),
{prefix}_rf AS (SELECT {prefix}_tags.*, {prefix}_rf0.* FROM {prefix}_tags, {prefix}_rf0),
{prefix}_sl AS ({long_sql(syn, cols, by)}),
{prefix}_sb AS (SELECT {lb}, l.column, l.v, {binx} AS bin, p.cat, {inr} AS inr FROM {prefix}_sl l JOIN {prefix}_prof p ON l.column = p.column),
{prefix}_sc AS (SELECT {b}, column, bin, count(*) AS n, any_value(cat) AS cat FROM {prefix}_sb WHERE inr AND v IS NOT NULL GROUP BY {b}, column, bin),
{prefix}_st AS (SELECT {b}, column, count(*) AS nrows, sum(CASE WHEN inr AND v IS NOT NULL THEN 1 ELSE 0 END) AS hits FROM {prefix}_sb GROUP BY {b}, column),
{prefix}_sf AS (SELECT {", ".join(f"c.{x}" for x in by)}, c.column, c.bin, CASE WHEN c.cat THEN c.n / t.nrows ELSE c.n / (t.hits + 1e-8) END AS p
                FROM {prefix}_sc c JOIN {prefix}_st t ON c.column = t.column AND {" AND ".join(f"c.{x} = t.{x}" for x in by)}),
{prefix}_al AS (SELECT {", ".join(f"coalesce(r.{x}, s.{x}) AS {x}" for x in by)}, coalesce(r.column, s.column) AS column,
                   coalesce(r.bin, s.bin) AS bin,
                   coalesce(nullif(r.p, 0.0), 1e-11) AS p_real, coalesce(nullif(s.p, 0.0), 1e-11) AS p_syn
                FROM {prefix}_rf r FULL OUTER JOIN {prefix}_sf s ON {on} AND r.column = s.column AND r.bin = s.bin)"""


def nn_sql(real: str, syn: str, cols, prefix: str = "nn", by=()) -> str:
    """CTE ``{prefix}_v``: ([tags,] v) = M1 of syn (per tag) against real."""
    b = "".join(f"b.{x}, " for x in by)
    g = "".join(f"{x}, " for x in by)
    grp = ", ".join(by)
    return f"""{prefix}_d AS (SELECT {b}a.row_id, min({dist_sql('a', 'b', cols)}) AS dist FROM {real} a, {syn} b GROUP BY {b}a.row_id),
{prefix}_v AS (SELECT {g}CASE WHEN max(dist) = min(dist) THEN 0.0 ELSE (avg(dist) - min(dist)) / (max(dist) - min(dist)) END AS v
               FROM {prefix}_d {('GROUP BY ' + grp) if by else ''})"""


def kl_sql(real: str, syn: str, cols, prefix: str = "kl", by=()) -> str:
    """CTE ``{prefix}_v``: ([tags,] v) = M6 (inverse KL) of syn (per tag) against real."""
    g = "".join(f"{x}, " for x in by)
    grp = ", ".join(by)
    return f"""{freqs_sql(real, syn, cols, prefix=prefix + 'f', by=by)},
{prefix}_c AS (SELECT {g}column, sum(p_real * ln(p_real / p_syn)) / sum(p_real) + ln(sum(p_syn) / sum(p_real)) AS kl
               FROM {prefix}f_al GROUP BY {g}column),
{prefix}_v AS (SELECT {g}avg(1.0 / (1.0 + kl)) AS v FROM {prefix}_c {('GROUP BY ' + grp) if by else ''})"""
