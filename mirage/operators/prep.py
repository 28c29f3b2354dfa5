"""Preparation operators (P1-P19): cleaning, sampling, splitting, encoding,
schema rules and constraints, compression.

Every operator takes and returns DataFrames; the only driver-side values are
small metadata (a rule table, one row of per-column statistics).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirage.functions.draws import draw
from mirage.functions.ordering import ordered_index, take_first

# Dictionaries up to this many entries per column are broadcast into joins;
# larger ones use a shuffle join.
BROADCAST_DICT_ROWS = 2_000_000

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt) -> bool:
    return isinstance(dt, NUMERIC)


# --- P1-P4 -----------------------------------------------------------------

def drop_nulls(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column."""
    return df.na.drop("any")


def drop_sentinel(df: DataFrame, sentinel: str = "?", cols=None) -> DataFrame:
    """Drop rows where any column (as text) equals the sentinel."""
    cols = cols or df.columns
    hit = reduce(lambda a, b: a | b, [F.col(c).cast("string").eqNullSafe(F.lit(sentinel)) for c in cols])
    return df.filter(~hit)


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P3."""
    return df.drop(*cols)


def cast_columns(df: DataFrame, cols, to: str = "double") -> DataFrame:
    """Cast many columns at once; values that do not parse become null."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as {to})") for c in cols})


# --- P5-P6 -----------------------------------------------------------------

def sample_rows(df: DataFrame, n: int, seed: int, id_col: str = "row_id", check: bool = True) -> DataFrame:
    """P5: exactly ``n`` rows without replacement, chosen by a seeded draw order.

    Raises when the table has fewer than ``n`` rows (as sampling without
    replacement must).
    """
    if check:
        total = df.count()
        if n > total:
            raise ValueError(f"cannot sample {n} rows from {total} without replacement")
    keyed = df.withColumn("_u", draw(seed, "row", F.col(id_col)))
    return take_first(keyed, ["_u", id_col], n).drop("_u")


def split(df: DataFrame, test_size: float = 0.2, seed: int = 0, id_col: str = "row_id",
          exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, control). Hash form by default: no shuffle, stable per row.

    ``exact=True`` puts exactly round(n * test_size) rows in control (draw order).
    """
    u = draw(seed, "split", F.col(id_col))
    if not exact:
        return df.filter(u >= test_size), df.filter(u < test_size)
    n_ctl = int(round(df.count() * test_size))
    ranked = ordered_index(df.withColumn("_u", u), ["_u", id_col], name="_i")
    return (ranked.filter(F.col("_i") >= n_ctl).drop("_u", "_i"),
            ranked.filter(F.col("_i") < n_ctl).drop("_u", "_i"))


# --- P9-P10 encode / decode --------------------------------------------------

@dataclass
class Encoding:
    """Dictionary (column, value, code) plus the original schema."""
    dictionary: DataFrame
    schema: T.StructType
    categorical: list = field(default_factory=list)
    temporal: list = field(default_factory=list)
    sizes: dict = field(default_factory=dict)


# Dictionaries with at most this many entries in total are numbered on the
# driver (after a size check); larger ones with the distributed index.
LOCAL_DICT_ROWS = 200_000
DICT_SCHEMA = "column string, value string, code long"


def build_dictionary(df: DataFrame, cols) -> DataFrame:
    """Codes 0..k-1 per column in value order. Distinct first (map-side
    combined); a small dictionary (size checked) is numbered locally, a large
    one with the distributed index (no single task, no driver)."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], DICT_SCHEMA)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    distinct = df.select(pairs.alias("kv")).select("kv.*").filter(F.col("value").isNotNull()).distinct()
    from mirage.session import cut_lineage
    distinct = cut_lineage(distinct)
    head = distinct.limit(LOCAL_DICT_ROWS + 1).collect()
    if len(head) <= LOCAL_DICT_ROWS:
        by_col: dict = {}
        for r in head:
            by_col.setdefault(r["column"], []).append(r["value"])
        rows = [(c, v, i) for c, vs in by_col.items()
                for i, v in enumerate(sorted(vs, key=lambda x: x.encode("utf-8")))]  # Spark's binary string order
        return spark.createDataFrame(rows, DICT_SCHEMA)
    return ordered_index(distinct, ["value"], group_cols=["column"], name="code")


def _as_ts(c: str, dt) -> Column:
    col = F.col(c)
    if isinstance(dt, T.DateType):
        col = col.cast("timestamp")
    elif isinstance(dt, T.TimestampNTZType):
        col = col.cast("string").cast("timestamp")  # wall clock read in the (UTC) session zone
    return col


CATEGORICAL_MARK = "mirage_categorical"


def categorical_columns(df: DataFrame) -> list[str]:
    """Columns that are text, boolean, or ``encode``'s codes of such."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) or f.metadata.get(CATEGORICAL_MARK)]


def encode(df: DataFrame, dictionary: DataFrame | None = None, skip=("row_id",)) -> tuple[DataFrame, Encoding]:
    """Strings -> integer codes (dictionary join), timestamps -> epoch
    microseconds, numbers unchanged. Code columns are marked in their metadata.
    Returns the encoded table and the Encoding."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    cats = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]
    times = [f.name for f in fields if isinstance(f.dataType, TIMES)]
    if dictionary is None:
        dictionary = build_dictionary(df, cats)
    sizes = {}
    if cats:
        sizes = {r["column"]: r["n"] for r in
                 dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for c in cats:
        d = (dictionary.filter(F.col("column") == c)
             .select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}")))
        if sizes.get(c, 0) <= BROADCAST_DICT_ROWS:
            d = F.broadcast(d)
        out = (out.join(d, out[c].cast("string").eqNullSafe(d[f"_v_{c}"]), "left")
               .withColumn(c, F.col(f"_c_{c}")).drop(f"_v_{c}", f"_c_{c}"))
    dtypes = dict((f.name, f.dataType) for f in fields)
    for c in times:
        out = out.withColumn(c, F.unix_micros(_as_ts(c, dtypes[c])))
    out = out.select(*[F.col(c).alias(c, metadata={CATEGORICAL_MARK: True}) if c in cats else c for c in df.columns])
    return out, Encoding(dictionary, df.schema, cats, times, sizes)


def decode(df: DataFrame, enc: Encoding | None) -> DataFrame:
    """P10: codes -> values (rounded and clamped into the code range),
    epoch microseconds -> timestamps, original types restored."""
    if enc is None:
        raise ValueError("decode needs the Encoding returned by encode (no dictionary given)")
    out = df
    for c in enc.categorical:
        if c not in df.columns:
            continue
        top = max(enc.sizes.get(c, 1) - 1, 0)
        d = (enc.dictionary.filter(F.col("column") == c)
             .select(F.col("code").alias(f"_c_{c}"), F.col("value").alias(f"_v_{c}")))
        if enc.sizes.get(c, 0) <= BROADCAST_DICT_ROWS:
            d = F.broadcast(d)
        code = F.least(F.greatest(F.round(F.col(c)).cast("long"), F.lit(0)), F.lit(top))
        out = (out.withColumn(c, code).join(d, F.col(c) == d[f"_c_{c}"], "left")
               .withColumn(c, F.col(f"_v_{c}")).drop(f"_c_{c}", f"_v_{c}"))
    types = {f.name: f.dataType for f in enc.schema.fields}
    for c in enc.temporal:
        if c in df.columns:
            ts = F.timestamp_micros(F.round(F.col(c)).cast("long"))
            out = out.withColumn(c, ts.cast(types[c]) if not isinstance(types[c], T.TimestampNTZType)
                                 else ts.cast("string").cast("timestamp_ntz"))
    casts = {c: F.col(c).cast(types[c]) for c in out.columns if c in types and c not in enc.temporal}
    return out.withColumns(casts).select(*df.columns)


# --- P11-P15 schema rules and constraints ----------------------------------

# A rule table may also have ``rule_set`` (long, 0 where absent): ``in`` rules of
# one feature and set are alternatives, different sets must all hold. Null fails a
# comparison unless its set has a ``nullable`` rule for the feature, and fails
# ``in`` rules unless null is one of the values.
RULE_SCHEMA = "feature string, op string, value string, num double"
COMPARE = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
           "eq": lambda a, b: a == b}


def _rule_sets(rules: DataFrame) -> DataFrame:
    """The rules with ``rule_set`` (0 where absent)."""
    own = F.coalesce(F.col("rule_set"), F.lit(0)) if "rule_set" in rules.columns else F.lit(0)
    return rules.select("feature", "op", "value", "num", own.cast("long").alias("rule_set"))


def _numeric_like(dt) -> bool:
    return is_numeric(dt) or isinstance(dt, TIMES)


def infer_schema_rules(df: DataFrame, skip=("row_id",)) -> DataFrame:
    """min/max per numeric or time column from one aggregation, every value
    of a text column as an ``in`` rule (the domain stays a table, however wide),
    and where null occurs (``nullable``, or null among the ``in`` values)."""
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if f.name not in skip]
    aggs = []
    for f in fields:
        if _numeric_like(f.dataType):
            aggs += [F.min(f.name).cast("double").alias(f"{f.name}__min"), F.max(f.name).cast("double").alias(f"{f.name}__max"),
                     F.max(F.col(f.name).isNull()).alias(f"{f.name}__null")]
    stats = df.select(*[F.unix_micros(_as_ts(f.name, f.dataType)).alias(f.name)
                        if isinstance(f.dataType, TIMES) else F.col(f.name) for f in fields]).agg(*aggs).first() if aggs else {}
    rules = []
    for f in fields:
        rules.append((f.name, "dtype", f.dataType.simpleString(), None))
        if _numeric_like(f.dataType):
            for op, end in (("ge", "min"), ("le", "max")):
                if stats[f"{f.name}__{end}"] is not None:
                    rules.append((f.name, op, None, stats[f"{f.name}__{end}"]))
            if stats[f"{f.name}__null"]:
                rules.append((f.name, "nullable", None, None))
    base = spark.createDataFrame(rules, RULE_SCHEMA)
    text = [f.name for f in fields if not _numeric_like(f.dataType)]
    if not text:
        return base
    dom = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                                         for c in text])).alias("kv"))
           .select("kv.*").distinct().select("feature", F.lit("in").alias("op"), "value", F.lit(None).cast("double").alias("num")))
    return base.unionByName(dom)


def _scalar_predicate(df: DataFrame, rules: list) -> Column:
    """The conjunction of all rules but ``in``."""
    nullable = {(r["feature"], r["rule_set"]) for r in rules if r["op"] == "nullable"}
    types = {f.name: f.dataType for f in df.schema.fields}
    preds = [F.lit(True)]
    for r in rules:
        feat, op = r["feature"], r["op"]
        if feat not in types:
            preds.append(F.lit(False))  # a rule on a missing column cannot hold
            continue
        c = F.col(feat)
        if op == "dtype":
            preds.append(c.isNull() | F.expr(f"try_cast(`{feat}` as {r['value']})").isNotNull())
        elif op in COMPARE:
            num = F.unix_micros(_as_ts(feat, types[feat])).cast("double") if isinstance(types[feat], TIMES) else c.cast("double")
            held = COMPARE[op](num, F.lit(r["num"])) if r["num"] is not None else COMPARE[op](c.cast("string"), F.lit(r["value"]))
            preds.append(c.isNull() | held if (feat, r["rule_set"]) in nullable else held)
        elif op != "nullable":
            raise ValueError(f"unknown rule op {op!r}")
    return F.coalesce(reduce(lambda a, b: a & b, preds), F.lit(False))


def match_constraints(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Keep rows that satisfy every rule. Only rules other than ``in`` and
    the names of the value sets (columns x rule sets) reach the driver; each
    value set is a null-safe semi join that AQE plans by its size."""
    sets = _rule_sets(rules)
    out = df.filter(_scalar_predicate(df, sets.filter(F.col("op") != "in").collect()))
    for r in sorted(sets.filter(F.col("op") == "in").select("feature", "rule_set").distinct().collect()):
        if r["feature"] not in df.columns:
            return df.filter(F.lit(False))
        values = sets.filter((F.col("op") == "in") & (F.col("feature") == r["feature"]) & (F.col("rule_set") == r["rule_set"]))
        v = values.select(F.col("value").alias("__rule_value"))
        out = out.join(v, out[r["feature"]].cast("string").eqNullSafe(F.col("__rule_value")), "left_semi")
    return out


def satisfies(df: DataFrame, rules: DataFrame) -> DataFrame:
    """One row, ``ok`` = every row satisfies the rules."""
    n = F.count(F.lit(1))
    both = df.agg(n.alias("n")).unionByName(match_constraints(df, rules).agg((-n).alias("n")))
    return both.agg((F.sum("n") == 0).alias("ok"))


def extend_rules(a: DataFrame, b: DataFrame) -> DataFrame:
    """Conjunction of two rule tables: the rule sets of ``b`` are numbered
    after those of ``a``."""
    left, right = _rule_sets(a), _rule_sets(b)
    top = left.agg(F.coalesce(F.max("rule_set"), F.lit(0)).alias("m")).first()["m"] + 1
    return left.unionByName(right.withColumn("rule_set", F.col("rule_set") + F.lit(top))).dropDuplicates()


def schema_includes(df: DataFrame, other: DataFrame, skip=("row_id",)) -> DataFrame:
    """Per feature, does ``df``'s inferred domain include ``other``'s?
    Ranges, null and every text value are compared."""
    def summary(rules, suffix):
        return rules.groupBy("feature").agg(
            F.min(F.when(F.col("op") == "ge", F.col("num"))).alias(f"lo{suffix}"),
            F.max(F.when(F.col("op") == "le", F.col("num"))).alias(f"hi{suffix}"),
            F.max(F.col("op") == "nullable").alias(f"null{suffix}"),
            F.first(F.when(F.col("op") == "dtype", F.col("value")), ignorenulls=True).alias(f"dtype{suffix}"))
    r1, r2 = infer_schema_rules(df, skip), infer_schema_rules(other, skip)
    dom_a = r1.filter(F.col("op") == "in").select(F.col("feature").alias("_f"), F.col("value").alias("_v"))
    dom_b = r2.filter(F.col("op") == "in").select("feature", "value")
    missing = (dom_b.join(dom_a, (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")), "left_anti")
               .groupBy("feature").agg(F.count(F.lit(1)).alias("n_missing")))
    j = summary(r1, "").join(summary(r2, "2"), "feature", "full_outer").join(missing, "feature", "left")
    ok = (F.col("dtype").isNotNull() & F.col("dtype2").isNotNull()
          & (F.col("lo2").isNull() | (F.col("lo2") >= F.col("lo")))
          & (F.col("hi2").isNull() | (F.col("hi2") <= F.col("hi")))
          & (F.col("null") | ~F.col("null2"))
          & F.col("n_missing").isNull())
    return j.select("feature", F.coalesce(ok, F.lit(False)).alias("included"))


# --- P16-P19 -----------------------------------------------------------------

def adapt_dtypes(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the training types; integral targets are rounded first."""
    out = {}
    for f in schema.fields:
        if f.name not in df.columns:
            continue
        if isinstance(f.dataType, INTEGRAL) and is_numeric(df.schema[f.name].dataType):
            out[f.name] = F.round(F.col(f.name)).cast(f.dataType)
        else:
            out[f.name] = F.col(f.name).cast(f.dataType)
    return df.withColumns(out)


def dedupe(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Drop duplicate rows (ignoring the row id); the lowest id is kept."""
    cols = [c for c in df.columns if c != id_col]
    if id_col not in df.columns:
        return df.dropDuplicates(cols)
    return df.groupBy(*cols).agg(F.min(id_col).alias(id_col)).select(*df.columns)


@dataclass
class Compression:
    constants: dict
    derived: list          # (determinant, derived column)
    maps: dict             # derived column -> DataFrame(determinant, derived)
    plan: DataFrame        # (column, action, determined_by)
    columns: list


DEPENDENCY_SAMPLE = 1000  # values of a column in which counterexamples are looked for first


def _same(b: str):
    """Whether a group has one value of ``b`` (null is a value)."""
    return F.min(b).eqNullSafe(F.max(b)) & ((F.count(b) == 0) | (F.count(b) == F.count(F.lit(1))))


def _grouped_same(df: DataFrame, picks: dict, others: list) -> dict:
    """Determinant -> (values, {column: one value in each group}), all determinants
    in one pass: a row is listed under each determinant whose condition in ``picks``
    holds, groups are combined before the shuffle."""
    import json
    entry = [F.when(cond, F.struct(F.lit(a).alias("a"), text.alias("v"))) for a, (cond, text) in picks.items()]
    rows = df.select(F.explode(F.array_compact(F.array(*entry))).alias("_d"), *others)
    groups = rows.groupBy("_d.a", "_d.v").agg(*[_same(b).alias(b) for b in others])
    got = groups.groupBy("a").agg(F.count(F.lit(1)).alias("__k"), F.to_json(F.struct(*[F.bool_and(b).alias(b) for b in others])).alias("fd"))
    return {r["a"]: (r["__k"], json.loads(r["fd"])) for r in got.collect()}  # one row per column


def functional_dependencies(df: DataFrame, cols: list, rows: int, distinct: dict) -> dict:
    """{a: columns b with a -> b} among ``cols``; columns with a value of their own in
    every row are left out. Two passes at most: first the groups of about
    ``DEPENDENCY_SAMPLE`` values of every column (those of least hash, ``distinct``
    estimates how many there are) give counterexamples, which disprove most candidates
    for certain; then all groups of the columns that are still candidates."""
    text = {c: (F.col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.col(c)).cast("string") for c in cols}
    grain = 1 << 20

    def some(c):
        part = max(1, -(-grain * DEPENDENCY_SAMPLE // max(distinct[c], 1)))
        return F.lit(True) if part >= grain else F.pmod(F.xxhash64(text[c]), F.lit(grain)) < F.lit(part)

    first = _grouped_same(df, {c: (some(c), text[c]) for c in cols}, cols)
    may = {a: {b for b in cols if b != a and first.get(a, (0, {}))[1].get(b, True)} for a in cols}
    open_cols = [a for a in cols if may[a]]
    if not open_cols:
        return {}
    whole = _grouped_same(df, {a: (F.lit(True), text[a]) for a in open_cols}, sorted(set().union(*may.values())))
    return {a: {b for b in may[a] if fd.get(b)} for a, (k, fd) in whole.items() if k < rows}


def compress(df: DataFrame, skip=("row_id",)) -> tuple[DataFrame, Compression]:
    """Drop constant columns and columns functionally determined by an
    earlier kept column. A -> B holds when every group of A has one B value
    (null is a value). A column with a value of its own in every row determines all
    others and is no determinant (it would save nothing). Three passes whatever the
    number of columns, see ``functional_dependencies``."""
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in skip]
    n = F.count(F.lit(1))
    one = df.agg(n.alias("__n"), *[(F.min(c).eqNullSafe(F.max(c)) & F.count(c).isin(F.lit(0), n)).alias(c) for c in cols],
                 *[F.first(c, ignorenulls=True).alias(f"{c}__v") for c in cols],
                 *[F.approx_count_distinct(c).alias(f"{c}__d") for c in cols]).first()
    constants = {c: one[f"{c}__v"] for c in cols if one[c]}
    live = [c for c in cols if c not in constants]
    fd = functional_dependencies(df, live, one["__n"], {c: one[f"{c}__d"] for c in live}) if len(live) > 1 else {}
    kept, derived = [], []
    for b in live:
        det = next((a for a in kept if b in fd.get(a, ())), None)
        if det is None:
            kept.append(b)
        else:
            derived.append((det, b))
    maps = {b: df.select(a, b).dropDuplicates([a]) for a, b in derived}
    rows = [(c, "constant", None) for c in cols if c in constants]
    rows += [(b, "derived", a) for a, b in derived] + [(c, "kept", None) for c in kept]
    plan = spark.createDataFrame(rows, "column string, action string, determined_by string")
    keep = [c for c in df.columns if c in skip or c in kept]
    return df.select(*keep), Compression(constants, derived, maps, plan, df.columns)


def decompress(df: DataFrame, ctx: Compression) -> DataFrame:
    """P18 inverse: re-attach derived columns by joining their maps, constants as literals."""
    out = df
    for a, b in ctx.derived:
        m = ctx.maps[b].withColumnRenamed(a, "__det")
        out = out.join(m, F.col(a).eqNullSafe(F.col("__det")), "left").drop("__det")  # AQE broadcasts a small map
    for c, v in ctx.constants.items():
        out = out.withColumn(c, F.lit(v))
    return out.select(*[c for c in ctx.columns if c in out.columns])


def find_row(df: DataFrame, col: str, low: float, high: float, id_col: str = "row_id") -> DataFrame:
    """First row id (lowest) whose value lies in the half-open [low, high)."""
    return (df.filter((F.col(col) >= F.lit(low)) & (F.col(col) < F.lit(high)))
            .agg(F.min(id_col).alias(id_col)))
