"""Catalog: preparation operators and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirage.operators import prep as P
from mirage.plans.catalog import CUST_ENC, SEED, T, cust_raw, dsql, query, rounded, scratch
from mirage.sources import io as S


def _orders_raw(spark, d):
    return T(spark, d, "orders").withColumnRenamed("o_orderkey", "row_id")


@query("prep_drop_nulls", """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def prep_drop_nulls(spark, d):
    docs = T(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return P.drop_nulls(docs.join(T(spark, d, "labels"), "doc_id", "left"))


@query("prep_drop_sentinel", """
SELECT * FROM part
WHERE NOT (p_name = 'SMALL' OR p_brand = 'SMALL' OR p_type = 'SMALL'
           OR CAST(p_partkey AS VARCHAR) = 'SMALL' OR CAST(p_size AS VARCHAR) = 'SMALL')""")
def prep_drop_sentinel(spark, d):
    return P.drop_sentinel(T(spark, d, "part"), "SMALL")


@query("prep_drop_cast", """
SELECT CAST(event_id AS DOUBLE) AS event_id, ts, CAST(user_id AS DOUBLE) AS user_id, event_type,
       CAST(value AS DOUBLE) AS value FROM events""")
def prep_drop_cast(spark, d):
    e = P.drop_columns(T(spark, d, "events"), ["props"])
    return P.cast_columns(e, ["event_id", "user_id", "value"], "double")


@query("prep_sample", f"""
SELECT c_custkey AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM customer
ORDER BY {dsql(SEED, 'row', 'c_custkey')}, c_custkey LIMIT (SELECT count(*) // 3 FROM customer)""")
def prep_sample(spark, d):
    c = cust_raw(spark, d)
    return P.sample_rows(c, c.count() // 3, SEED)


@query("prep_split", f"""
SELECT o_orderkey AS row_id, o_custkey, o_totalprice,
       CASE WHEN {dsql(SEED, 'split', 'o_orderkey')} < 0.2 THEN 'control' ELSE 'train' END AS part
FROM orders""")
def prep_split(spark, d):
    o = _orders_raw(spark, d).select("row_id", "o_custkey", "o_totalprice")
    train, control = P.split(o, 0.2, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(control.withColumn("part", F.lit("control")))


_ORD_DICT = """dict AS (
  SELECT 'o_orderstatus' AS col, v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT AS code
  FROM (SELECT DISTINCT o_orderstatus AS v FROM orders)
  UNION ALL
  SELECT 'o_orderpriority', v, (dense_rank() OVER (ORDER BY v) - 1)::BIGINT FROM (SELECT DISTINCT o_orderpriority AS v FROM orders))"""


@query("prep_encode", f"""
WITH {_ORD_DICT}
SELECT o.o_orderkey AS row_id, o.o_custkey, s.code AS o_orderstatus, o.o_totalprice,
       epoch_us(o.o_orderdate) AS o_orderdate, p.code AS o_orderpriority
FROM orders o JOIN dict s ON s.col = 'o_orderstatus' AND s.v = o.o_orderstatus
              JOIN dict p ON p.col = 'o_orderpriority' AND p.v = o.o_orderpriority""")
def prep_encode(spark, d):
    enc, _ = P.encode(_orders_raw(spark, d))
    return enc


@query("prep_dictionary", f"""
WITH {_ORD_DICT}
SELECT col AS "column", v AS value, code FROM dict""")
def prep_dictionary(spark, d):
    _, e = P.encode(_orders_raw(spark, d))
    return e.dictionary


@query("prep_decode", """
SELECT o_orderkey AS row_id, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def prep_decode(spark, d):
    enc, e = P.encode(_orders_raw(spark, d))
    return P.decode(enc, e)


@query("deliver", """
SELECT c_custkey AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def deliver_q(spark, d):
    enc, e = P.encode(cust_raw(spark, d))
    return S.deliver(enc, e)


@query("schema_rules", """
SELECT * FROM (VALUES ('row_id', 'dtype', 'bigint', NULL::DOUBLE), ('o_custkey', 'dtype', 'bigint', NULL),
  ('o_orderstatus', 'dtype', 'string', NULL), ('o_totalprice', 'dtype', 'double', NULL),
  ('o_orderdate', 'dtype', 'timestamp_ntz', NULL), ('o_orderpriority', 'dtype', 'string', NULL)) t(feature, op, value, num)
WHERE feature <> 'row_id'
UNION ALL SELECT 'o_custkey', 'ge', NULL, min(o_custkey)::DOUBLE FROM orders
UNION ALL SELECT 'o_custkey', 'le', NULL, max(o_custkey)::DOUBLE FROM orders
UNION ALL SELECT 'o_totalprice', 'ge', NULL, min(o_totalprice) FROM orders
UNION ALL SELECT 'o_totalprice', 'le', NULL, max(o_totalprice) FROM orders
UNION ALL SELECT 'o_orderdate', 'ge', NULL, min(epoch_us(o_orderdate))::DOUBLE FROM orders
UNION ALL SELECT 'o_orderdate', 'le', NULL, max(epoch_us(o_orderdate))::DOUBLE FROM orders
UNION ALL SELECT DISTINCT 'o_orderstatus', 'in', o_orderstatus, NULL FROM orders
UNION ALL SELECT DISTINCT 'o_orderpriority', 'in', o_orderpriority, NULL FROM orders""")
def schema_rules(spark, d):
    return P.infer_schema_rules(_orders_raw(spark, d))


def _li(spark, d):
    return (T(spark, d, "lineitem").withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
            .select("row_id", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))


@query("schema_includes", """
WITH a AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) e0, max(l_extendedprice) e1,
                  min(l_discount) d0, max(l_discount) d1 FROM lineitem),
     b AS (SELECT min(l_quantity * 2) q0, max(l_quantity * 2) q1, min(l_extendedprice) e0, max(l_extendedprice) e1,
                  min(l_discount) d0, max(l_discount) d1 FROM lineitem WHERE l_returnflag <> 'R')
SELECT 'l_quantity' AS feature, (b.q0 >= a.q0 AND b.q1 <= a.q1) AS included FROM a, b
UNION ALL SELECT 'l_extendedprice', (b.e0 >= a.e0 AND b.e1 <= a.e1) FROM a, b
UNION ALL SELECT 'l_discount', (b.d0 >= a.d0 AND b.d1 <= a.d1) FROM a, b
UNION ALL SELECT 'l_returnflag', true""")
def schema_includes(spark, d):
    li = _li(spark, d)
    other = li.filter(F.col("l_returnflag") != "R").withColumn("l_quantity", F.col("l_quantity") * 2)
    return P.schema_includes(li, other)


def _part_rules(spark):
    rows = [("p_size", "ge", None, 10.0), ("p_size", "lt", None, 40.0), ("p_retailprice", "le", None, 1500.0),
            ("p_brand", "in", "Brand#1", None), ("p_brand", "in", "Brand#2", None), ("p_brand", "in", "Brand#3", None),
            ("p_size", "dtype", "int", None)]
    return spark.createDataFrame(rows, P.RULE_SCHEMA)


_PART_RULE_SQL = "p_size >= 10 AND p_size < 40 AND p_retailprice <= 1500 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')"


@query("constraints_match", f"SELECT * FROM part WHERE {_PART_RULE_SQL}")
def constraints_match(spark, d):
    return P.match_constraints(T(spark, d, "part"), _part_rules(spark))


@query("constraints_satisfy", f"""
SELECT 'filtered' AS "case", coalesce(bool_and({_PART_RULE_SQL}), true) AS ok FROM part WHERE {_PART_RULE_SQL}
UNION ALL SELECT 'all', coalesce(bool_and({_PART_RULE_SQL}), true) FROM part""")
def constraints_satisfy(spark, d):
    part, rules = T(spark, d, "part"), _part_rules(spark)
    a = P.satisfies(P.match_constraints(part, rules), rules).select(F.lit("filtered").alias("case"), "ok")
    b = P.satisfies(part, rules).select(F.lit("all").alias("case"), "ok")
    return a.unionByName(b)


@query("constraints_extend", f"""
WITH small AS (SELECT * FROM part WHERE p_size < 20),
rules AS (
  SELECT 'p_size' AS feature, 'ge' AS op, NULL AS value, min(p_size)::DOUBLE AS num, 0 AS rule_set FROM small
  UNION ALL SELECT 'p_size', 'le', NULL, max(p_size)::DOUBLE, 0 FROM small
  UNION ALL SELECT 'p_retailprice', 'ge', NULL, min(p_retailprice), 0 FROM small
  UNION ALL SELECT 'p_retailprice', 'le', NULL, max(p_retailprice), 0 FROM small
  UNION ALL SELECT 'p_brand', 'dtype', 'string', NULL, 0 UNION ALL SELECT 'p_size', 'dtype', 'int', NULL, 0
  UNION ALL SELECT 'p_retailprice', 'dtype', 'double', NULL, 0
  UNION ALL SELECT DISTINCT 'p_brand', 'in', p_brand, NULL, 0 FROM small
  UNION ALL SELECT 'p_size', 'ge', NULL, 10.0, 1 UNION ALL SELECT 'p_size', 'lt', NULL, 40.0, 1
  UNION ALL SELECT 'p_retailprice', 'le', NULL, 1500.0, 1
  UNION ALL SELECT 'p_brand', 'in', 'Brand#1', NULL, 1 UNION ALL SELECT 'p_brand', 'in', 'Brand#2', NULL, 1
  UNION ALL SELECT 'p_brand', 'in', 'Brand#3', NULL, 1)
SELECT DISTINCT feature, op, value, num, rule_set FROM rules""")
def constraints_extend(spark, d):
    small = T(spark, d, "part").filter(F.col("p_size") < 20).select("p_size", "p_retailprice", "p_brand")
    user = _part_rules(spark).filter(F.col("op") != "dtype")
    return P.extend_rules(P.infer_schema_rules(small, skip=()), user)


@query("constraints_extend_match", """
SELECT * FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_name,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_custkey FROM customer)
WHERE (c_acctbal IS NULL OR c_acctbal >= 0) AND c_name IN (SELECT c_name FROM customer WHERE c_acctbal >= 0)
  AND c_name IN (SELECT c_name FROM customer WHERE c_nationkey < 15) AND c_nationkey < 12""")
def constraints_extend_match(spark, d):
    """Two wide text domains and nulls: the sets are intersected."""
    raw = T(spark, d, "customer")
    c = raw.select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_name",
                   F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_custkey")
    rich = raw.filter("c_acctbal >= 0")
    first = P.infer_schema_rules(rich.select("c_name")).unionByName(spark.createDataFrame(
        [("c_acctbal", "ge", None, 0.0), ("c_acctbal", "nullable", None, None)], P.RULE_SCHEMA))
    second = P.infer_schema_rules(raw.filter("c_nationkey < 15").select("c_name")).unionByName(
        spark.createDataFrame([("c_nationkey", "lt", None, 12.0)], P.RULE_SCHEMA))
    return P.match_constraints(c, P.extend_rules(first, second))


@query("schema_includes_wide", """
SELECT 'subset' AS "case", 'c_name' AS feature, true AS included UNION ALL SELECT 'subset', 'c_nationkey', true
UNION ALL SELECT 'other', 'c_name', false UNION ALL SELECT 'other', 'c_nationkey', true
UNION ALL SELECT 'nulls', 'c_name', false UNION ALL SELECT 'nulls', 'c_nationkey', false""")
def schema_includes_wide(spark, d):
    """Text columns with a value per row: a subset, other values, nulls."""
    c = T(spark, d, "customer").select("c_name", "c_nationkey")
    cases = {"subset": c.filter("c_nationkey < 20"), "other": c.withColumn("c_name", F.concat("c_name", F.lit("!"))),
             "nulls": c.withColumns({"c_name": F.when(F.col("c_nationkey") > 3, F.col("c_name")),
                                     "c_nationkey": F.when(F.col("c_nationkey") > 3, F.col("c_nationkey"))})}
    outs = [P.schema_includes(c, o).select(F.lit(k).alias("case"), "feature", "included") for k, o in cases.items()]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@query("prep_adapt_types", """
SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(round(l_quantity / 3) AS INTEGER) AS l_quantity,
       CAST(round(l_extendedprice / 7) AS BIGINT) AS l_extendedprice, l_discount FROM lineitem""")
def prep_adapt_types(spark, d):
    from pyspark.sql import types as Ty
    li = _li(spark, d).select("row_id", (F.col("l_quantity") / 3).alias("l_quantity"),
                              (F.col("l_extendedprice") / 7).alias("l_extendedprice"), "l_discount")
    schema = Ty.StructType([Ty.StructField("l_quantity", Ty.IntegerType()), Ty.StructField("l_extendedprice", Ty.LongType()),
                            Ty.StructField("l_discount", Ty.DoubleType())])
    return P.adapt_dtypes(li, schema)


@query("prep_dedupe", """
SELECT c_nationkey, c_mktsegment, min(c_custkey) AS row_id FROM customer GROUP BY c_nationkey, c_mktsegment""")
def prep_dedupe(spark, d):
    return P.dedupe(cust_raw(spark, d).select("row_id", "c_nationkey", "c_mktsegment"))


def _cn(spark, d):
    c = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("row_id"), "c_nationkey", "n_name", "n_regionkey", "c_mktsegment",
                    F.lit("v1").alias("c_version"))


_CN_SQL = """cn AS (SELECT c_custkey AS row_id, c_nationkey, n_name, n_regionkey, c_mktsegment, 'v1' AS c_version
                FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _fd(a, b):
    return f"(SELECT max(k) = 1 FROM (SELECT count(DISTINCT {b}) k FROM cn GROUP BY {a}))"


@query("prep_compress", f"""
WITH {_CN_SQL},
f AS (SELECT {_fd('c_nationkey', 'n_name')} AS nat_name, {_fd('c_nationkey', 'n_regionkey')} AS nat_reg,
             {_fd('n_name', 'n_regionkey')} AS name_reg, {_fd('c_nationkey', 'c_mktsegment')} AS nat_seg,
             {_fd('n_name', 'c_mktsegment')} AS name_seg, {_fd('n_regionkey', 'c_mktsegment')} AS reg_seg)
SELECT 'c_version' AS "column", 'constant' AS action, NULL AS determined_by
UNION ALL SELECT 'c_nationkey', 'kept', NULL
UNION ALL SELECT 'n_name', CASE WHEN nat_name THEN 'derived' ELSE 'kept' END, CASE WHEN nat_name THEN 'c_nationkey' END FROM f
UNION ALL SELECT 'n_regionkey', CASE WHEN nat_reg OR (NOT nat_name AND name_reg) THEN 'derived' ELSE 'kept' END,
                 CASE WHEN nat_reg THEN 'c_nationkey' WHEN NOT nat_name AND name_reg THEN 'n_name' END FROM f
UNION ALL SELECT 'c_mktsegment', CASE WHEN nat_seg OR (NOT nat_name AND name_seg)
                                       OR (NOT nat_reg AND NOT (NOT nat_name AND name_reg) AND reg_seg) THEN 'derived' ELSE 'kept' END,
                 CASE WHEN nat_seg THEN 'c_nationkey' WHEN NOT nat_name AND name_seg THEN 'n_name'
                      WHEN NOT nat_reg AND NOT (NOT nat_name AND name_reg) AND reg_seg THEN 'n_regionkey' END FROM f""")
def prep_compress(spark, d):
    _, ctx = P.compress(_cn(spark, d))
    return ctx.plan


@query("prep_decompress", f"""
WITH {_CN_SQL} SELECT * FROM cn""")
def prep_decompress(spark, d):
    comp, ctx = P.compress(_cn(spark, d))
    return P.decompress(comp, ctx)


_CNULL = """cz AS (SELECT c_custkey AS row_id, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS c_nationkey,
  CASE WHEN c_nationkey < 20 THEN n_name ELSE 'rest' END AS n_name, CASE WHEN c_nationkey % 2 = 0 THEN 'x' END AS half, c_name, n_regionkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _cz(spark, d):
    c = T(spark, d, "customer").join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = F.col("c_nationkey") < 20
    return c.select(F.col("c_custkey").alias("row_id"), F.when(known, F.col("c_nationkey")).alias("c_nationkey"),
                    F.when(known, F.col("n_name")).otherwise("rest").alias("n_name"),
                    F.when(F.col("c_nationkey") % 2 == 0, F.lit("x")).alias("half"), "c_name", "n_regionkey")


@query("prep_compress_nulls", """
SELECT 'c_nationkey' AS "column", 'kept' AS action, NULL AS determined_by UNION ALL SELECT 'n_name', 'derived', 'c_nationkey'
UNION ALL SELECT 'half', 'kept', NULL UNION ALL SELECT 'c_name', 'kept', NULL UNION ALL SELECT 'n_regionkey', 'kept', NULL""")
def prep_compress_nulls(spark, d):
    """A null key determines its name; a column of 'x' and null is no constant;
    the unique c_name determines nothing."""
    return P.compress(_cz(spark, d))[1].plan


@query("prep_decompress_nulls", f"WITH {_CNULL} SELECT * FROM cz")
def prep_decompress_nulls(spark, d):
    comp, ctx = P.compress(_cz(spark, d))
    return P.decompress(comp, ctx)


@query("find_row", """
WITH e AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer)
SELECT min(c_custkey) AS row_id FROM customer, e
WHERE c_acctbal >= e.lo + 3 * ((e.hi - e.lo) / 10.0) AND c_acctbal < e.lo + 4 * ((e.hi - e.lo) / 10.0)""")
def find_row(spark, d):
    c = cust_raw(spark, d)
    e = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).first()  # one row of edges
    w = (e["hi"] - e["lo"]) / 10.0
    return P.find_row(c, "c_acctbal", e["lo"] + 3 * w, e["lo"] + 4 * w)


@query("load_private", """
SELECT c_custkey AS row_id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def load_private(spark, d):
    return S.load_private(T(spark, d, "customer"), sensitive=["c_mktsegment"], key="c_custkey")


@query("load_private_keyless", """
SELECT (row_number() OVER (ORDER BY s_suppkey, s_name, s_nationkey, s_acctbal) - 1)::BIGINT AS row_id,
       s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier""")
def load_private_keyless(spark, d):
    return S.load_private(T(spark, d, "supplier"), sensitive=["s_acctbal"])


@query("csv_roundtrip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_roundtrip(spark, d):
    path = scratch(spark, "csv")
    S.write_csv(T(spark, d, "supplier"), path)
    return S.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("cache_roundtrip", f"""
SELECT c_custkey AS row_id, c_nationkey, c_acctbal, c_mktsegment FROM customer
ORDER BY {dsql(SEED, 'row', 'c_custkey')}, c_custkey LIMIT (SELECT count(*) // 5 FROM customer)""")
def cache_roundtrip(spark, d):
    store = S.Store(spark, scratch(spark, "store"))
    c = cust_raw(spark, d)
    n = c.count() // 5
    store.cache_put("L1", P.sample_rows(c, n, SEED))
    store.cache_put("L2", c.filter(F.col("c_mktsegment") == "BUILDING"))
    store.cache_put("L1", P.sample_rows(c, n, SEED))  # overwrite keeps one copy
    return store.cache_get("L1")
