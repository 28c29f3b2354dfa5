"""Headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Workloads (SURVEY 7.6): column frequencies on lineitem, nearest distance of
lineitem to 10,000 rows, singling-out on orders, DP fit + 1,000,000 generated
rows, an epsilon sweep over 100 candidates, serving 1,000 requests, and the
flagship slice. Every result is forced with a full computation (noop sink or a
small aggregate), not sampled.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from pyspark.sql import functions as F

    from mirage.session import get_spark
    spark = get_spark(f"local[{cpus}]", max(8, cpus * 2), app="mirage-bench")

    from mirage.functions.draws import draw
    from mirage.operators import distance as D
    from mirage.operators import frequencies as Q
    from mirage.operators import metrics as M
    from mirage.operators import synth as Y
    from mirage.operators.prep import encode, sample_rows
    from mirage.plans import levels as L
    from mirage.plans.catalog import FEATS, SEED, T, cust_enc, roles
    from mirage.plans.catalog_levels import _serve_levels
    from mirage.plans.catalog_synth import flagship

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    li_cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

    def lineitem():
        return T(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), *li_cols)

    def q_column_frequencies():
        real, syn = roles(lineitem())
        sink(Q.column_frequencies(real, syn, li_cols))

    def q_distance_nearest():
        li = lineitem()
        probe = sample_rows(li, 10_000, SEED, check=False)
        sink(D.nearest_distance(li, probe, li_cols))

    def q_singling_out():
        o = T(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "row_id")
        enc, _ = encode(o)
        real, syn = roles(enc)
        sink(M.singling_out(real, syn))

    def q_dp_generate():
        real = cust_enc(spark, sf_dir)
        model = Y.dp_fit(real, 2.0, SEED, FEATS)
        sink(Y.generate(model, 1_000_000, SEED))

    def q_epsilon_sweep():
        real, _ = roles(cust_enc(spark, sf_dir))
        eps = [round(0.1 * (i + 1), 1) for i in range(100)]
        sink(L.epsilon_sweep(real, eps, 1000, SEED, FEATS))

    def q_serve():
        real, _ = roles(cust_enc(spark, sf_dir))
        models = {n: Y.dp_fit(real, e, SEED, FEATS) for n, e in {"eps8": 8.0, "eps2": 2.0, "eps05": 0.5, "eps01": 0.1}.items()}
        c = T(spark, sf_dir, "customer")
        u = draw(SEED, "req", F.col("c_custkey"))
        reqs = (c.withColumn("_u", u).orderBy("_u", "c_custkey").limit(1000).select(
            F.col("c_custkey").alias("request_id"), F.lit("any").alias("level"),
            F.when(F.col("c_nationkey") < 12, F.lit(1000)).otherwise(F.lit(500)).alias("size"),
            F.lit("nearestneighbordistance").alias("privacy_metric"),
            (F.col("c_acctbal") / F.lit(40000.0) + F.lit(0.15)).alias("privacy_value"),
            F.lit("inversekldivergence").alias("utility_metric"),
            (F.lit(0.6) + F.col("c_nationkey").cast("double") / F.lit(80.0)).alias("utility_value"),
            F.lit(0.05).alias("tol")))
        sink(L.serve(real, reqs, _serve_levels(spark), models, None, 10, SEED, FEATS))

    def q_flagship():
        sink(flagship(spark, sf_dir))

    workloads = [("column_frequencies", q_column_frequencies), ("distance_nearest", q_distance_nearest),
                 ("singling_out", q_singling_out), ("dp_fit_generate_1m", q_dp_generate),
                 ("epsilon_sweep_100", q_epsilon_sweep), ("serve_1000", q_serve), ("flagship", q_flagship)]
    only = [a for a in sys.argv[1:]]
    spark.range(1000).agg(F.sum("id")).collect()  # JVM warm-up outside the timings
    times = {}
    for name, fn in workloads:
        if only and name not in only:
            continue
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_workload_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
