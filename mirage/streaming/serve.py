"""Requests arriving as a stream.

Request files land in a folder; a Structured Streaming file source reads them and
``foreachBatch`` serves each micro-batch. What a batch learns is kept for the next:

* ``scores/``: the scores of every (level, size, attempt, metric) drawn so far. A
  batch draws and scores only what no earlier batch did, so a second batch for known
  levels and sizes makes no table at all;
* ``pending/``: the requests no level could serve, as they came. ``prepare`` takes
  them (``pending_requests``) and ``serve_pending`` tries them again on the levels
  there are then;
* ``served/``: the outcome per request; a request served later counts as served.

All three are partitioned by ``batch_id`` and written with dynamic partition
overwrite: a batch replayed after a failure replaces its own rows, and draws are
functions of the seed, so its scores come out the same. The checkpoint folder makes
the stream resume where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirage.plans.levels import SCORE_SCHEMA, serve_known
from mirage.plans.requirements import REQUEST_SCHEMA
from mirage.session import cut_lineage

OUTCOME_SCHEMA = "request_id long, level string, attempt int, status string"
_REQUEST_COLUMNS = [c.split()[0] for c in REQUEST_SCHEMA.split(", ")]


def _table(spark, out_dir: str, name: str, schema: str) -> DataFrame:
    """A table of the work folder with its ``batch_id``, empty before the first write."""
    path = os.path.join(out_dir, name)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs):
        return spark.createDataFrame([], schema + ", batch_id long")
    return spark.read.schema(schema + ", batch_id long").parquet(path)


def _put(df: DataFrame, out_dir: str, name: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(os.path.join(out_dir, name)))


def known_scores(spark, out_dir: str) -> DataFrame:
    """One row per (level, created, size, attempt, metric); equal rows of a replay count once."""
    keys = ["level", "created", "size", "attempt", "metric"]
    return _table(spark, out_dir, "scores", SCORE_SCHEMA).groupBy(*keys).agg(F.min("value").alias("value"))


def serve_batch(batch: DataFrame, batch_id: int, out_dir: str, real: DataFrame, levels: DataFrame, models: dict,
                store=None, seed=0, cols=None) -> DataFrame:
    """Serve one micro-batch and keep what it learned; returns its outcome."""
    spark = real.sparkSession
    batch = cut_lineage(batch.select(*_REQUEST_COLUMNS))
    res, new = serve_known(real, batch, levels, models, known_scores(spark, out_dir), store, seed=seed, cols=cols)
    res = cut_lineage(res)
    if new is not None:
        _put(new, out_dir, "scores", batch_id)
    _put(batch.join(res.filter("status = 'pending'").select("request_id"), "request_id", "left_semi"), out_dir, "pending", batch_id)
    _put(res, out_dir, "served", batch_id)  # last: a batch with an outcome is whole
    return res


def served_requests(spark, out_dir: str) -> DataFrame:
    """(request_id, level, attempt, status): the latest outcome of every request."""
    rows = _table(spark, out_dir, "served", OUTCOME_SCHEMA)
    best = F.min(F.struct((F.col("status") != "served").alias("open"), F.col("batch_id"), "level", "attempt", "status")).alias("b")
    return rows.groupBy("request_id").agg(best).select("request_id", "b.level", "b.attempt", "b.status")


def pending_requests(spark, out_dir: str) -> DataFrame:
    """The requests that no level could serve so far, each once."""
    waiting = _table(spark, out_dir, "pending", REQUEST_SCHEMA).drop("batch_id").dropDuplicates(["request_id"])
    return waiting.join(served_requests(spark, out_dir).filter("status = 'served'").select("request_id"), "request_id", "left_anti")


def serve_pending(out_dir: str, round_id: int, real: DataFrame, levels: DataFrame, models: dict, store=None,
                  seed=0, cols=None) -> DataFrame:
    """Try the pending requests again on the levels there are now. ``round_id`` (0,
    1, ...) names the try: the same one again replaces its own rows."""
    waiting = pending_requests(real.sparkSession, out_dir)
    return serve_batch(waiting, -1 - round_id, out_dir, real, levels, models, store, seed, cols)


def start_serving(spark, requests_dir: str, out_dir: str, real: DataFrame, levels: DataFrame, models: dict,
                  store=None, seed=0, cols=None, available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    stream = spark.readStream.schema(REQUEST_SCHEMA).parquet(requests_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        serve_batch(batch, batch_id, out_dir, real, levels, models, store, seed, cols)

    w = (stream.writeStream.foreachBatch(handle)
         .option("checkpointLocation", os.path.join(out_dir, "_checkpoint")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def serve_stream(real: DataFrame, requests: DataFrame, levels: DataFrame, models: dict, work_dir: str,
                 seed=0, cols=None, chunks: int = 3, store=None) -> DataFrame:
    """Write ``requests`` as ``chunks`` arrival files, serve them as a stream,
    return everything served (equals the batch ``serve`` result)."""
    spark = real.sparkSession
    req_dir = os.path.join(work_dir, "requests")
    part = F.pmod(F.xxhash64("request_id"), F.lit(chunks))
    (requests.select(*_REQUEST_COLUMNS)
     .withColumn("_chunk", part).write.partitionBy("_chunk").parquet(os.path.join(work_dir, "staged")))
    for i in range(chunks):  # arrivals: one folder of files per chunk
        staged = spark.read.parquet(os.path.join(work_dir, "staged", f"_chunk={i}"))
        staged.write.mode("append").parquet(req_dir)
    q = start_serving(spark, req_dir, work_dir, real, levels, models, store, seed, cols)
    q.awaitTermination()
    return served_requests(spark, work_dir)
