"""The corpus pipeline: quality rules, near duplicates, repeated passages,
source mixing, packing.

Each stage takes the documents that the one before it kept, read from Parquet.
Tables that a stage wrote on its way are deleted when the next one begins, by when
its result is written.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.functions.ordering import ordered_index
from mirage.llm.common import discard_unused, stash
from mirage.llm.op1_substrings import remove_repeated
from mirage.llm.op3_quality import quality_verdicts
from mirage.llm.op5_jaccard import jaccard_components
from mirage.llm.op8_mixing import mixed_documents
from mirage.llm.op9_packing import pack_documents
from mirage.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row_key():
    """256 bits that tell rows apart by all their columns, null from empty."""
    return F.unhex(F.sha2(F.to_json(F.struct(*COLUMNS)), 256)).alias("_key")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with ``_n``, a number in the order of doc_id per distinct row (null
    without doc_id): the doc_id itself unless one names different rows. Then the
    second result has the (_n, doc_id) of all rows, else it is None."""
    docs = docs.select(*COLUMNS)
    ids = docs.filter("doc_id is not null").select("doc_id", _row_key()).distinct()
    if ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.withColumn("_n", F.col("doc_id")), None
    order = stash(ordered_index(ids, ["doc_id", "_key"], name="_n"))
    names = order.select(F.col("_key").alias("_k"), "_n")
    return docs.select(*COLUMNS, _row_key()).join(names, F.col("_key") == F.col("_k"), "left").select(*COLUMNS, "_n"), order.select("_n", "doc_id")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, every row by its own verdict."""
    discard_unused(docs)
    keyed = docs.select(*COLUMNS, _row_key())
    kept = quality_verdicts(keyed.select(F.col("_key").alias("doc_id"), "text", "lang", "source")).filter("kept").select(F.col("doc_id").alias("_key"))
    return keyed.join(kept, "_key", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of smallest doc_id of every group of linked rows, equal ones once.
    Texts under one doc_id link on their own. Rows without doc_id are all kept."""
    discard_unused(docs)
    rows, names = _numbered(docs)
    rows = rows if names is None else stash(rows)
    found = jaccard_components(rows.select(F.col("_n").alias("doc_id"), "text")).filter("doc_id is not null").select(
        F.col("doc_id").alias("_n"), F.col("component_id").alias("_c"))
    if names is None:
        keep = found.filter("_n = _c")
    else:
        first = names.select(F.col("_n").alias("_c"), F.col("doc_id").alias("_least"))
        keep = found.distinct().join(names, "_n").join(first, "_c").filter("doc_id = _least")
    kept = rows.join(keep.select("_n"), "_n", "left_semi").dropDuplicates(["_n"]).select(*COLUMNS)
    return kept.unionByName(rows.filter("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that an earlier document's 50-word window has;
    documents without such words keep their text, emptied ones go."""
    discard_unused(docs)
    numbered, _ = _numbered(docs)
    rows = remove_repeated(numbered.select(F.col("_n").alias("doc_id"), F.col("doc_id").alias("__id"), "text", "lang", "source", "n_chars",
                                           F.col("text").alias("__whole")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("__whole"))
    return (rows.filter("n_removed = 0 or n_removed < n_words").select(F.col("__id").alias("doc_id"), text.alias("text"), "lang", "source", "n_chars", "n_removed")
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix takes them: the smallest mix in
    which every document occurs and no source is repeated over 1.25 times."""
    discard_unused(docs)
    return mixed_documents(docs.select(*COLUMNS), total="cover")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    import public_tokenizers
    discard_unused(docs)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages),
          ("mixing sources to target weights", mixing), ("best-fit packing", packing)]
# Packing has no SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    root = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        path = os.path.join(root, str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
