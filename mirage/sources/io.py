"""Sources and sinks (S1-S7): CSV/parquet in, model store, synthetic cache, reports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True) -> DataFrame:
    """CSV with header; pass a schema (inference scans the data twice)."""
    r = spark.read.option("header", header)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_private(df: DataFrame, sensitive=(), key: str | None = None, id_col: str = "row_id") -> DataFrame:
    """Register a table as the private table: a stable ``row_id`` (from
    ``key``, or a distributed index over all columns) and the sensitive columns
    marked in column metadata. Unknown column names are refused."""
    unknown = [c for c in sensitive if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown sensitive column(s): {unknown}")
    if key is not None:
        if key not in df.columns:
            raise ValueError(f"unknown key column {key!r}")
        out = df.withColumn(id_col, F.col(key).cast("long"))
    else:
        from mirage.functions.ordering import ordered_index
        out = ordered_index(df, df.columns, name=id_col)
    cols = [F.col(id_col)] + [F.col(c).alias(c, metadata={"sensitive": c in sensitive}) for c in df.columns if c != id_col]
    return out.select(*cols)


def sensitive_columns(df: DataFrame) -> list:
    return [f.name for f in df.schema.fields if f.metadata.get("sensitive")]


class Store:
    """Model store, synthetic cache and level table under one root folder.

    The root must be shared storage on a cluster, and permanent: no checkpoint
    or scratch folder outside tests. Models are partitioned by (family, level),
    the cache by level, so reads prune partitions instead of listing files.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self.models = os.path.join(self.root, "models")
        self.cache = os.path.join(self.root, "synthetic")
        self.levels = os.path.join(self.root, "levels")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p)

    # S3 / S4
    def save_model(self, model: DataFrame, family: str, level: str) -> bool:
        """Store a fitted model under its level unless one is stored already."""
        stored = self._read(self.models)
        if stored is not None and stored.filter(F.col("level") == level).limit(1).count():
            return False
        out = model.drop("family").withColumn("family", F.lit(family)).withColumn("level", F.lit(level))
        out.write.mode("append").partitionBy("family", "level").parquet(self.models)
        return True

    def _read(self, path: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException
        if not self._exists(path):
            return None
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:  # folder left without data files (every level removed)
            return None

    def load_model(self, level: str, family: str | None = None) -> DataFrame | None:
        m = self._part(level, "model")
        if m is None:
            m = self._read(self.models)
            if m is None:
                return None
            m = m.filter(F.col("level") == level).drop("level")
        if family is not None:
            m = m.filter(F.col("family") == family)
        return m

    # S6
    def cache_put(self, level: str, syn: DataFrame) -> None:
        """Store / overwrite the synthetic rows of one level (dynamic partition overwrite)."""
        (syn.withColumn("level", F.lit(level)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("level").parquet(self.cache))

    def cache_get(self, level: str) -> DataFrame | None:
        own = self._part(level, "cache")
        c = self._read(self.cache)
        old = None if c is None else c.filter(F.col("level") == level).drop("level")
        return own if own is not None and (old is None or old.isEmpty()) else old

    def cached_levels(self) -> DataFrame:
        c = self._read(self.cache)
        own = self.spark.createDataFrame([(n,) for n, v in self.published().items() if self._exists(f"{v}/cache")], "level string")
        return own if c is None else c.select("level").distinct().unionByName(own).distinct()

    # levels table
    def append_levels(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.levels)

    def read_levels(self) -> DataFrame:
        from mirage.plans.requirements import LEVEL_SCHEMA
        out = self.spark.read.parquet(self.levels) if self._exists(self.levels) else self.spark.createDataFrame([], LEVEL_SCHEMA)
        paths = [f"{v}/levels" for _, v in self.published().items()]
        return out.unionByName(self.spark.read.parquet(*paths)) if paths else out

    # Published levels: everything of one level becomes visible by one commit file.
    # levels/<sha256 of the name>/<version id>/{levels,model,cache,report} is written
    # first; then commit file <number> is created, which only one writer can do, with
    # the version id (or nothing: removed) inside. Readers follow the highest number
    # and never see a version without a commit file.
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folder(self, level: str) -> str:
        import hashlib
        return os.path.join(self.root, "published", hashlib.sha256(level.encode()).hexdigest())

    def _commits(self, folder: str) -> dict[int, str]:
        fs, p = self._fs(os.path.join(folder, "commits"))
        return {int(f.getPath().getName()): f.getPath().toString() for f in fs.listStatus(p)} if fs.exists(p) else {}

    def _read_commit(self, path: str) -> dict:
        import json
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, folder: str, number: int, entry: dict) -> bool:
        """Create commit file ``number``; false if another writer has it."""
        import json

        from py4j.protocol import Py4JJavaError
        staged = os.path.join(folder, f"staged-{uuid.uuid4().hex}")
        fs, p = self._fs(staged)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, target = self._fs(os.path.join(folder, "commits", str(number)))
        fs.mkdirs(target.getParent())
        try:
            won = not fs.exists(target) and fs.rename(p, target)  # a rename never replaces a file
        except Py4JJavaError:
            won = False
        if not won:
            fs.delete(p, False)
        return bool(won)

    def published(self) -> dict[str, str]:
        """Folder of the committed version of every published level."""
        fs, p = self._fs(os.path.join(self.root, "published"))
        out = {}
        for f in (fs.listStatus(p) if fs.exists(p) else []):
            commits = self._commits(f.getPath().toString())
            if commits:
                entry = self._read_commit(commits[max(commits)])
                if entry["version"]:
                    out[entry["level"]] = f"{f.getPath().toString()}/{entry['version']}"
        return out

    def publish(self, level: str, rows: DataFrame, model: DataFrame | None = None, family: str | None = None,
                cache: DataFrame | None = None, report: DataFrame | None = None) -> bool:
        """Make a level's rows, model, cached rows and report visible together.
        False if another writer published the level meanwhile (its version stays);
        what is left of the loser, or of a writer that failed, nobody reads."""
        folder = self._folder(level)
        number = max(self._commits(folder), default=0) + 1
        version = uuid.uuid4().hex
        parts = {"levels": rows, "model": None if model is None else model.drop("family").withColumn("family", F.lit(family)),
                 "cache": cache, "report": report}
        for name, df in parts.items():
            if df is not None:
                df.write.parquet(os.path.join(folder, version, name))
        return self._commit(folder, number, {"level": level, "version": version})

    def _part(self, level: str, name: str) -> DataFrame | None:
        version = self.published().get(level)
        return self._read(f"{version}/{name}") if version else None

    def report_of(self, level: str) -> DataFrame | None:
        return self._part(level, "report")

    def remove_level(self, name: str) -> None:
        """Remove a level from the level table, the model store and the cache."""
        from mirage.session import cut_lineage
        if name in self.published():
            folder = self._folder(name)
            self._commit(folder, max(self._commits(folder)) + 1, {"level": name, "version": None})
        if self._exists(self.levels):
            own = self.spark.read.parquet(self.levels)
            kept = cut_lineage(own.filter(F.col("level") != name))
            kept.write.mode("overwrite").parquet(self.levels)
        # The files of the level, found by its column value: folder names are
        # escaped by the writer, so they are never built from the name.
        jvm = self.spark._jvm
        for path in (self.models, self.cache):
            table = self._read(path)
            if table is None:
                continue
            for f in table.filter(F.col("level") == name).select(F.col("_metadata.file_path")).distinct().collect():
                p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f["file_path"]))
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, False)


# S5
def evaluation_report(results: DataFrame, generator: str, level: str) -> DataFrame:
    """Metric results (metric, size, value[, information]) as a long report table."""
    return results.select(F.lit(level).alias("level"), F.lit(generator).alias("generator"), *results.columns)


def write_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """``text`` writes one line per row, its columns as ``name=value``."""
    if fmt == "text":
        report = report.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("")))
                                                  for c in report.columns]).alias("value"))
    report.write.mode("overwrite").format(fmt).save(path)


# S7
def deliver(syn: DataFrame, encoding=None) -> DataFrame:
    """Hand out a synthetic table, decoded when it was encoded."""
    if encoding is None:
        return syn
    from mirage.operators.prep import decode
    return decode(syn, encoding)
