"""mirage: privacy-aware synthetic tables as Spark jobs.

Everything here is DataFrame work: a private table goes in, fitted generators
are tidy DataFrames of (noisy) marginals and conditionals, synthetic rows come
out of ``spark.range`` plus joins, and privacy / utility metrics are grouped
aggregations. Sub-packages:

* ``functions`` - column expressions (deterministic draws, requirement maths)
  and distributed ordering helpers (ranks without single-task windows).
* ``sources``   - CSV/parquet readers, the model store, the synthetic cache,
  report sinks.
* ``operators`` - preparation, frequencies, distances, metrics, generators,
  merging.
* ``plans``     - request matching, protection levels, serving, epsilon
  search, extension registries.
* ``streaming`` - requests arriving as a stream.
"""

from mirage.session import get_spark, checkpoint_dir, cut_lineage  # noqa: F401

# Functions shipped to Python workers (mapInPandas / applyInPandas bodies) are
# pickled by value, so executors need no copy of this package on their path.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
