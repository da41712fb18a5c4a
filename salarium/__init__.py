"""salarium: income-distribution analytics as Spark DataFrame operators.

Layout
------
sources/    typed star-schema loaders, the test-data adapter, ingest, sinks
functions/  column expressions: cohort predicates, buckets, labels, numeric helpers
operators/  joins, grouped statistics, the distributed rank core, inequality
            measures, fuzzy name search and data generators
plans/      the reference's queries and report datasets composed from operators,
            plus the registry used by ``__spark_entry__``
streaming/  incremental ingest of declaration files (Structured Streaming)
"""

from salarium.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
