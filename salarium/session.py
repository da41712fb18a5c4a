"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings every job in this package relies on.  AQE re-plans joins and
# coalesces shuffle partitions at runtime; skew-join splits hot join keys.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def cluster_conf(shuffle_bytes: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster run, sized from the largest shuffle that
    is left after map-side aggregation (not from the input: a histogram of
    100 TB is far smaller, and map x reduce statuses weigh on the driver).

    * Shuffle partitions start at about one per ``target_partition_bytes``
      of that shuffle (at least 2000); AQE then coalesces small ones toward
      the advisory size instead of keeping the default parallelism.
    * Scan splits are 512 MB so a 100 TB scan is ~200k tasks, each
      streaming one split through whole-stage code.
    * Skew join splits any shuffle partition 5x over the median and above
      512 MB (the "one key holds a third of the rows" case for joins).
    * Broadcasts stay size-checked at 64 MB; the rank core's only explicit
      broadcast is its bucket-offset table, bounded by construction.
    * Checkpoint files of finished jobs are cleaned up.
    """
    parts = max(2000, -(-shuffle_bytes // target_partition_bytes))
    conf = dict(DEFAULT_CONF)
    conf.update({
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    })
    conf.pop("spark.ui.enabled", None)   # the cluster's own choice
    return conf


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "salarium", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks.  On a cluster the session is
    created by the launcher and only ``checkpoint_dir`` is used."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # Small local inputs: let AQE coalesce shuffle partitions only down to
    # 64 KB (default 1 MB), so post-shuffle stages keep all cores busy
    # (measured ~20% faster at sf0.1).  Cluster runs use cluster_conf().
    conf["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = str(64 << 10)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder there.  Only a local-mode session
    without the setting (tests) gets a private temporary folder; a cluster
    session without it is an error, because a machine-local folder would
    not survive the loss of that machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="salarium-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Spark's switch that removes an action's shuffle files as it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Actions on frames made herein leave no shuffle files.  Else these stay
    until the driver's garbage collection finds them, and those of one large
    action lie on disk beside those of the next."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def together(frames: dict):
    """Frames as one: the name of each and its rows as a struct of that name."""
    rows = None
    for name, df in frames.items():
        own = [F.struct(*df.columns).alias(n) if n == name else F.lit(None).cast(other.schema).alias(n) for n, other in frames.items()]
        part = df.select(F.lit(name).alias("_table"), *own)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def materialize_together(frames: dict) -> dict:
    """Several small results of one large frame, made in one job, so that they
    share its shuffles: written once by ``materialize``, then apart again."""
    rows = materialize(together(frames))
    return {name: rows.where(F.col("_table") == name).select(f"{name}.*") for name in frames}


def materialize(df):
    """Cut lineage: write ``df`` once into the shared checkpoint folder
    (reliable checkpoint, never ``localCheckpoint``) and return a DataFrame
    reading it back.  For an intermediate read by several aggregations."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
