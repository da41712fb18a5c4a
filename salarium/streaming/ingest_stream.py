"""Incremental ingest of declaration text files with Structured Streaming.

New files in ``source_dir`` are read as lines; each micro-batch goes
through ``parse_declarations`` and its tables are written to
``sink_dir/<table>/batch_id=<n>`` with overwrite, so a retried batch
replaces its own output (exactly-once with the streaming checkpoint).
A file is never split across micro-batches, so a declaration's header and
lines are always parsed together.

Each batch also writes its ``filings`` (employer, period, time); readers let
the last declaration of an employer for a period stand, so a correction
replaces what it corrects, and a replayed batch changes nothing.

A sink has one checkpoint, ``<sink_dir>/_checkpoint`` unless named, so a
second run continues the batch numbers; a sink that holds output without
its checkpoint is refused, as its batches would be overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from salarium.sources.ingest import check_collisions, filings, key_collisions, parse_declarations, standing_audit, standing_star
from salarium.sources.star import SCHEMAS, Star


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def declaration_stream(spark: SparkSession, source_dir: str, sink_dir: str,
                       checkpoint: str | None = None, max_files: int = 1000,
                       available_now: bool = True, decimal_mark: str | None = None) -> StreamingQuery:
    """Start the ingest stream; ``available_now`` processes what is there
    and stops (scheduled runs), otherwise it keeps polling."""
    lines = (spark.readStream.format("text").option("maxFilesPerTrigger", max_files)
             .load(source_dir)
             .select(F.input_file_name().alias("filename"), F.col("value").alias("line"),
                     F.col("_metadata.file_modification_time").alias("filed_at")))
    ckpt = checkpoint or f"{sink_dir.rstrip('/')}/_checkpoint"
    if path_exists(spark, f"{sink_dir}/audit") and not path_exists(spark, f"{ckpt}/offsets"):
        raise ValueError(f"{sink_dir} holds batches of another checkpoint than {ckpt}")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()   # read once for all tables
        try:
            res = parse_declarations(batch, decimal_mark)
            check_collisions(res.collisions)
            outs = dict(res.star.tables())
            outs["filings"] = filings(res.star.documents, batch_id, batch.groupBy("filename").agg(F.max("filed_at").alias("filed_at")))
            outs["rejects"] = res.rejects
            outs["audit"] = res.audit
            for name, df in outs.items():
                df.write.mode("overwrite").parquet(f"{sink_dir}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def load_batches(spark: SparkSession, sink_dir: str) -> Star:
    """All batches of a sink as one star, superseded declarations included.
    Companies and employees repeat across batches and are kept once per
    natural key (all their columns); documents and records never do.  Ids
    shared by different rows fail the load."""
    t = {name: spark.read.parquet(f"{sink_dir}/{name}").select(*schema.fieldNames()) for name, schema in SCHEMAS.items()}
    star = Star(t["companies"].distinct(), t["documents"], t["employees"].distinct(), t["salary_records"])
    check_collisions(key_collisions(star))
    return star


def load_ingested(spark: SparkSession, sink_dir: str) -> Star:
    """What stands after all batches: a later declaration of an employer for
    a period replaces the earlier ones."""
    star = load_batches(spark, sink_dir)
    if not path_exists(spark, f"{sink_dir}/filings"):  # a sink of before filings were kept
        return star
    return standing_star(star, spark.read.parquet(f"{sink_dir}/filings"))


def load_audit(spark: SparkSession, sink_dir: str) -> DataFrame:
    """(status, row_count) over all batches, superseded lines told apart."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sink_dir}/{name}")

    return standing_audit(read("audit"), read("salary_records"), read("filings"))
