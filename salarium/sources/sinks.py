"""Writers: reload the star, persist summary tables, export a result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salarium.session import checkpoint_dir
from salarium.sources.star import Star
from salarium.sources.versions import commit, stage, versions


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder); the file system removes it when the driver
    ends, as lazy readers may need it until then (a driver that is killed
    leaves its folder behind)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/salarium-{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a ``scratch_path`` that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", sort_within=None) -> None:
    """Overwrite ``path`` with ``df`` (a re-run replaces, never appends)."""
    if sort_within:
        df = df.sortWithinPartitions(*sort_within)
    df.write.mode("overwrite").format(fmt).save(path)


def reload_tables(star: Star, base: str) -> dict[str, str]:
    """Reload all four tables under ``base`` as one new version: readers
    see the old tables until all new ones are written, and keep them if the
    job dies.  Records are sorted by company within each file so Parquet
    min/max statistics let company-filtered scans skip row groups."""
    spark = star.companies.sparkSession
    after = (versions(spark, base) or [0])[-1]
    put = {name: stage(df, base, name, ["company_id"] if name == "salary_records" else None) for name, df in star.tables().items()}
    commit(spark, base, put, after=after)
    return {name: f"{base}/{folder}" for name, folder in put.items()}


def replace_table(spark: SparkSession, base: str, name: str, df: DataFrame) -> int:
    """One table anew as the next version, the others as they are; ``df`` may
    be computed from the table it replaces."""
    after = (versions(spark, base) or [0])[-1]
    return commit(spark, base, {name: stage(df, base, name)}, after=after)


def decimals_as_double(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def export_result(df: DataFrame, path: str, fmt: str = "json") -> str:
    """Export a filtered dataset; decimals leave as floats (JSON
    records like the reference API)."""
    write_table(decimals_as_double(df), path, fmt=fmt)
    return path
