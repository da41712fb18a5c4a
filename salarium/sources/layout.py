"""Co-partitioned star: tables bucketed and sorted by their join keys, so the
star joins read matching buckets side by side and the fact is not shuffled.

The records are kept twice, by company and by employee (the other two tables
once).  A key of very many records would fill a single bucket, which one task
reads; so records of keys above an equal share of a bucket are set apart.
Such keys are at most as many as there are buckets, so their rows of the
dimension can always be broadcast, and their records keep a plain layout that
splits at will.  A join is the union of both parts.

The bucket specification is written beside the data and declared again in
each session that loads it (Spark keeps it in its catalog only).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salarium.sources.star import DOCUMENTS, SALARY_RECORDS, SCHEMAS, Star

#: table -> (schema of the star, key)
BUCKETED = {"companies": ("companies", "company_id"), "employees": ("employees", "employee_id"),
            "records_by_company": ("salary_records", "company_id"), "records_by_employee": ("salary_records", "employee_id")}
SPEC = "_buckets.json"


def hot_keys(records: DataFrame, key: str, buckets: int) -> DataFrame:
    """Keys with more than a ``buckets``-th of all records: fewer than
    ``buckets`` rows whatever the data."""
    counts = records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNotNull())
    total = records.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("n") * buckets > total).select(key)


def _declare(spark: SparkSession, base: str, table: str, buckets: int) -> str:
    """The table in the session's catalog, its files under ``base``."""
    schema, key = BUCKETED[table]
    name = f"layout_{table}_{hashlib.md5(base.encode()).hexdigest()[:12]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[schema].fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{base}/{table}'")
    return name


def write_layout(star: Star, base: str, buckets: int) -> None:
    """Write the star under ``base`` in ``buckets`` buckets a table.  Records
    are dealt to their buckets before the write, so each bucket is one sorted
    file."""
    spark = star.companies.sparkSession
    for table, (schema, key) in BUCKETED.items():
        df = star.tables()[schema]
        if schema == "salary_records":
            hot = F.broadcast(hot_keys(df, key, buckets))  # fewer than ``buckets`` rows
            df.join(hot, key, "left_semi").select(*SALARY_RECORDS.fieldNames()).write.mode("overwrite").parquet(f"{base}/{table}_hot")
            df = df.join(hot, key, "left_anti")
        df = df.select(*SCHEMAS[schema].fieldNames()).repartition(buckets, key)
        df.write.mode("overwrite").insertInto(_declare(spark, base, table, buckets))
    star.documents.select(*DOCUMENTS.fieldNames()).write.mode("overwrite").parquet(f"{base}/documents")
    spark.createDataFrame([(json.dumps({"buckets": buckets}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/{SPEC}")


def load_layout(spark: SparkSession, base: str) -> Star:
    """The star of ``write_layout``; ``company_fact`` and ``employee_fact``
    join it part by part."""
    buckets = json.loads(spark.read.text(f"{base}/{SPEC}").first()[0])["buckets"]
    tables = {t: spark.table(_declare(spark, base, t, buckets)) for t in BUCKETED}
    hot = {t: spark.read.schema(SALARY_RECORDS).parquet(f"{base}/{t}_hot") for t in ("records_by_company", "records_by_employee")}
    documents = spark.read.schema(DOCUMENTS).parquet(f"{base}/documents")

    def parts(table: str, dim: str):
        key = BUCKETED[dim][1]
        few = hot[table].select(key).distinct()  # fewer than ``buckets`` rows
        return [(tables[table], tables[dim]), (hot[table], F.broadcast(tables[dim].join(few, key, "left_semi")))]

    everything = tables["records_by_company"].unionByName(hot["records_by_company"])
    by_employee = tables["records_by_employee"].unionByName(hot["records_by_employee"])
    star = Star(tables["companies"], documents, tables["employees"], everything, lambda: by_employee)
    star.company_parts = parts("records_by_company", "companies")
    star.employee_parts = parts("records_by_employee", "employees")
    return star
