"""The four-table salary star (companies, documents, employees, salary_records).

Two loaders:

* ``load_star``      native layout: one Parquet folder per table.
* ``load_tpch_star`` adapter over the driver's TPC-H-like tables
  (lineitem -> salary_records, orders -> documents, customer x nation ->
  companies, part -> employees).

Both return a :class:`Star` of lazy DataFrames; nothing is read until an
action runs, and Catalyst prunes columns / pushes filters into the scans.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salarium.sources.versions import manifest

SALARY = T.DecimalType(15, 2)

COMPANIES = T.StructType([
    T.StructField("company_id", T.LongType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("activity_description", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
])
DOCUMENTS = T.StructType([
    T.StructField("document_id", T.LongType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("company_id", T.LongType(), True),
    T.StructField("employee_count", T.IntegerType(), True),
    T.StructField("total_salary_mass", SALARY, True),
])
EMPLOYEES = T.StructType([
    T.StructField("employee_id", T.LongType(), False),
    T.StructField("full_name", T.StringType(), False),
])
SALARY_RECORDS = T.StructType([
    T.StructField("record_id", T.LongType(), True),
    T.StructField("employee_id", T.LongType(), True),
    T.StructField("company_id", T.LongType(), True),
    T.StructField("document_id", T.LongType(), True),
    T.StructField("salary_amount", SALARY, True),
])
SCHEMAS = {
    "companies": COMPANIES,
    "documents": DOCUMENTS,
    "employees": EMPLOYEES,
    "salary_records": SALARY_RECORDS,
}


#: Records for one task of a wide step: of these its sorts and hash maps hold
#: some 100 MB, however many records there are.
TASK_RECORDS = 500_000


@dataclass
class Star:
    companies: DataFrame
    documents: DataFrame
    employees: DataFrame
    salary_records: DataFrame
    # Optional cheaper source of salary_records columns that do not need
    # company_id (the adapter derives company_id by a join).
    _records_without_company: Callable[[], DataFrame] | None = field(default=None, repr=False)

    # Co-partitioned pairs (records, dimension) whose joins together are the
    # join of all records, where the layout has them (``sources/layout.py``).
    company_parts: list | None = field(default=None, repr=False)
    employee_parts: list | None = field(default=None, repr=False)

    # What ``parts`` found.
    _parts: int | None = field(default=None, repr=False)

    def records(self, *cols: str) -> DataFrame:
        """Projection of salary_records.  Catalyst cannot drop a join it
        cannot prove redundant, so when company_id is not requested the
        adapter answers from lineitem alone (same rows: the company join is
        a LEFT join on a unique key)."""
        cols = cols or tuple(self.salary_records.columns)
        if "company_id" not in cols and self._records_without_company is not None:
            return self._records_without_company().select(*cols)
        return self.salary_records.select(*cols)

    def parts(self) -> int:
        """Tasks for a wide step over all records: one for each
        ``TASK_RECORDS`` of them, at least one for each core.  Counts the
        records (of Parquet files, their footers) when first asked."""
        if self._parts is None:
            records = self.records("employee_id")
            cores = records.sparkSession.sparkContext.defaultParallelism
            self._parts = max(cores, -(-records.count() // TASK_RECORDS))
        return self._parts

    def tables(self) -> dict[str, DataFrame]:
        return {
            "companies": self.companies,
            "documents": self.documents,
            "employees": self.employees,
            "salary_records": self.salary_records,
        }


def load_star(spark: SparkSession, base: str) -> Star:
    """Read the native layout: the last version written by ``reload_tables``,
    or plain folders ``{base}/{table}``."""
    held = manifest(spark, base)
    t = {name: spark.read.schema(schema).parquet(*[f"{base}/{f}" for f in held.get(name, [name])])
         for name, schema in SCHEMAS.items()}
    return Star(t["companies"], t["documents"], t["employees"], t["salary_records"])


def load_tpch_star(spark: SparkSession, sf_dir: str) -> Star:
    """Adapter from the driver's TPC-H-like tables to the salary star."""
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    customer, nation = read("customer"), read("nation")
    orders, lineitem, part = read("orders"), read("lineitem"), read("part")

    companies = (customer
                 .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
                 .select(F.col("c_custkey").alias("company_id"),
                         F.col("c_name").alias("company_name"),
                         F.col("c_mktsegment").alias("activity_description"),
                         F.col("n_name").alias("city")))
    employees = part.select(F.col("p_partkey").alias("employee_id"),
                            F.col("p_name").alias("full_name"))
    documents = orders.select(
        F.col("o_orderkey").alias("document_id"),
        F.concat(F.lit("DOC_"), F.col("o_orderkey").cast("string")).alias("filename"),
        F.col("o_custkey").alias("company_id"),
        F.lit(None).cast("int").alias("employee_count"),
        F.lit(None).cast(SALARY).alias("total_salary_mass"))

    def records() -> DataFrame:
        return lineitem.select(
            F.col("l_partkey").alias("employee_id"),
            F.col("l_orderkey").alias("document_id"),
            F.col("l_extendedprice").cast(SALARY).alias("salary_amount"))

    owner = orders.select(F.col("o_orderkey"), F.col("o_custkey").alias("company_id"))
    rec = records()
    salary_records = (rec.join(owner, rec.document_id == owner.o_orderkey, "left")
                      .select(F.lit(None).cast("long").alias("record_id"),
                              "employee_id", "company_id", "document_id", "salary_amount"))
    return Star(companies, documents, employees, salary_records, records)


def star_from_rows(spark: SparkSession, companies, documents, employees, salary_records) -> Star:
    """Star from Python row lists (hand-made fixtures in tests)."""
    def mk(rows, schema):
        return spark.createDataFrame(rows, schema)
    return Star(mk(companies, COMPANIES), mk(documents, DOCUMENTS),
                mk(employees, EMPLOYEES), mk(salary_records, SALARY_RECORDS))
