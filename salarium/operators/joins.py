"""Star joins (all equi-joins; the planner picks broadcast vs sort-merge).

No join hints are forced: dimension sides are broadcast by AQE only when
their measured size is under ``spark.sql.autoBroadcastJoinThreshold``,
otherwise the join is a shuffle sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.sources.star import Star

DETAIL_COLUMNS = ["employee_id", "full_name", "company_id", "company_name",
                  "activity_description", "city", "salary_amount", "filename"]


def company_people(star: Star, floor=None) -> DataFrame:
    """Records reduced to one row per (company, employee): ``records``,
    ``paid`` (records with a salary), ``pay``, ``lowest``, ``highest``.

    Shuffled on both keys, so a company with a third of all records is
    spread over all tasks; per-company figures, distinct employees among
    them, are then plain partial sums over this frame."""
    sr = star.records("company_id", "employee_id", "salary_amount")
    if floor is not None:
        sr = sr.where(F.col("salary_amount") >= F.lit(floor))
    return sr.groupBy("company_id", "employee_id").agg(
        F.count(F.lit(1)).alias("records"), F.count("salary_amount").alias("paid"), F.sum("salary_amount").alias("pay"),
        F.min("salary_amount").alias("lowest"), F.max("salary_amount").alias("highest"))


def company_sizes(star: Star, floor=None) -> DataFrame:
    """One row per company that has records: ``company_id, size`` (distinct
    employees), ``paid, pay, lowest, highest``; only companies of the
    dimension."""
    per = company_people(star, floor).groupBy("company_id").agg(
        F.count("employee_id").alias("size"), F.sum("paid").alias("paid"),
        F.sum("pay").cast("decimal(25,2)").alias("pay"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    return per.join(star.companies.select("company_id"), "company_id", "left_semi")


def sizes_of_groups(pay: DataFrame, people: DataFrame) -> DataFrame:
    """``company_sizes`` of records that are aggregated already: of ``pay``
    (company_id, v, f) and ``people`` (company_id, employee_id, one row
    each), f a number of records.  Companies are not looked up."""
    has = F.col("v").isNotNull()
    figures = pay.groupBy("company_id").agg(
        F.sum(F.when(has, F.col("f"))).alias("paid"), F.sum(F.col("v") * F.col("f")).cast("decimal(25,2)").alias("pay"),
        F.min("v").alias("lowest"), F.max("v").alias("highest"))
    sizes = people.groupBy("company_id").agg(F.count("employee_id").alias("size"))
    return sizes.join(figures, "company_id")


def sizes_of_lots(people: DataFrame) -> DataFrame:
    """``company_sizes`` of records that are ``reduced_by_company``: made
    where they lie, only a row for each lot of a company travels.  Companies
    are not looked up."""
    each = people.groupBy("company_id", "_lot", "employee_id").agg(
        F.sum("f").alias("paid"), F.sum(F.col("v") * F.col("f")).alias("pay"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
    lots = each.groupBy("company_id", "_lot").agg(
        F.count("employee_id").alias("size"), F.sum("paid").alias("paid"), F.sum("pay").cast("decimal(25,2)").alias("pay"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    return lots.groupBy("company_id").agg(
        F.sum("size").alias("size"), F.sum("paid").alias("paid"), F.sum("pay").cast("decimal(25,2)").alias("pay"),
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def star_detail(star: Star, where: Column | None = None, extra=()) -> DataFrame:
    """salary_records x documents x companies x employees, all INNER, so a
    record with a NULL or dangling key drops out.  Records are joined to
    documents first: in the adapter they are already partitioned by
    document key, so that join reuses the partitioning."""
    sr = star.salary_records.select("employee_id", "company_id", "document_id", "salary_amount")
    d = star.documents.select(F.col("document_id").alias("_doc"), "filename")
    c = star.companies.select(F.col("company_id").alias("_co"), "company_name",
                              "activity_description", "city")
    e = star.employees.select(F.col("employee_id").alias("_emp"), "full_name")
    df = sr.join(d, sr.document_id == d._doc, "inner")
    if where is None:  # every record stays: the widest columns join last, not to travel twice
        df = (df.join(e, F.col("employee_id") == F.col("_emp"), "inner")
                .join(c, F.col("company_id") == F.col("_co"), "inner"))
    else:
        df = (df.join(c, F.col("company_id") == F.col("_co"), "inner")
                .join(e, F.col("employee_id") == F.col("_emp"), "inner").where(where))
    return df.select(*DETAIL_COLUMNS, "document_id", *extra)


def company_fact(star: Star, where: Column | None = None) -> DataFrame:
    """Companies x salary_records (INNER on company only: records with a
    NULL employee or document survive)."""
    columns = ("employee_id", "company_id", "document_id", "salary_amount")
    df = None
    for records, companies in star.company_parts or [(star.records(*columns), star.companies)]:
        c = companies.select(F.col("company_id").alias("_co"), "company_name", "activity_description", "city")
        part = records.select(*columns).join(c, F.col("company_id") == F.col("_co"), "inner").drop("_co")
        df = part if df is None else df.unionByName(part)
    return df.where(where) if where is not None else df


def employee_fact(star: Star, where: Column | None = None) -> DataFrame:
    """Employees x salary_records."""
    columns = ("employee_id", "document_id", "salary_amount")
    df = None
    for records, employees in star.employee_parts or [(star.records(*columns), star.employees)]:
        e = employees.select(F.col("employee_id").alias("_emp"), "full_name")
        part = records.select(*columns).join(e, F.col("employee_id") == F.col("_emp"), "inner").drop("_emp")
        df = part if df is None else df.unionByName(part)
    return df.where(where) if where is not None else df


def company_left_fact(star: Star) -> DataFrame:
    """Companies LEFT JOIN salary_records (employers without records
    keep one row with NULL record columns)."""
    sr = star.records("employee_id", "company_id", "salary_amount")\
             .withColumnRenamed("company_id", "_co")
    return star.companies.join(sr, star.companies.company_id == sr._co, "left").drop("_co")


def salary_fact(star: Star, floor=1) -> DataFrame:
    """The report's analysis fact -- (salary, city, activity,
    company_name, employee_id) for salary >= floor, records x companies."""
    df = company_fact(star)
    if floor is not None:
        df = df.where(F.col("salary_amount") >= F.lit(floor))
    return df.select("salary_amount", "city", "activity_description", "company_name", "employee_id")


def with_share_of_total(df: DataFrame, value: str, total_of: DataFrame, total_col: str,
                        out: str = "percentage_of_total", scale: float = 100.0) -> DataFrame:
    """Value / (SELECT total) * scale as an uncorrelated scalar subquery
    (planned once, no join)."""
    total = total_of.agg(F.sum(total_col)).scalar()
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), total.cast("double")) * F.lit(scale))
