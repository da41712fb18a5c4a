"""Declaration ingest: extracted declaration text -> the four typed tables.

The reference describes this step (PDF text -> regex extraction -> cleaning
-> dedup -> normalised tables) but ships no code, so the line format below
is ours.  Input is line-oriented, exactly what ``spark.read.text`` yields
for a folder of extracted declarations: ``(filename, line)``.

Line format (one declaration per file)::

    EMPLOYER: <company name> ; ACTIVITY: <activity> ; CITY: <city>
    <employee full name> ; <amount>

Amounts may use spaces or either separator convention ("12 345,67",
"12,345.67", "12345.67", optional "MAD").  ``decimal_mark`` names the
convention of a run; without it an amount that both conventions read
differently ("7,500", "1.500") is rejected as ambiguous.

Every line ends in exactly one status: the used header of its file, loaded,
duplicate, blank, or one of the rejects (a header without an employer, a
header of a file with several, an employee line of a file without exactly
one good header, an amount that does not parse or is ambiguous, a line of
no known form).  Repeated (document, employee, amount) lines are
duplicates.  A declaration whose lines are all rejected still is a
document.

An employer may file again for a period: of all its declarations for that
period only the last stands (``standing``), in the same batch or a later one,
and the lines of the others end as superseded.

Rows are identified by their natural keys; the 64-bit ids are hashes of
them, and ``collisions`` counts ids with several natural keys per table
(``check_collisions`` fails a load that has any).

Lines of one file never have to meet: employee lines are aggregated by
(file, employee, amount) before they join their file's header, and counts
per file come from partial sums, so one huge declaration spreads over all
tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.sources.sinks import scratch_path
from salarium.sources.star import SALARY, Star

# The line patterns of our declaration format.
HEADER_RE = r"^\s*EMPLOYER\s*:\s*(.*?)\s*;\s*ACTIVITY\s*:\s*(.*?)\s*;\s*CITY\s*:\s*(.*?)\s*$"
EMPLOYEE_RE = r"^\s*([^;]*?)\s*;\s*([^;]*?)\s*(?:MAD)?\s*$"
STATUSES = ("header", "loaded", "duplicate", "blank", "bad_header", "extra_header", "missing_header", "bad_amount",
            "ambiguous_amount", "unparsed")


def clean_text(c: Column) -> Column:
    """Trim and collapse inner whitespace; empty -> NULL."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(t == "", F.lit(None)).otherwise(t)


def bare_amount(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[\s\u00a0\u202f]", "")


def is_ambiguous(bare: Column) -> Column:
    """One separator before exactly three digits: thousands or decimals."""
    return bare.rlike(r"^\d{1,3}[.,]\d{3}$")


def parse_amount(raw: Column, decimal_mark: str | None = None) -> Column:
    """'12 345,67' / '12,345.67' / '12345.67' -> DECIMAL(15,2); NULL if it
    does not parse.  ``decimal_mark`` ('.' or ',') fixes the convention;
    without it ambiguous amounts are NULL."""
    return amount_of(bare_amount(raw), decimal_mark)


def amount_of(s: Column, decimal_mark: str | None = None) -> Column:
    """``parse_amount`` of an amount without spaces."""
    point = F.regexp_replace(s, ",", "")
    comma = F.regexp_replace(F.regexp_replace(s, r"\.", ""), ",", ".")
    is_point = s.rlike(r"^(\d+|\d{1,3}(,\d{3})+)(\.\d+)?$")
    is_comma = s.rlike(r"^(\d+|\d{1,3}(\.\d{3})+)(,\d+)?$")
    if decimal_mark == ".":
        return F.when(is_point, point).try_cast(SALARY)
    if decimal_mark == ",":
        return F.when(is_comma, comma).try_cast(SALARY)
    return F.when(~is_ambiguous(s), F.when(is_point, point).when(is_comma, comma)).try_cast(SALARY)


def key_of(*cols: Column) -> Column:
    return F.xxhash64(*[F.coalesce(c, F.lit("\u0000")) for c in cols])


@dataclass
class IngestResult:
    star: Star
    rejects: DataFrame      # filename, line, status
    audit: DataFrame        # status, row_count
    collisions: DataFrame   # table, colliding_keys (expected 0)


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` and more columns, each computed once a row: filters on them are
    not pushed below, where they would compute them again."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parsed_lines(lines: DataFrame, decimal_mark: str | None = None) -> DataFrame:
    """(filename, line, kind, company_name, activity_description, city,
    full_name, salary_amount, ambiguous) of every line, written once under
    the shared checkpoint folder: all tables are made from it, and neither
    the lines nor the patterns are evaluated again for each."""
    line = F.col("line")
    # the cheap tests first; an employee line is a line of one semicolon
    is_header = line.contains("EMPLOYER") & line.rlike(HEADER_RE)
    is_employee = F.length(line) - F.length(F.replace(line, F.lit(";"), F.lit(""))) == 1
    rows = with_once(lines.select("filename", "line"), kind=F.when(F.trim(F.coalesce(line, F.lit(""))) == "", F.lit("blank"))
                     .when(is_header, F.lit("header")).when(is_employee, F.lit("employee")).otherwise(F.lit("unparsed")))
    header, employee = F.col("kind") == "header", F.col("kind") == "employee"
    part = {n: F.when(header, F.regexp_extract("line", HEADER_RE, i)) for i, n in enumerate(("company_name", "activity_description", "city"), 1)}
    rows = with_once(rows, **{n: clean_text(c) for n, c in part.items()},
                     _name=F.when(employee, F.substring_index("line", ";", 1)),
                     _bare=F.when(employee, bare_amount(F.regexp_extract("line", EMPLOYEE_RE, 2))))
    rows = with_once(rows, full_name=clean_text(F.col("_name")), salary_amount=amount_of(F.col("_bare"), decimal_mark),
                     ambiguous=is_ambiguous(F.col("_bare"))).drop("_name", "_bare")
    spark = lines.sparkSession
    path = scratch_path(spark, "parsed")
    rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def parse_declarations(lines: DataFrame, decimal_mark: str | None = None) -> IngestResult:
    """``lines``: (filename, line).  Returns the typed star, rejects, audit."""
    classified = parsed_lines(lines, decimal_mark)
    headers = classified.where(F.col("kind") == "header").select("filename", "line", "company_name", "activity_description", "city")
    usable = headers.where(F.col("company_name").isNotNull())
    # a file must carry exactly one usable header
    per_file = (usable.groupBy("filename")
                .agg(F.count(F.lit(1)).alias("_nh"), F.min("company_name").alias("company_name"),
                     F.min("activity_description").alias("activity_description"),
                     F.min("city").alias("city")))
    good_files = per_file.where(F.col("_nh") == 1).drop("_nh")
    several = per_file.where(F.col("_nh") > 1).select("filename")

    emp = (classified.where(F.col("kind") == "employee")
           .select("filename", "line", "full_name", "salary_amount", F.col("ambiguous").alias("_ambiguous")))
    unread = F.col("salary_amount").isNull() | F.col("full_name").isNull()
    # duplicates: identical (document, employee, amount) lines beyond the first
    copies = (emp.where(~unread).groupBy("filename", "full_name", "salary_amount")
              .agg(F.count(F.lit(1)).alias("_copies")))
    dedup = copies.join(good_files, "filename")

    company_id = key_of(F.col("company_name"), F.col("activity_description"), F.col("city"))
    records = dedup.select(
        key_of(F.col("filename"), F.col("full_name"), F.col("salary_amount").cast("string")).alias("record_id"),
        key_of(F.col("full_name")).alias("employee_id"),
        company_id.alias("company_id"),
        key_of(F.col("filename")).alias("document_id"),
        "salary_amount")
    companies = (good_files.select("company_name", "activity_description", "city").distinct()
                 .select(company_id.alias("company_id"), "company_name", "activity_description", "city"))
    employees = dedup.select("full_name").distinct().select(key_of(F.col("full_name")).alias("employee_id"), "full_name")
    people = copies.groupBy("filename", "full_name").agg(F.sum("salary_amount").alias("_pay"))
    mass = people.groupBy("filename").agg(F.count(F.lit(1)).cast("int").alias("employee_count"),
                                          F.sum("_pay").cast(SALARY).alias("total_salary_mass"))
    documents = (good_files.join(mass, "filename", "left")
                 .select(key_of(F.col("filename")).alias("document_id"), "filename", company_id.alias("company_id"),
                         F.coalesce("employee_count", F.lit(0)).alias("employee_count"),
                         F.coalesce("total_salary_mass", F.lit(0).cast(SALARY)).alias("total_salary_mass")))

    homeless = emp.join(good_files.select("filename"), "filename", "left_anti")
    housed = emp.where(unread).join(good_files.select("filename"), "filename", "left_semi")
    rejects = (classified.where(F.col("kind") == "unparsed").select("filename", "line", F.lit("unparsed").alias("status"))
               .unionByName(headers.where(F.col("company_name").isNull()).select("filename", "line", F.lit("bad_header").alias("status")))
               .unionByName(usable.join(several, "filename", "left_semi").select("filename", "line", F.lit("extra_header").alias("status")))
               .unionByName(homeless.select("filename", "line", F.lit("missing_header").alias("status")))
               .unionByName(housed.select("filename", "line", F.when(F.col("_ambiguous") & F.lit(decimal_mark is None),
                                                                     F.lit("ambiguous_amount")).otherwise(F.lit("bad_amount")).alias("status"))))
    blank = (classified.where(F.col("kind") == "blank").groupBy(F.col("kind").alias("status"))
             .agg(F.count(F.lit(1)).alias("row_count")))
    rejected = rejects.groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))
    used = good_files.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("header").alias("status"), "row_count").where("row_count > 0")
    loaded = dedup.agg(F.count(F.lit(1)).alias("loaded"), F.sum(F.col("_copies") - 1).alias("duplicate"))
    loaded = loaded.selectExpr("stack(2, 'loaded', loaded, 'duplicate', coalesce(duplicate, 0)) AS (status, row_count)")
    audit = blank.unionByName(rejected).unionByName(used).unionByName(loaded)

    star = Star(companies, documents, employees, records)
    return IngestResult(star, rejects, audit, key_collisions(star))


#: The id of each table.
IDS = {"companies": "company_id", "employees": "employee_id", "documents": "document_id", "salary_records": "record_id"}


def key_collisions(star: Star) -> DataFrame:
    """(table, colliding_keys): ids that several rows share.  Rows are
    distinct by natural key, so a shared id is a hash collision."""
    out = None
    for name, df in star.tables().items():
        shared = df.groupBy(IDS[name]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
        one = shared.agg(F.count(F.lit(1)).alias("colliding_keys")).select(F.lit(name).alias("table"), "colliding_keys")
        out = one if out is None else out.unionByName(one)
    return out


# A period in a file name: a year and a month.
PERIOD_RE = r"(?<!\d)((?:19|20)\d{2})[-_. ](0[1-9]|1[0-2])(?!\d)"


def period_of(filename: Column) -> Column:
    """The period that a declaration is for: year and month from its file
    name, else the name itself without folders and extension, so that a file
    filed again under its old name (in whatever folder) replaces it."""
    name = F.regexp_replace(filename, r"^.*/", "")
    year, month = (F.regexp_extract(name, PERIOD_RE, g) for g in (1, 2))
    return F.when(year != "", F.concat_ws("-", year, month)).otherwise(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""))


def filings(documents: DataFrame, batch: int, filed: DataFrame | None = None) -> DataFrame:
    """One row a declaration of a batch: (document_id, company_id, period,
    batch, filed_at, filename).  ``filed``: (filename, filed_at) where the
    files carry a time."""
    rows = documents.select("document_id", "company_id", period_of(F.col("filename")).alias("period"), F.lit(batch).cast("long").alias("batch"), "filename")
    if filed is None:
        return rows.withColumn("filed_at", F.lit(None).cast("timestamp"))
    return rows.join(filed, "filename", "left")


def standing(filed: DataFrame) -> DataFrame:
    """(document_id, stands): of all declarations of one employer for one
    period the last stands, by batch, then time of filing, then file name;
    the others are superseded.  A group of declarations is reduced by a
    mergeable maximum, whatever its size."""
    order = F.struct("batch", "filed_at", "filename", "document_id").alias("o")
    last = filed.groupBy("company_id", "period").agg(F.max(order).alias("o"))
    return (filed.join(last.select("company_id", "period", F.col("o.document_id").alias("_last")), ["company_id", "period"])
            .select("document_id", (F.col("document_id") == F.col("_last")).alias("stands")))


def standing_star(star: Star, filed: DataFrame) -> Star:
    """The star without superseded declarations and their records; people and
    employers of whom nothing else is left go too."""
    keep = standing(filed).where("stands").select("document_id")
    documents = star.documents.join(keep, "document_id", "left_semi")
    records = star.salary_records.join(keep, "document_id", "left_semi")
    return Star(star.companies.join(documents, "company_id", "left_semi"), documents,
                star.employees.join(records, "employee_id", "left_semi"), records)


def standing_audit(audit: DataFrame, records: DataFrame, filed: DataFrame) -> DataFrame:
    """(status, row_count) over all batches: loaded lines of superseded
    declarations count as superseded."""
    gone = records.join(standing(filed).where("NOT stands"), "document_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    moved = gone.selectExpr("stack(2, 'loaded', -n, 'superseded', n) AS (status, row_count)")
    total = audit.select("status", "row_count").unionByName(moved).groupBy("status").agg(F.sum("row_count").alias("row_count"))
    return total.where(F.col("row_count") != 0)


def check_collisions(collisions: DataFrame) -> None:
    """Fail instead of loading rows under a shared id."""
    bad = collisions.where(F.col("colliding_keys") > 0).collect()   # at most one row per table
    if bad:
        raise ValueError("hash ids collide: " + ", ".join(f"{r['table']} {r['colliding_keys']}" for r in bad))


def render_declarations(star: Star) -> DataFrame:
    """Declaration lines in the ingest format, rendered by Spark from a
    star (one header per document, one line per salary record; amounts as
    '12,345.67').  Used to run the ingest over the given tables."""
    d = star.documents.select("document_id", "filename", "company_id")
    c = star.companies
    header = (d.join(c, "company_id", "inner")
              .select("filename", F.concat(F.lit("EMPLOYER: "), F.col("company_name"),
                                           F.lit(" ; ACTIVITY: "), F.coalesce(F.col("activity_description"), F.lit("")),
                                           F.lit(" ; CITY: "), F.coalesce(F.col("city"), F.lit(""))).alias("line")))
    sr = star.records("employee_id", "document_id", "salary_amount")
    e = star.employees
    body = (sr.join(e, "employee_id", "inner").join(d.select("document_id", "filename"), "document_id", "inner")
            .select("filename", F.concat(F.col("full_name"), F.lit(" ; "),
                                         F.format_number(F.col("salary_amount"), 2)).alias("line")))
    return header.unionByName(body)
