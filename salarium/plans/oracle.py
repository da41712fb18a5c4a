"""Oracle SQL helpers: the adapter as CTEs, plus the numeric conventions of
``salarium.functions.numeric`` written in DuckDB SQL.

Every oracle statement starts with ``PRELUDE`` so it reads the reference's
four tables (companies, documents, employees, salary_records) built from
the driver's TPC-H-like views exactly as ``load_tpch_star`` builds them.
"""

from __future__ import annotations

PRELUDE = """WITH companies AS (
  SELECT c.c_custkey AS company_id, c.c_name AS company_name,
         c.c_mktsegment AS activity_description, n.n_name AS city
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
), employees AS (
  SELECT p_partkey AS employee_id, p_name AS full_name FROM part
), documents AS (
  SELECT o_orderkey AS document_id, 'DOC_' || CAST(o_orderkey AS VARCHAR) AS filename,
         o_custkey AS company_id, CAST(NULL AS INTEGER) AS employee_count,
         CAST(NULL AS DECIMAL(15,2)) AS total_salary_mass
  FROM orders
), salary_records AS (
  SELECT l.l_partkey AS employee_id, o.o_custkey AS company_id, l.l_orderkey AS document_id,
         CAST(l.l_extendedprice AS DECIMAL(15,2)) AS salary_amount
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""


def sql(body: str, ctes: str = "") -> str:
    """PRELUDE + optional extra CTEs (each starting with a comma) + body."""
    return f"{PRELUDE}{ctes}\n{body}"


def avg_d(x: str) -> str:
    """double(exact sum) / count."""
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def avg_round2(x: str) -> str:
    """ROUND(AVG(x), 2), HALF_UP on the exact quotient (x >= 0)."""
    return (f"(CAST((2 * CAST(SUM({x}) * 100 AS HUGEINT) + COUNT({x})) // NULLIF(2 * COUNT({x}), 0)"
            f" AS DOUBLE) / 100)")


def q(x: str, p: float, digits: int = 6) -> str:
    return f"ROUND(quantile_cont(CAST({x} AS DOUBLE), {p}), {digits})"


def std(x: str) -> str:
    return f"ROUND(stddev_samp(CAST({x} AS DOUBLE)), 4)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def case_ordinal(x: str, edges) -> str:
    """1-based range ordinal for 'x < e1, x < e2, ..., else' buckets."""
    parts = " ".join(f"WHEN {x} < {e} THEN {i}" for i, e in enumerate(edges, start=1))
    return f"CASE {parts} ELSE {len(edges) + 1} END"


def label_of(ordinal: str, labels) -> str:
    arr = ", ".join("'" + x.replace("'", "''") + "'" for x in labels)
    return f"([{arr}])[{ordinal}]"


def like_ci(col: str, term: str) -> str:
    t = term.replace("'", "''")
    return f"LOWER({col}) LIKE LOWER('%{t}%')"


# Literals of the oracle, on purpose not those of the package: a wrong edge
# or label there shows up as a mismatch.
DASHBOARD_EDGES = (5000, 10000, 15000, 20000, 30000, 50000, 100000, 200000, 500000, 1000000)
DASHBOARD_NAMES = ("< 5K", "5K-10K", "10K-15K", "15K-20K", "20K-30K", "30K-50K", "50K-100K", "100K-200K", "200K-500K", "500K-1M", "1M+")
REPORT_EDGES = (3000, 5000, 8000, 10000, 15000, 20000, 30000, 50000, 100000, 200000, 500000, 1000000)
REPORT_NAMES = ("< 3K", "3K-5K", "5K-8K", "8K-10K", "10K-15K", "15K-20K", "20K-30K", "30K-50K", "50K-100K", "100K-200K",
                "200K-500K", "500K-1M", "1M+")
SIZE_RANGES = ((1, 1), (2, 5), (6, 10), (11, 20), (21, 50), (51, 100), (101, 200), (201, 500), (501, 1000))
SIZE_NAMES = ("1 employee", "2-5 employees", "6-10 employees", "11-20 employees", "21-50 employees", "51-100 employees",
              "101-200 employees", "201-500 employees", "501-1000 employees", "1000+ employees")


def digest(digits: int, *parts: str) -> str:
    """The first hex digits of the MD5 of parts joined by '|' as a BIGINT."""
    joined = " || '|' || ".join(parts)
    return f"('0x' || substr(md5({joined}), 1, {digits}))::BIGINT"


def draw(tag: str, *keys: str, seed: int = 42) -> str:
    """Uniform [0, 1) draw of the generators."""
    return f"({digest(13, f"'{seed}'", f"'{tag}'", *(f'{k}::VARCHAR' for k in keys))} / 4503599627370496.0::DOUBLE)"
