"""Labelled range buckets as one CASE expression plus an ordinal.

The ordinal is the sort key (the reference re-parses labels with a second
CASE).  A NULL value falls through to the ELSE label, as in SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference bucket definitions).
# Dashboard salary ranges: upper bounds (exclusive) and labels, in order.
DASHBOARD_SALARY_EDGES = [5000, 10000, 15000, 20000, 30000, 50000, 100000,
                          200000, 500000, 1000000]
DASHBOARD_SALARY_LABELS = ["< 5K", "5K-10K", "10K-15K", "15K-20K", "20K-30K",
                           "30K-50K", "50K-100K", "100K-200K", "200K-500K",
                           "500K-1M", "1M+"]
# Report salary ranges.
REPORT_SALARY_EDGES = [3000, 5000, 8000, 10000, 15000, 20000, 30000, 50000,
                       100000, 200000, 500000, 1000000]
REPORT_SALARY_LABELS = ["< 3K", "3K-5K", "5K-8K", "8K-10K", "10K-15K",
                        "15K-20K", "20K-30K", "30K-50K", "50K-100K",
                        "100K-200K", "200K-500K", "500K-1M", "1M+"]
# Company size ranges (inclusive bounds); anything else is the last label.
COMPANY_SIZE_RANGES = [(1, 1), (2, 5), (6, 10), (11, 20), (21, 50),
                       (51, 100), (101, 200), (201, 500), (501, 1000)]
COMPANY_SIZE_LABELS = ["1 employee", "2-5 employees", "6-10 employees",
                       "11-20 employees", "21-50 employees", "51-100 employees",
                       "101-200 employees", "201-500 employees",
                       "501-1000 employees", "1000+ employees"]


@dataclass(frozen=True)
class BucketSpec:
    labels: tuple[str, ...]
    # one predicate per label except the last (ELSE)
    conditions: tuple

    def ordinal(self, c: str | Column) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        expr = None
        for i, cond in enumerate(self.conditions, start=1):
            expr = F.when(cond(c), F.lit(i)) if expr is None else expr.when(cond(c), F.lit(i))
        return expr.otherwise(F.lit(len(self.labels)))

    def label(self, c: str | Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in self.labels]), self.ordinal(c))


def upper_bounds(edges, labels) -> BucketSpec:
    return BucketSpec(tuple(labels), tuple((lambda e: (lambda c: c < F.lit(e)))(e) for e in edges))


def closed_ranges(ranges, labels) -> BucketSpec:
    return BucketSpec(tuple(labels),
                      tuple((lambda lo, hi: (lambda c: c.between(lo, hi)))(lo, hi) for lo, hi in ranges))


DASHBOARD_SALARY = upper_bounds(DASHBOARD_SALARY_EDGES, DASHBOARD_SALARY_LABELS)
REPORT_SALARY = upper_bounds(REPORT_SALARY_EDGES, REPORT_SALARY_LABELS)
COMPANY_SIZE = closed_ranges(COMPANY_SIZE_RANGES, COMPANY_SIZE_LABELS)
