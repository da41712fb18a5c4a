"""Numeric conventions shared by every operator.

Salaries are DECIMAL(15,2) as in the reference DDL, so sums are exact.
Results leave the engine as DOUBLE:

* sums:    exact decimal sum, then one cast to double;
* means:   double(exact sum) / count -- a single correctly rounded IEEE
           division, so any engine that sums exactly gets the same bits;
* ROUND(avg, 2) where the reference rounds: decimal division + HALF_UP;
* order statistics, deviations and indexes: ``round(x, digits)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERCENTILE_DIGITS = 6   # exact percentiles of cent values have <= 5 decimals
SPREAD_DIGITS = 4       # stddev and ratios of irrational values
INDEX_DIGITS = 8        # Gini / Hoover / Atkinson / correlation


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def mean_d(c: str | Column) -> Column:
    """double(exact sum) / count of non-null values; NULL on an empty group."""
    return F.try_divide(F.sum(col(c)).cast("double"), F.count(col(c)))


def mean_round2(c: str | Column) -> Column:
    """ROUND(AVG(decimal), 2) with HALF_UP on the (nearly) exact quotient."""
    return F.round(F.try_divide(F.sum(col(c)), F.count(col(c))), 2).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den; NULL instead of an ANSI error when den is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def rnd(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)
