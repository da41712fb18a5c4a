"""Cohort predicates: the search / dashboard filter language.

A :class:`Criteria` holds the form fields; ``cohort_predicate`` turns the
supplied ones into one Catalyst conjunction.  Blank text = no predicate;
the salary range is always applied (so NULL salaries never pass).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference API defaults): salary range 0 .. 1e9, limit 100.
DEFAULT_MIN_SALARY = Decimal(0)
DEFAULT_MAX_SALARY = Decimal(1_000_000_000)
DEFAULT_LIMIT = 100


def _num(v, default: Decimal) -> Decimal:
    """Form values arrive as strings; blank means the default."""
    if v is None or (isinstance(v, str) and not v.strip()):
        return default
    return Decimal(str(v))


@dataclass(frozen=True)
class Criteria:
    company_name: str = ""
    employee_name: str = ""
    city: str = ""
    activity: str = ""
    min_salary: object = DEFAULT_MIN_SALARY
    max_salary: object = DEFAULT_MAX_SALARY
    limit: int = DEFAULT_LIMIT

    @property
    def salary_range(self) -> tuple[Decimal, Decimal]:
        return (_num(self.min_salary, DEFAULT_MIN_SALARY),
                _num(self.max_salary, DEFAULT_MAX_SALARY))


def like_pattern(term: str) -> str:
    """Normalise a user term into a Spark LIKE pattern with the reference's
    meaning: ``%`` and ``_`` stay wildcards, a backslash escapes the next
    character and a backslash before an ordinary character is just that
    character (Spark would raise there)."""
    out, i = [], 0
    while i < len(term):
        ch = term[i]
        if ch == "\\":
            nxt = term[i + 1] if i + 1 < len(term) else None
            if nxt in ("%", "_", "\\"):
                out.append("\\" + nxt)
                i += 2
                continue
            if nxt is None:
                out.append("\\\\")
                i += 1
                continue
            i += 1
            continue
        out.append(ch)
        i += 1
    return "%" + "".join(out) + "%"


def contains_ci(c: str | Column, term: str, literal: bool = False) -> Column:
    """LOWER(c) LIKE LOWER('%term%').  ``literal=True`` treats the term as
    plain text (no wildcards)."""
    c = F.col(c) if isinstance(c, str) else c
    if literal:
        return F.contains(F.lower(c), F.lower(F.lit(term)))
    return F.like(F.lower(c), F.lower(F.lit(like_pattern(term))))


def salary_between(c: str | Column, lo, hi) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.between(F.lit(Decimal(str(lo))), F.lit(Decimal(str(hi))))


def all_of(preds: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def cohort_predicate(cr: Criteria, *, company_name="company_name", full_name="full_name",
                     city="city", activity="activity_description",
                     salary="salary_amount", literal: bool = False) -> Column:
    """Conjunction of the supplied criteria over star-detail columns."""
    preds = []
    for term, column in ((cr.company_name, company_name), (cr.employee_name, full_name),
                         (cr.city, city), (cr.activity, activity)):
        if term:
            preds.append(contains_ci(column, term, literal))
    lo, hi = cr.salary_range
    preds.append(salary_between(salary, lo, hi))
    return all_of(preds)


def company_predicate(cr: Criteria, literal: bool = False) -> Column:
    """The criteria on the company dimension."""
    terms = ((cr.company_name, "company_name"), (cr.city, "city"), (cr.activity, "activity_description"))
    return all_of([contains_ci(c, t, literal) for t, c in terms if t])


def employee_predicate(cr: Criteria, literal: bool = False) -> Column:
    """The criteria on the employee dimension."""
    return all_of([contains_ci("full_name", cr.employee_name, literal)] if cr.employee_name else [])


def name_or_activity_ilike(name_term: str, activity_term: str) -> Column:
    """company_name ILIKE '%a%' OR activity_description ILIKE '%b%'."""
    return (F.col("company_name").ilike(like_pattern(name_term))
            | F.col("activity_description").ilike(like_pattern(activity_term)))
