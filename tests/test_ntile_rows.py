"""A tile for every record: equal salaries that the edges cut."""

from collections import Counter
from decimal import Decimal as D

from salarium.plans import report
from salarium.sources.star import star_from_rows


def test_tiles_of_ties(spark):
    pay = [D("5.00")] * 40 + [D("7.00")] * 3 + [D("9.00")] * 30 + [D("0.50")] * 4 + [D("11.00")]
    records = [(i, i % 11, 1, i % 7, p) for i, p in enumerate(pay)] + [(99, None, 1, None, D("9.00")), (100, 3, 1, 3, None)]
    star = star_from_rows(spark, [(1, "A", "x", "y")], [(i, f"d{i}", 1, None, None) for i in range(7)], [(i, "n") for i in range(11)], records)
    rows = report.salary_ntile_rows(star).collect()
    assert len(rows) == 75  # salaries from 1 on
    sizes = Counter(r.decile for r in rows)
    assert [sizes[t] for t in range(1, 11)] == [8] * 5 + [7] * 5
    ordered = sorted((r.decile, r.salary_amount) for r in rows)
    assert [s for _, s in ordered] == sorted(r.salary_amount for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, report.salary_ntile_rows(star).collect()), key=repr)


def test_fewer_records_than_tiles(spark):
    star = star_from_rows(spark, [(1, "A", "x", "y")], [(1, "d", 1, None, None)], [(1, "n")], [(i, 1, 1, 1, D("5.00")) for i in range(3)])
    assert sorted(r.decile for r in report.salary_ntile_rows(star).collect()) == [1, 2, 3]
