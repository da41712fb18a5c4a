"""Grouped salary statistics.

``salary_stats`` is the one builder behind the view, dashboard and report
statistics: distinct counts, exact mean, sample stddev, min/max and exact
PERCENTILE_CONT.  Rows are reduced before the keys are joined, and values are
ranked by bucket (never a per-group in-memory value list, so a group holding
a third of all rows is spread over many tasks).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salarium.functions.numeric import PERCENTILE_DIGITS, SPREAD_DIGITS, rnd
from salarium.operators.ranks import from_edge, quantile_exprs, quantile_value, value_bucket

MEDIAN = {"median_salary": 0.5}
QUARTILES = {"median_salary": 0.5, "p25_salary": 0.25, "p75_salary": 0.75}


#: A group's values are dealt to VALUE_CELLS cells, the records of one value
#: to TIE_CELLS of them, so neither a large group nor a hot value is one task's.
VALUE_CELLS, TIE_CELLS = 64, 8

#: Up to so many groups, the value buckets that hold their percentiles are
#: sent to all tasks (two for each percentile and group).
FEW_GROUPS = 10_000


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` to ``parts`` tasks (``Star.parts``), if given.
    Shuffles that Spark plans itself are merged up to the advisory size, some
    millions of such short rows in one task's hash map; these are not."""
    return df if parts is None else df.repartition(parts, *keys)


def reduced(df: DataFrame, value: str = "salary_amount", parts: int | None = None) -> DataFrame:
    """Records by company, employee and value with their number: all that
    grouped statistics need of them.  ``f`` counts non-null values."""
    rows = dealt(df, parts, "company_id", "employee_id", value)
    return rows.groupBy("company_id", "employee_id", F.col(value).alias("v")).agg(F.count(value).alias("f"))


def reduced_by_company(df: DataFrame, value: str = "salary_amount", parts: int | None = None) -> DataFrame:
    """``reduced`` records for several statistics at once: dealt by company
    and ``_lot``, one of TIE_CELLS lots of its employees, so that neither
    figures of companies nor joins with them move the records again, and a
    large company is not one task's.  An employee of a company is in one lot;
    records without an employee go by their value."""
    lot = F.xxhash64("employee_id", F.when(F.col("employee_id").isNull(), F.col(value))).bitwiseAND(TIE_CELLS - 1)
    rows = dealt(df.withColumn("_lot", lot), parts, "company_id", "_lot")
    return rows.groupBy("company_id", "_lot", "employee_id", F.col(value).alias("v")).agg(F.count(value).alias("f"))


def salary_stats(rows: DataFrame, dim: DataFrame, keys, **figures) -> DataFrame:
    """Statistics of ``reduced`` rows by the ``keys`` of their company; the
    options are those of ``stats_of_groups``."""
    return stats_of_groups(rows, rows, dim, keys, **figures)


def stats_of_groups(values: DataFrame, people: DataFrame, dim: DataFrame, keys, *, company_count: bool = False, employee_count: bool = True,
                 avg_name: str = "average_salary", percentiles: dict | None = None,
                 stddev: bool = False, max_name: str | None = "max_salary",
                 min_name: str | None = None, min_employees: int | None = None, parts: int | None = None) -> DataFrame:
    """Statistics by the ``keys`` of a company, which ``dim`` holds by
    company_id (companies that it lacks drop out): of ``values`` (company_id,
    v, f) and ``people`` (company_id, employee_id, f), f a number of records,
    in ``parts`` tasks (see ``dealt``).  Both may be one frame that is
    ``reduced_by_company``.

    The records are aggregated before anything is joined.  Then only numbers
    travel: companies of equal keys share one group number, the smallest of
    their ids, and the keys themselves come back with the finished groups."""
    keys = list(keys)
    groups = dim.groupBy(*keys).agg(F.min("company_id").alias("g"))
    same = functools.reduce(lambda a, b: a & b, [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys])
    member = dim.alias("d").join(groups.alias("k"), same).select("d.company_id", "k.g")
    lots = "_lot" in people.columns
    if lots:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TIE_CELLS - 1).cast("long"))).alias("_lot")
        joined = people.where(F.col("f") >= 0).join(dealt(member.select("company_id", "g", every), parts, "company_id", "_lot"), ["company_id", "_lot"])
    few = lots and groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    # Where values and people are one frame, all branches read its shuffle, so
    # all must use its weight, and null values go by their weight: a filter on
    # a grouping column would be pushed below the aggregate in one branch, and
    # the records would be read and shuffled twice.
    priced = joined if lots else values.where(F.col("f") >= 0).join(member, "company_id")
    weight = F.col("f") if values is people else F.when(F.col("v").isNotNull(), F.col("f")).otherwise(0)
    if few:
        hist = priced.select("g", "v", weight.alias("f")).where("f > 0")
    else:
        tie = F.col("employee_id" if "employee_id" in values.columns else "company_id")
        cell = F.pmod(F.xxhash64("v"), F.lit(VALUE_CELLS)) * TIE_CELLS + F.pmod(F.xxhash64(tie), F.lit(TIE_CELLS))
        pay = dealt(priced.select("g", "v", weight.alias("f"), (F.lit(0) if parts is None else cell).alias("_cell")), parts, "g", "_cell")
        hist = pay.groupBy("g", "_cell", "v", value_bucket(pay).alias("_bucket")).agg(F.sum("f").alias("f")).where("f > 0")
    # a row of a company has no employee and the other way round, so one count
    # of each column gives both
    none = F.lit(None).cast("long")
    if lots:
        # a group without an employee is known by its companies
        who = joined.select("g", F.when(F.col("f") >= 0, F.col("employee_id")).alias("employee_id")).where(F.col("employee_id").isNotNull())
        seen = dealt(who, parts, "g", "employee_id").distinct().select("g", "employee_id", none.alias("company_id"))
    else:
        rows = people.where(F.col("f") >= 0).join(member, "company_id")
        # records without an employee count for none, so they may stay apart
        who = dealt(rows.select("g", "employee_id", F.coalesce("employee_id", "company_id").alias("_who"), "f"), parts, "g", "_who")
        seen = who.groupBy("g", "_who", "employee_id").agg(F.sum("f").alias("f")).where(F.col("f") >= 0).select("g", "employee_id", none.alias("company_id"))
    if company_count or lots:
        # companies are few beside records, so theirs are counted before the join
        known = people.groupBy("company_id", "_lot").agg(F.sum("f").alias("f")) if lots else people
        present = known.groupBy("company_id").agg(F.sum("f").alias("f")).where(F.col("f") >= 0).join(member, "company_id")
        companies = present.groupBy("g", "company_id").agg(F.sum("f").alias("f")).where(F.col("f") >= 0)
        seen = seen.unionByName(companies.select("g", none.alias("employee_id"), "company_id"))
    heads = seen.groupBy("g").agg(F.count("company_id").alias("company_count"), F.count("employee_id").alias("employee_count"))
    if min_employees is not None:
        heads = heads.where(F.col("employee_count") >= min_employees)
    if percentiles or stddev:
        st = group_figures(hist, percentiles or {}, parts, few)
    else:
        st = hist.groupBy("g").agg(F.sum("f").alias("_n"), F.sum(F.col("v") * F.col("f")).alias("_s1"), F.min("v").alias("_min"), F.max("v").alias("_max"))
    n = F.col("_n")
    cols = [F.try_divide(F.col("_s1").cast("double"), n).alias(avg_name)]
    if stddev:
        cols.append(rnd(stddev_samp_of(n, F.col("_d2")), SPREAD_DIGITS).alias("stddev_salary"))
    if max_name:
        cols.append(F.col("_max").cast("double").alias(max_name))
    if min_name:
        cols.append(F.col("_min").cast("double").alias(min_name))
    cols += [rnd(quantile_value(p), PERCENTILE_DIGITS).alias(p) for p in percentiles or {}]
    counts = (["company_count"] if company_count else []) + (["employee_count"] if employee_count else [])
    # a group without a single salary has people but no figures
    return heads.join(st, "g", "left").join(groups, "g").select(*keys, *counts, *cols)


def group_figures(hist: DataFrame, percentiles: dict[str, float], parts: int | None = None, few: bool = False) -> DataFrame:
    """Figures of each group from its histogram (g, v, f, and the bucket if it
    is known; a value may have several rows): g, _n, _s1, _d2,
    _min, _max and the columns of ``quantile_exprs``.

    Totals by group and value bucket (a bounded number for each group) give
    the moments, and tell which buckets hold the wanted ranks.  Only the
    values of those few buckets are ranked; the rest of the histogram is
    neither shuffled again nor sorted.  Of ``few`` groups (FEW_GROUPS), rows
    need not be added up before: those buckets go to all tasks, and only
    their rows are added up by value and leave the tasks."""
    off, edge, step = from_edge(hist)
    hb = hist if "_bucket" in hist.columns else hist.withColumn("_bucket", value_bucket(hist))
    sums = ["sum(f) AS _bf", "min(v) AS _bmin", "max(v) AS _bmax", "sum(cast(_off AS double) * _off * f) AS _bq"]
    if step is None:
        sums += ["sum(_off * f) AS _bd", "sum(v * f) AS _bs"]
        within, total = "_bq - _bd * _bd / _bf", "_bs"
    else:
        # distances in whole steps: they and their squares add up exactly in
        # high and low halves, longs; the few beyond 31 bits as decimals (the
        # squares of a bucket with such ones, as doubles)
        small = "abs(_off) < 2147483648L AND f < 2147483648L"
        sums += [f"sum(if({small}, shiftright(_off * f, 20), 0L)) AS _d1", f"sum(if({small}, (_off * f) & 1048575L, 0L)) AS _d0",
                 f"sum(if({small}, null, cast(_off AS decimal(19,0)) * f)) AS _dx", f"bool_and({small}) AS _small",
                 f"try_sum(if({small}, shiftright(_off * _off, 32) * f, 0L)) AS _hi", f"try_sum(if({small}, (_off * _off & 4294967295L) * f, 0L)) AS _lo"]
        moved = "(cast(_d1 AS decimal(20,0)) * 1048576 + _d0 + coalesce(_dx, 0))"
        square = "try_add(try_multiply(cast(_hi AS decimal(38,0)), cast(4294967296L AS decimal(20,0))), cast(_lo AS decimal(38,0)))"
        exact = f"cast(try_subtract(try_multiply(cast(_bf AS decimal(38,0)), {square}), try_multiply(cast(_bd AS decimal(38,0)), cast(_bd AS decimal(38,0)))) AS double) / _bf"
        within = f"coalesce(if(_small, {exact}, null), _bq - cast(_bd AS double) * cast(_bd AS double) / _bf)"
        total = f"cast((cast(_bf AS decimal(38,0)) * {edge} + _bd) / {int(step)} AS decimal(38,{len(str(int(step))) - 1}))"
    tot = hb.withColumn("_off", F.expr(off)).groupBy("g", "_bucket").agg(*map(F.expr, sums))
    if step is not None:
        tot = tot.selectExpr("*", f"{moved} AS _bd")
    tot = tot.selectExpr("*", f"{total} AS _s", f"greatest({within}, 0D) AS _w").selectExpr(
        "*", "sum(_bf) OVER (PARTITION BY g ORDER BY _bucket) - _bf AS _off", "sum(_bf) OVER (PARTITION BY g) AS n", "sum(_s) OVER (PARTITION BY g) AS total")
    # squared deviations: those inside a bucket, and those of the buckets' means
    unit = f"{step or 1.0!r}D"
    far = f"((cast({edge} AS double) + cast(_bd AS double) / _bf) / {unit} - cast(total AS double) / n)"
    moments = ["max(n) AS _n", "max(total) AS _s1", f"sum(_w / {unit} / {unit} + _bf * {far} * {far}) AS _d2", "min(_bmin) AS _min", "max(_bmax) AS _max"]
    if not percentiles:
        return tot.groupBy("g").agg(*map(F.expr, moments))
    ranks = [f"(cast(n - 1 AS double) * {float(p)!r}D)" for p in percentiles.values()]
    holds = " OR ".join(f"(floor({k}) < _off + _bf AND ceil({k}) >= _off)" for k in ranks)
    # at most two buckets for each percentile hold wanted ranks
    cells = f"collect_list(if({holds}, named_struct('_bucket', _bucket, '_off', _off), null)) AS cells"
    groups = tot.groupBy("g").agg(*map(F.expr, [*moments, cells])).selectExpr("*", "explode(cells) AS cell").drop("cells")
    carried = ["_n", "_s1", "_d2", "_min", "_max"]
    wanted = groups.select("g", F.col("cell._bucket").alias("_bucket"), F.col("cell._off").alias("_off"), *carried)
    if few:
        held = hb.join(F.broadcast(wanted), ["g", "_bucket"])
        found = held.groupBy("g", "_bucket", "v", "_off", *carried).agg(F.sum("f").alias("f"))
        return ranked_figures(found, carried, percentiles)
    # both sides, so that neither is merged
    values, wanted = (dealt(df, parts, "g", "_bucket") for df in (hb.select("g", "_bucket", "v", "f"), wanted))
    return ranked_figures(values.join(wanted, ["g", "_bucket"]), carried, percentiles)


def ranked_figures(found: DataFrame, carried: list[str], percentiles: dict[str, float]) -> DataFrame:
    """Percentiles of each group from the values (v, f) of the buckets that
    hold them, each with its bucket's rank and the group's figures."""
    ranked = found.selectExpr(
        "*", "_n AS n", "_off + sum(f) OVER (PARTITION BY g, _bucket ORDER BY v ROWS UNBOUNDED PRECEDING) - f AS pre")
    return ranked.groupBy("g").agg(*[F.max(c).alias(c) for c in carried], *quantile_exprs(percentiles))


def sq_dev(v: Column, f: Column) -> Column:
    """Sum of squared deviations over a rank frame: the mean rides along as
    total / n, so one pass is enough and no square of a sum can overflow."""
    mean = F.col("total").cast("double") / F.col("n").cast("double")
    return F.sum(F.when(v.isNotNull(), F.pow(v.cast("double") - mean, F.lit(2.0)) * f.cast("double")))


def stddev_samp_of(n: Column, d2: Column) -> Column:
    """Sample standard deviation; NULL for n < 2."""
    return F.when(n >= 2, F.sqrt(d2 / (n - 1).cast("double")))


def bucket_counts(df: DataFrame, spec, value: str = "salary_amount",
                  label: str = "salary_range", count: str = "count", weight: Column | None = None) -> DataFrame:
    """Rows per labelled range (or their ``weight``); empty ranges are absent
    (GROUP BY)."""
    return (df.select(spec.ordinal(value).alias("range_order"), *([] if weight is None else [weight.alias("_w")]))
              .groupBy("range_order").agg((F.count(F.lit(1)) if weight is None else F.sum("_w")).alias(count))
              .select(F.element_at(F.array(*[F.lit(x) for x in spec.labels]),
                                   F.col("range_order")).alias(label),
                      F.col("range_order").cast("long").alias("range_order"), count))
