"""Statistical report datasets: grouped statistics, distribution, exact
percentiles, deciles, inequality measures and the 14 chart pages.

The reference fetched the whole fact table into one process and computed
these with numpy; here every dataset is a distributed plan and only the
final (small) page rows are ever materialised by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salarium.functions.buckets import COMPANY_SIZE, REPORT_SALARY
from salarium.functions.labels import magnitude_label, money_axis_label, or_unknown, truncate_label
from salarium.functions.numeric import (INDEX_DIGITS, PERCENTILE_DIGITS, SPREAD_DIGITS, ratio, rnd)
from salarium.operators.aggregates import QUARTILES, bucket_counts, reduced, salary_stats
from salarium.operators.generate import hash_positions
from salarium.operators.inequality import (DEFAULT_EPSILON, atkinson_index, inequality, inequality_aggs,
                                           inequality_cols, running_share)
from salarium.operators.joins import company_fact, company_sizes, salary_fact
from salarium.operators.ranks import lorenz_curve as exact_curve
from salarium.operators.ranks import (frame_from_hist, lorenz_points, ntile, ntile_pieces, quantile_exprs, quantile_value,
                                      rank_frame)
from salarium.sources.star import Star

# Fixed values (reference report parameters).
SALARY_FLOOR = 1
COMPANY_MIN_EMPLOYEES = 10
PAGE_TOP = 15
PAGE_MIN_EMPLOYEES_GEO = 100
PAGE_MIN_EMPLOYEES_COMPANY = 30
ACTIVITY_LABEL = (50, 50)       # longer than 50 chars -> first 50 + '...'
COMPANY_ACTIVITY_LABEL = (40, 37)  # longer than 40 chars -> first 37 + '...'
NATIONAL_PERCENTILES = {"p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50,
                        "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p999": 0.999}
DECILES = 10


def _floor(df: DataFrame, floor=SALARY_FLOOR) -> DataFrame:
    return df.where(F.col("salary_amount") >= F.lit(floor))



def floor_records(star: Star, floor=SALARY_FLOOR) -> DataFrame:
    """salary_records with salary >= floor."""
    return _floor(star.records("employee_id", "document_id", "salary_amount"), floor)


# --------------------------------------------------------------------------
# Grouped statistics
# --------------------------------------------------------------------------

def paid_people(star: Star) -> DataFrame:
    """What the grouped statistics need of the records with salary >= 1."""
    return reduced(_floor(star.records("company_id", "employee_id", "salary_amount")), parts=star.parts())


def _geo_stats(star: Star, key: str) -> DataFrame:
    return salary_stats(paid_people(star), star.companies.where(F.col(key).isNotNull()), [key], company_count=True, avg_name="avg_salary",
                        percentiles=QUARTILES, stddev=True, max_name="max_salary",
                        min_name="min_salary", parts=star.parts())


def report_city_stats(star: Star) -> DataFrame:
    """Per non-null city (salary >= 1): distinct companies and
    employees, mean, median, quartiles, sample stddev, max, min."""
    return _geo_stats(star, "city")


def report_activity_stats(star: Star) -> DataFrame:
    """A10: as A9 per non-null activity."""
    return _geo_stats(star, "activity_description")


def report_company_stats(star: Star, min_employees: int = COMPANY_MIN_EMPLOYEES) -> DataFrame:
    """Per (name, city, activity) with >= min_employees distinct employees."""
    return salary_stats(paid_people(star), star.companies, ["company_name", "city", "activity_description"],
                        avg_name="avg_salary", percentiles=QUARTILES, stddev=True,
                        max_name="max_salary", min_name="min_salary",
                        min_employees=min_employees, parts=star.parts())


def report_salary_buckets(star: Star) -> DataFrame:
    """Rows per report salary range (13 ranges) over salary >= 1."""
    return bucket_counts(floor_records(star), REPORT_SALARY)


# --------------------------------------------------------------------------
# National order statistics (A13, A15, D-ops)
# --------------------------------------------------------------------------

def national_frame(star: Star):
    return rank_frame(floor_records(star).select("salary_amount"), "salary_amount")


def national_percentiles(star: Star, approx_accuracy: int | None = None) -> DataFrame:
    """Exact p01 .. p999 plus mean, min, max, record count and total,
    one aggregate over the rank frame (no single-partition sort).

    ``approx_accuracy`` (opt-in): one aggregation pass with Spark's mergeable
    ``percentile_approx`` sketch instead (rank error <= 1/accuracy, bounded
    memory, no rank frame); the percentiles are then observed values, not
    interpolated."""
    if approx_accuracy is not None:
        x = F.col("salary_amount")
        one = floor_records(star).agg(
            F.percentile_approx(x.cast("double"), list(NATIONAL_PERCENTILES.values()),
                                approx_accuracy).alias("_q"),
            F.count(x).alias("record_count"), F.sum(x).alias("_total"),
            F.min(x).alias("_min"), F.max(x).alias("_max"))
        return one.select(*[F.col("_q")[i].alias(k) for i, k in enumerate(NATIONAL_PERCENTILES)],
                          F.try_divide(F.col("_total").cast("double"), F.col("record_count")).alias("avg"),
                          F.col("_min").cast("double").alias("min"), F.col("_max").cast("double").alias("max"),
                          F.col("record_count").cast("long").alias("record_count"),
                          F.col("_total").cast("double").alias("total_salary"))
    rf = national_frame(star)
    return rf.df.agg(*national_aggs()).select(*national_cols())


def national_aggs() -> list[Column]:
    """Aggregates over a rank frame from which ``national_cols`` makes A13."""
    return quantile_exprs(NATIONAL_PERCENTILES) + [
        F.max("n").alias("_records"), F.max("total").alias("_total"), F.max("vmin").alias("_least"), F.max("vmax").alias("_most")]


def national_cols() -> list[Column]:
    return [*[rnd(quantile_value(n), PERCENTILE_DIGITS).alias(n) for n in NATIONAL_PERCENTILES],
            F.try_divide(F.col("_total").cast("double"), F.col("_records")).alias("avg"),
            F.col("_least").cast("double").alias("min"),
            F.col("_most").cast("double").alias("max"),
            F.col("_records").cast("long").alias("record_count"),
            F.col("_total").cast("double").alias("total_salary")]


def national_and_fact(star: Star, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """One row (p, s): the A13 figures of all records with salary >= 1, and
    the inequality of the report fact, which is the part of them whose
    company is known.  The records are read and reduced to one histogram
    with both counts; the two populations are groups of one rank frame."""
    sr = _floor(star.records("company_id", "salary_amount"))
    known = star.companies.select(F.col("company_id").alias("_co"))
    hist = (sr.join(known, sr.company_id == known._co, "left").groupBy(F.col("salary_amount").alias("v"))
            .agg(F.count(F.lit(1)).alias("_all"), F.count("_co").alias("_known")))
    parts = F.array(F.struct(F.lit("all").alias("part"), F.col("_all").alias("f")),
                    F.struct(F.lit("fact").alias("part"), F.col("_known").alias("f")))
    rows = hist.select("v", F.explode(parts).alias("p")).select("p.part", "v", "p.f").where(F.col("f") > 0)
    st = (frame_from_hist(rows, ["part"]).df.groupBy("part")
          .agg(*national_aggs(), *inequality_aggs(epsilon)))
    fact = inequality_cols(epsilon)
    two = st.select("part", F.struct(*national_cols()).alias("p"), F.struct(*fact.values()).alias("s"))
    return two.agg(F.max(F.when(F.col("part") == "all", F.col("p"))).alias("p"),
                   F.max(F.when(F.col("part") == "fact", F.col("s"))).alias("s"))


def percentile_table(star: Star) -> DataFrame:
    """P2 core: the ten national percentiles as rows, each with its ratio to
    the previous one (D5) and the national mean."""
    p = national_percentiles(star)
    keys = list(NATIONAL_PERCENTILES)
    parts = []
    for i, k in enumerate(keys):
        prev = F.lit(None).cast("double") if i == 0 else \
            rnd(ratio(F.col(k), F.col(keys[i - 1])), INDEX_DIGITS)
        parts.append(F.struct(F.lit(i + 1).cast("long").alias("ord"), F.lit(k).alias("percentile_key"),
                              F.lit(NATIONAL_PERCENTILES[k]).alias("percentile"),
                              F.col(k).alias("value"), prev.alias("ratio_to_previous")))
    return (p.select(F.explode(F.array(*parts)).alias("r"), F.col("avg").alias("mean_salary"))
             .select("r.*", "mean_salary"))


def percentile_step_ratios(star: Star) -> DataFrame:
    """Ratio of each national percentile to the previous one (9 rows)."""
    t = percentile_table(star)
    return (t.where(F.col("ord") > 1)
             .select(F.col("percentile_key").alias("to_key"), "ratio_to_previous"))


def income_deciles(star: Star) -> DataFrame:
    """NTILE(10) by salary (salary >= 1): rows, total, mean and income
    share per decile.  Tie groups straddling a decile edge are split by
    count, exactly as NTILE assigns rows."""
    t = ntile(national_frame(star), DECILES)
    return t.select(F.col("tile").cast("long").alias("decile"),
                    F.col("rows").cast("long").alias("employee_count"),
                    F.col("total").cast("double").alias("total_salary"),
                    ratio(F.col("total"), F.col("rows")).alias("avg_salary"),
                    ratio(F.col("total"), F.col("group_total")).alias("income_share"))


def salary_ntile(star: Star, tiles: int = DECILES) -> DataFrame:
    """NTILE over all records with salary >= 1 as (salary, tile, rows):
    the multiset of (salary, tile) pairs, which is what NTILE fixes."""
    p = ntile_pieces(national_frame(star), tiles)
    return p.select(F.col("v").cast("double").alias("salary_amount"),
                    F.col("tile").cast("long").alias("decile"), F.col("rows").alias("row_count"))


def salary_ntile_rows(star: Star, tiles: int = DECILES, seed: int = 42) -> DataFrame:
    """D2 on every record with salary >= 1: NTILE over (salary, a seeded
    random order of equal salaries, employee and document).

    Most salaries lie inside one tile, which their records get by a join on
    the value.  Only the at most ``tiles`` - 1 salaries that an edge cuts need
    an order among their records; the rank core deals those by hash buckets,
    so a salary of a third of all records is no single task's."""
    rows = floor_records(star)
    rf = rank_frame(rows.select("salary_amount"), "salary_amount")

    def tile(pos: str) -> str:
        q, r = f"(n_rows div {tiles})", f"(n_rows % {tiles})"
        return f"(1 + if({pos} < {r} * ({q} + 1), {pos} div ({q} + 1), {r} + ({pos} - {r} * ({q} + 1)) div greatest({q}, 1)))"

    values = rf.df.select(F.col("v").alias("_v"), "pre", "n_rows", F.expr(tile("pre")).alias("_lo"), F.expr(tile("(pre + f - 1)")).alias("_hi"))
    whole = rows.join(values.where("_lo = _hi"), rows.salary_amount == F.col("_v")).select(*rows.columns, F.col("_lo").alias("decile"))
    cut = rows.join(values.where("_lo < _hi"), rows.salary_amount == F.col("_v"))
    key = F.concat_ws("|", F.coalesce(F.col("employee_id").cast("string"), F.lit("null")), F.coalesce(F.col("document_id").cast("string"), F.lit("null")))
    placed = hash_positions(cut.withColumn("_key", key), "_key", seed, ["salary_amount"])
    placed = placed.select(*rows.columns, F.expr(tile("(pre + position)")).alias("decile"))
    return whole.unionByName(placed).select("employee_id", "document_id", F.col("salary_amount").cast("double").alias("salary_amount"), F.col("decile").cast("long").alias("decile"))


def global_percent_rank(star: Star) -> DataFrame:
    """Every record with PERCENT_RANK() OVER (ORDER BY salary) -- rank
    prefix from the distributed frame, joined back on the value (AQE
    splits a hot value's partition)."""
    sr = star.records("employee_id", "document_id", "salary_amount")
    rf = rank_frame(sr.select("salary_amount"), "salary_amount")
    pr = rf.df.select(F.col("v").alias("_v"), rf.percent_rank().alias("percent_rank"))
    return (sr.join(pr, sr.salary_amount.eqNullSafe(pr._v), "inner")
              .select("employee_id", "document_id",
                      F.col("salary_amount").cast("double").alias("salary_amount"), "percent_rank"))


def percent_rank_at_least(star: Star, p: float = 0.99) -> DataFrame:
    """records whose global percent rank is >= p.  The least qualifying
    salary is one scalar, so only the records above it are joined back."""
    sr = star.records("employee_id", "document_id", "salary_amount")
    rf = rank_frame(sr.select("salary_amount"), "salary_amount")
    top = rf.df.select(F.col("v").alias("_v"), rf.percent_rank().alias("percent_rank")).where(F.col("percent_rank") >= F.lit(p))
    least = top.agg(F.min("_v")).scalar()
    few = sr.where((F.col("salary_amount") >= least) | F.col("salary_amount").isNull())
    return (few.join(top, few.salary_amount.eqNullSafe(top._v), "inner")
               .select("employee_id", "document_id", F.col("salary_amount").cast("double").alias("salary_amount"), "percent_rank"))


def running_income(star: Star) -> DataFrame:
    """Cumulative income share of every record in ascending salary
    order (over the report fact, salary >= 1)."""
    rf = rank_frame(salary_fact(star).select("salary_amount"), "salary_amount")
    return running_share(rf)


# --------------------------------------------------------------------------
# Inequality (I1 - I8) over the report fact S2
# --------------------------------------------------------------------------

def fact_frame(star: Star, groups=()):
    return rank_frame(salary_fact(star).select(*groups, "salary_amount"), "salary_amount", groups)


def inequality_measures(star: Star, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """I1 - I3 on the report fact: Gini, Hoover, Atkinson(epsilon)."""
    return inequality(fact_frame(star), epsilon)


def hoover(star: Star) -> DataFrame:
    """I2 on the report fact.  It reads the frame's totals only, so the
    running sums and their shuffle are pruned from the plan."""
    return inequality_measures(star).select("hoover")


def atkinson(star: Star, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """I3 on the report fact."""
    return atkinson_index(salary_fact(star).select("salary_amount"), epsilon=epsilon)


def inequality_by_group(star: Star, group: str = "city", epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """I8: Gini / Hoover / Atkinson per group (NULL group dropped); a hot group
    spans many rank buckets."""
    f = salary_fact(star).where(F.col(group).isNotNull())
    rf = rank_frame(f.select(group, "salary_amount"), "salary_amount", [group])
    return inequality(rf, epsilon)


def lorenz_curve(star: Star, points: int | None = None) -> DataFrame:
    """I4: the exact Lorenz curve of the report fact, one point per distinct
    salary (the last row of its ties) and the first row; with ``points``
    only the rows floor(j (n-1) / points), for a chart."""
    rf = fact_frame(star)
    curve = exact_curve(rf) if points is None else lorenz_points(rf, points)
    return curve.select(F.col("i").alias("point_index"), "x", "y")


def global_stddev(star: Star) -> DataFrame:
    """Sample standard deviation of the report fact."""
    return salary_fact(star).agg(
        rnd(F.stddev_samp(F.col("salary_amount").cast("double")), SPREAD_DIGITS).alias("stddev_salary"))


def percentile_ratios(star: Star) -> DataFrame:
    """P90/P10, P75/P25, P99/P50 and mean/median (0 when median <= 0)."""
    p = national_percentiles(star)
    return p.select(rnd(ratio(F.col("p90"), F.col("p10")), INDEX_DIGITS).alias("p90_p10"),
                    rnd(ratio(F.col("p75"), F.col("p25")), INDEX_DIGITS).alias("p75_p25"),
                    rnd(ratio(F.col("p99"), F.col("p50")), INDEX_DIGITS).alias("p99_p50"),
                    F.when(F.col("p50") > 0, rnd(ratio(F.col("avg"), F.col("p50")), INDEX_DIGITS))
                     .otherwise(F.lit(0.0)).alias("mean_median_ratio"))


def income_concentration(star: Star) -> DataFrame:
    """Income share (%) of the top decile, top two deciles and bottom
    five, from exact decile sums."""
    t = ntile(national_frame(star), DECILES)

    def share(cond):
        return rnd(ratio(F.sum(F.when(cond, F.col("total"))), F.sum("total")) * 100, INDEX_DIGITS)
    return t.agg(share(F.col("tile") == 10).alias("top_10_percent"),
                 share(F.col("tile") >= 9).alias("top_20_percent"),
                 share(F.col("tile") <= 5).alias("bottom_50_percent"))


def top1_threshold(star: Star) -> DataFrame:
    """The P99 salary, i.e. the minimum salary of the top 1%."""
    return national_percentiles(star).select(F.col("p99").alias("top1_min_salary"))


# --------------------------------------------------------------------------
# Company sizes
# --------------------------------------------------------------------------

def company_size_distribution(star: Star) -> DataFrame:
    """Distinct employees per company id (salary >= 1) -> size range ->
    companies and employees per range."""
    sizes = company_sizes(star, 1).select("size")
    return (sizes.select(COMPANY_SIZE.ordinal("size").alias("range_order"), "size")
                 .groupBy("range_order")
                 .agg(F.count(F.lit(1)).alias("company_count"),
                      F.sum("size").cast("long").alias("employee_count"))
                 .select(F.element_at(F.array(*[F.lit(x) for x in COMPANY_SIZE.labels]),
                                      F.col("range_order")).alias("size_range"),
                         F.col("range_order").cast("long").alias("range_order"),
                         "company_count", "employee_count"))


# --------------------------------------------------------------------------
# Report pages
# --------------------------------------------------------------------------

def report_summary(star: Star) -> DataFrame:
    """Key statistics page as one row (percentiles over records with
    salary >= 1; stddev, Gini and Hoover over the report fact)."""
    p = national_and_fact(star).select("p.*", "s")
    fact = F.col("s")
    return p.select(
        "record_count", "total_salary", F.col("avg").alias("mean_salary"),
        F.col("p50").alias("median_salary"),
        F.when(F.col("p50") > 0, rnd(ratio(F.col("avg"), F.col("p50")), INDEX_DIGITS))
         .otherwise(F.lit(0.0)).alias("mean_median_ratio"),
        F.col("min").alias("min_salary"), F.col("max").alias("max_salary"),
        rnd(F.col("max") - F.col("min"), 2).alias("salary_range"),
        fact.getField("stddev_salary").alias("stddev_salary"),
        "p10", "p25", "p50", "p75", "p90", "p95", "p99",
        rnd(ratio(F.col("p90"), F.col("p10")), INDEX_DIGITS).alias("p90_p10"),
        rnd(ratio(F.col("p75"), F.col("p25")), INDEX_DIGITS).alias("p75_p25"),
        rnd(ratio(F.col("p99"), F.col("p50")), INDEX_DIGITS).alias("p99_p50"),
        fact.getField("gini").alias("gini"),
        F.coalesce(fact.getField("hoover"), F.lit(0.0)).alias("hoover"))


def page_salary_distribution(star: Star) -> DataFrame:
    """Report salary ranges with their share of rows (%)."""
    b = report_salary_buckets(star)
    total = b.agg(F.sum("count")).scalar()
    return b.withColumn("percentage", ratio(F.col("count"), total) * F.lit(100.0))


def page_percentiles(star: Star) -> DataFrame:
    """The ten percentile bars, the mean line and step ratios."""
    return percentile_table(star)


def page_lorenz(star: Star, epsilon: float = DEFAULT_EPSILON) -> DataFrame:
    """Inequality box of the Lorenz page (curve points: ``lorenz_curve``)."""
    p = national_and_fact(star, epsilon).select("p.*", "s")
    s = F.col("s")
    return p.select(s.getField("gini").alias("gini"), F.coalesce(s.getField("hoover"), F.lit(0.0)).alias("hoover"),
                    F.coalesce(s.getField("atkinson"), F.lit(0.0)).alias("atkinson"),
                    rnd(ratio(F.col("p90"), F.col("p10")), INDEX_DIGITS).alias("p90_p10"),
                    rnd(ratio(F.col("p75"), F.col("p25")), INDEX_DIGITS).alias("p75_p25"),
                    rnd(ratio(F.col("p99"), F.col("p50")), INDEX_DIGITS).alias("p99_p50"),
                    F.col("p99").alias("top1_min_salary"))


def page_decile_shares(star: Star) -> DataFrame:
    """Income share (%) per decile."""
    d = income_deciles(star)
    return d.select("decile", "employee_count", "total_salary",
                    rnd(F.col("income_share") * 100, INDEX_DIGITS).alias("income_share_pct"))


def page_company_sizes(star: Star) -> DataFrame:
    """P5: size ranges plus totals and the average company size."""
    s = company_size_distribution(star)
    tot = s.agg(F.struct(F.sum("company_count").alias("c"), F.sum("employee_count").alias("e"))).scalar()
    tc, te = tot.getField("c"), tot.getField("e")
    return s.select("*", tc.cast("long").alias("total_companies"),
                    te.cast("long").alias("total_employees"),
                    rnd(ratio(te, tc), SPREAD_DIGITS).alias("avg_company_size"))


def _top(df: DataFrame, by: str, keys, n: int = PAGE_TOP) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_first(), *[F.col(k).asc_nulls_last() for k in keys]).limit(n)


def page_top_cities_headcount(star: Star) -> DataFrame:
    """15 cities with most employees."""
    t = _top(report_city_stats(star), "employee_count", ["city"])
    return t.select("city", "employee_count", "company_count", "avg_salary",
                    F.col("avg_salary").cast("long").alias("avg_salary_label"))


def page_top_cities_salary(star: Star, min_employees: int = PAGE_MIN_EMPLOYEES_GEO) -> DataFrame:
    """Cities with >= 100 employees, 15 highest mean salaries."""
    s = report_city_stats(star).where(F.col("employee_count") >= min_employees)
    return _top(s, "avg_salary", ["city"]).select("city", "avg_salary", "employee_count", "company_count")


def page_top_activities_headcount(star: Star) -> DataFrame:
    """15 activities with most employees; label = 50 chars + '...'."""
    t = _top(report_activity_stats(star), "employee_count", ["activity_description"])
    return t.select("activity_description",
                    truncate_label("activity_description", *ACTIVITY_LABEL).alias("short_name"),
                    "employee_count", "company_count", "avg_salary")


def page_top_activities_salary(star: Star, min_employees: int = PAGE_MIN_EMPLOYEES_GEO) -> DataFrame:
    """Activities with >= 100 employees, 15 highest means (+ median)."""
    s = report_activity_stats(star).where(F.col("employee_count") >= min_employees)
    return _top(s, "avg_salary", ["activity_description"]).select(
        "activity_description",
        truncate_label("activity_description", *ACTIVITY_LABEL).alias("short_name"),
        "avg_salary", "employee_count", "company_count", "median_salary")


def _largest_cities(star: Star) -> DataFrame:
    return _top(report_city_stats(star), "employee_count", ["city"])


def page_city_mean_median(star: Star) -> DataFrame:
    """P10: mean/median ratio of the 15 largest cities."""
    t = _largest_cities(star)
    return t.select("city", "avg_salary", "median_salary", "employee_count",
                    rnd(ratio(F.col("avg_salary"), F.col("median_salary")), INDEX_DIGITS)
                    .alias("mean_median_ratio"))


def page_city_cv(star: Star) -> DataFrame:
    """Coefficient of variation of the 15 largest cities (NULL when a
    city has one record)."""
    t = _largest_cities(star)
    return t.select("city", "stddev_salary", "avg_salary", "employee_count",
                    rnd(ratio(F.col("stddev_salary"), F.col("avg_salary")), INDEX_DIGITS).alias("cv"))


def page_city_captions(star: Star) -> DataFrame:
    """The captions of P6 and P7 for every city: the mean as a magnitude and
    as an axis label, and a line with whole numbers cut, not rounded."""
    t = report_city_stats(star)
    whole = F.floor("avg_salary").cast("long")
    line = F.concat(F.lit("Companies: "), F.format_number("company_count", 0), F.lit(" | Avg Salary: "), F.format_number(whole, 0), F.lit(" MAD"))
    return t.select("city", magnitude_label("avg_salary").alias("magnitude"), money_axis_label("avg_salary").alias("axis_label"), line.alias("caption"))


def page_city_iqr(star: Star) -> DataFrame:
    """Interquartile range and p75/p25 of the 15 largest cities."""
    t = _largest_cities(star)
    return t.select("city", "p25_salary", "p75_salary", "employee_count",
                    rnd(F.col("p75_salary") - F.col("p25_salary"), PERCENTILE_DIGITS).alias("iqr"),
                    rnd(ratio(F.col("p75_salary"), F.col("p25_salary")), INDEX_DIGITS).alias("iqr_ratio"))


def _company_labels(df: DataFrame) -> list:
    return [or_unknown("city").alias("city_label"),
            truncate_label("activity_description", *COMPANY_ACTIVITY_LABEL).alias("activity_label")]


def page_top_companies_headcount(star: Star) -> DataFrame:
    """15 companies (name, city, activity) with most employees."""
    keys = ["company_name", "city", "activity_description"]
    t = _top(report_company_stats(star), "employee_count", keys)
    return t.select(*keys, *_company_labels(t), "employee_count", "avg_salary",
                    F.col("avg_salary").cast("long").alias("avg_salary_label"))


def page_top_companies_salary(star: Star, min_employees: int = PAGE_MIN_EMPLOYEES_COMPANY) -> DataFrame:
    """Companies with >= 30 employees, 15 highest means (+ median)."""
    keys = ["company_name", "city", "activity_description"]
    s = report_company_stats(star).where(F.col("employee_count") >= min_employees)
    t = _top(s, "avg_salary", keys)
    return t.select(*keys, *_company_labels(t), "avg_salary", "employee_count", "median_salary")


# --------------------------------------------------------------------------
# README questions
# --------------------------------------------------------------------------

def size_vs_salary_corr(star: Star) -> DataFrame:
    """Correlation between company size (distinct employees) and the
    company's mean salary, over companies in the report fact."""
    per = company_sizes(star, 1).select("size", ratio(F.col("pay"), F.col("paid")).alias("avg_salary"))
    return per.agg(F.count(F.lit(1)).alias("company_count"),
                   rnd(F.corr(F.col("size").cast("double"), "avg_salary"), INDEX_DIGITS).alias("correlation"))


def compare_two_cities(star: Star, city_a: str, city_b: str) -> DataFrame:
    """Report salary ranges of two cities side by side."""
    rows = _floor(company_fact(star)).where(F.col("city").isin(city_a, city_b))
    b = rows.select(REPORT_SALARY.ordinal("salary_amount").alias("range_order"), "city")
    p = b.groupBy("range_order").pivot("city", [city_a, city_b]).count()
    return p.select(F.element_at(F.array(*[F.lit(x) for x in REPORT_SALARY.labels]),
                                 F.col("range_order")).alias("salary_range"),
                    F.col("range_order").cast("long").alias("range_order"),
                    F.coalesce(F.col(f"`{city_a}`"), F.lit(0)).cast("long").alias("count_a"),
                    F.coalesce(F.col(f"`{city_b}`"), F.lit(0)).cast("long").alias("count_b"))
