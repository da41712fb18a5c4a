"""Seed-data generators and random orders, hash-seeded so that every
recomputation (retry, lost executor) reproduces the same values.

``rand(seed)`` depends on partition layout and row order, which change
when a stage is recomputed from shuffled input; a hash of (seed, tag, key)
does not.  Each draw uses its own tag, so draws are independent, as the
reference's separate ``random()`` calls are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salarium.operators.ranks import PRE, V, hash_bucket, rank_frame
from salarium.sources.star import SALARY

# Fixed values (reference seed script); the filename is prefix || id ||
# suffix, and the prefix names the declaring authority (a parameter).
FILENAME_PREFIX = "DECL_"
FILENAME_SUFFIX = "_2024_01.pdf"
# (max company id, base headcount, random span): ids 1-5 -> 15-49,
# 6-15 -> 5-19, the rest -> 2-9.
HEADCOUNT_BANDS = [(5, 15, 35), (15, 5, 15)]
HEADCOUNT_DEFAULT = (2, 8)
HIGH_PAY_COMPANIES = [1, 4, 5, 6, 11, 17]
MEDIUM_PAY_COMPANIES = [2, 7, 13, 15, 19]
# Per tier: ((probability, base, span) for each CASE branch, then ELSE (base, span)).
PAY_TIERS = {
    "high": ([(0.15, 50000, 100000), (0.40, 15000, 35000), (0.75, 8000, 12000)], (4000, 6000)),
    "medium": ([(0.10, 30000, 50000), (0.30, 12000, 18000), (0.70, 6000, 8000)], (3500, 4500)),
    "low": ([(0.10, 20000, 30000), (0.30, 8000, 12000), (0.70, 4500, 5500)], (3000, 3000)),
}



def digest_bits(digits: int, *parts: str | int | Column) -> Column:
    """The first ``digits`` hex digits of the MD5 of the parts joined by
    '|', as a long: the same in every SQL engine."""
    cols = [F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, digits), 16, 10).cast("long")


def uniform(seed: int, tag: str, *cols: str | Column) -> Column:
    """Deterministic uniform [0, 1) draw from (seed, tag, cols): 52 bits."""
    h = digest_bits(13, seed, tag, *[F.col(c) if isinstance(c, str) else c for c in cols])
    return h.cast("double") / F.lit(float(1 << 52))


def document_headcounts(companies: DataFrame, seed: int = 42,
                        prefix: str = FILENAME_PREFIX) -> DataFrame:
    """One declaration per company with a random headcount band;
    filename = prefix || company_id || '_2024_01.pdf'."""
    cid = F.col("company_id")
    u = uniform(seed, "headcount", "company_id")
    hc = None
    for max_id, base, span in HEADCOUNT_BANDS:
        v = F.lit(base) + F.floor(u * span).cast("int")
        hc = F.when(cid <= max_id, v) if hc is None else hc.when(cid <= max_id, v)
    hc = hc.otherwise(F.lit(HEADCOUNT_DEFAULT[0]) + F.floor(u * HEADCOUNT_DEFAULT[1]).cast("int"))
    return companies.select(
        cid.alias("document_id"),
        F.concat(F.lit(prefix), cid.cast("string"), F.lit(FILENAME_SUFFIX)).alias("filename"),
        cid.alias("company_id"),
        hc.cast("int").alias("employee_count"),
        F.lit(0).cast(SALARY).alias("total_salary_mass"))


def hash_positions(df: DataFrame, key: str, seed: int, groups=()) -> DataFrame:
    """Dense 0-based position of every row of ``df`` in a seeded random
    order (per group), from the distributed rank core: no global sort and
    no whole group in one task.  ``key`` must be unique within a group;
    hash collisions are ordered by ``key``."""
    groups = list(groups)
    h = df.withColumn("_h", digest_bits(15, seed, "order", *[F.col(c) for c in (*groups, key)]))
    rf = rank_frame(h.select(*groups, "_h"), "_h", groups, bucket=hash_bucket(df, F.col(V)))
    pos = rf.df.select(*groups, F.col(V).alias("_h"), F.col(PRE).alias("_pre"), F.col("n").alias("_n"))
    j = h.join(pos, groups + ["_h"], "inner")
    tie = Window.partitionBy(*groups, "_h").orderBy(key)   # collision groups: 1-2 rows
    return j.withColumn("position", F.col("_pre") + F.row_number().over(tie) - 1).drop("_h", "_pre")


def random_order_in_company(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """D3: ROW_NUMBER() OVER (PARTITION BY company ORDER BY random) over
    distinct (company, employee) pairs, without a per-company window."""
    p = pairs.select("company_id", "employee_id").distinct()
    return (hash_positions(p, "employee_id", seed, ["company_id"])
            .select("company_id", "employee_id", (F.col("position") + 1).alias("emp_num")))


def _pay(seed: int, tier: str) -> Column:
    branches, (else_base, else_span) = PAY_TIERS[tier]
    keys = ("company_id", "employee_id")
    expr = None
    for i, (p, base, span) in enumerate(branches):
        cond = uniform(seed, f"{tier}-if{i}", *keys) < p
        val = F.lit(base) + uniform(seed, f"{tier}-v{i}", *keys) * span
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(F.lit(else_base) + uniform(seed, f"{tier}-else", *keys) * else_span)


#: Rounds of a permutation, and the most turns of one cycle walk.  A walk
#: leaves [0, size) for less than sqrt(size) of the values, so each further
#: turn is needed with a chance of at most 1 / sqrt(size).
ROUNDS = 4
WALK = 64


def keyed_place(j: str, key: str, size: str, seed: int) -> Column:
    """Where place ``j`` goes in the permutation of 0 .. size - 1 that belongs
    to ``key`` (column names): a Feistel network over pairs (l, r) with l
    below a and r below b, a * b just over ``size``, whose round numbers are
    digests of seed, key, round and the other half; values beyond ``size``
    go round again (cycle walking), which keeps it a bijection."""
    return F.expr(_walked(f"cast({j} as bigint)", key, size, seed, 1))


def _sides(size: str) -> tuple[str, str]:
    a = f"cast(ceil(sqrt({size})) as bigint)"
    return a, f"(({size} + {a} - 1) div {a})"


def _drawn(seed: int, key: str, i: int | str, half: str) -> str:
    return f"cast(conv(substring(md5(concat_ws('|', '{seed}', 'place', {key}, {i}, {half})), 1, 13), 16, 10) as bigint)"


def _walked(start: str, key: str, size: str, seed: int, first: int) -> str:
    """The walk from turn ``first`` on, whatever the number of turns."""
    a, b = _sides(size)

    def digest(i: str, half: str) -> str:
        return _drawn(seed, key, i, half)

    turn = (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', x div {b}, 'r', x % {b}), (s, i) -> if(i % 2 = 1, "
            f"named_struct('l', (s.l + {digest('i', 's.r')}) % {a}, 'r', s.r), "
            f"named_struct('l', s.l, 'r', (s.r + {digest('i', 's.l')}) % {b})), s -> s.l * {b} + s.r)")
    walk = f"aggregate(sequence({first}, {WALK}), {start}, (x, t) -> if(t > 1 AND x < {size}, x, {turn}))"
    return f"transform(array({walk}), x -> if(x < {size}, x, raise_error('a cycle walk did not end')))[0]"


def with_places(df: DataFrame, j: str, key: str, size: str, seed: int, name: str = "position") -> DataFrame:
    """``df`` with ``keyed_place`` as column ``name``.  The first turn, which
    ends nearly every walk, goes through compiled columns, each computed once
    a row; only values beyond ``size`` go on in the general form."""
    own = df.columns
    a, b = _sides("_size")
    steps = [{"_size": f"cast({size} as bigint)", "_x": f"cast({j} as bigint)"}, {"_a": a, "_b": b}, {"_l": "_x div _b", "_r": "_x % _b"}]
    for i in range(1, ROUNDS + 1):
        half, side, other = ("_l", "_a", "_r") if i % 2 else ("_r", "_b", "_l")
        steps.append({half: f"({half} + {_drawn(seed, key, i, other)}) % {side}"})
    for step in [*steps, {"_x": "_l * _b + _r"}]:
        kept = [c for c in df.columns if c not in step]
        df = df.select(*kept, F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in step.items()]))))
    return df.select(*own, F.expr(f"if(_x < _size, _x, {_walked('_x', key, '_size', seed, 2)})").alias(name))


def synthetic_assignments(documents: DataFrame, employees: DataFrame, seed: int = 42) -> DataFrame:
    """For every declaration (company, headcount h) pick h distinct
    employees in a random order of its own and draw a salary from the
    company's pay tier.

    The reference cross-joins companies with employees, orders each company's
    copy at random and keeps the first h.  Here employees have dense
    positions, and company c takes the positions to which its own keyed
    permutation sends 0 .. h - 1: the draws of two companies are independent,
    no employee repeats within one, and the work is proportional to the rows
    produced (an equi-join on position), never companies x employees.
    """
    emp = hash_positions(employees.select("employee_id"), "employee_id", seed)
    total = emp.agg(F.max("_n")).scalar()
    slots = (documents.where(F.col("employee_count") > 0)
             .select("document_id", "company_id", F.col("employee_count").alias("h"), total.alias("_e"))
             .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("h").cast("long"), F.col("_e")) - 1))))
    slots = with_places(slots, "_j", "company_id", "_e", seed)
    rows = slots.join(emp.select("employee_id", "position"), "position", "inner")
    cid = F.col("company_id")
    salary = (F.when(cid.isin(HIGH_PAY_COMPANIES), _pay(seed, "high"))
              .when(cid.isin(MEDIUM_PAY_COMPANIES), _pay(seed, "medium"))
              .otherwise(_pay(seed, "low")))
    return rows.select("employee_id", "company_id", "document_id",
                       (F.col("_j") + 1).alias("emp_num"),
                       salary.cast("decimal(10,2)").cast(SALARY).alias("salary_amount"))
