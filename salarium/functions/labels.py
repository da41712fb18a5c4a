"""Display-label expressions used by the report and dashboard datasets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_label(c: str | Column, max_len: int, keep: int) -> Column:
    """``c[:keep] + '...'`` when longer than ``max_len`` characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > max_len, F.concat(F.substring(c, 1, keep), F.lit("...")))\
            .otherwise(c)


def or_unknown(c: str | Column) -> Column:
    """Python ``value or 'Unknown'``: NULL and '' become 'Unknown'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown"))


def magnitude_label(c: str | Column) -> Column:
    """2.50M / 1.5K / 900 style label."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (F.when(c >= 1_000_000, F.format_string("%.2fM", c / 1_000_000))
            .when(c >= 1_000, F.format_string("%.1fK", c / 1_000))
            .otherwise(F.format_string("%.0f", c)))


def money_axis_label(c: str | Column) -> Column:
    """1.5M MAD / 30K MAD / 900 MAD axis label."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (F.when(c >= 1_000_000, F.format_string("%.1fM MAD", c / 1_000_000))
            .when(c >= 1_000, F.format_string("%.0fK MAD", c / 1_000))
            .otherwise(F.format_string("%.0f MAD", c)))
