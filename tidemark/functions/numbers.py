"""Guarded arithmetic used by counters and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Integer division; no detour over doubles."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def safe_div(numerator: Column, denominator: Column) -> Column:
    """The quotient as double, 0 where the denominator is not positive or null."""
    return F.when(denominator > 0, numerator.cast("double") / denominator).otherwise(F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return safe_div(F.lit(100.0) * part, whole)


def share_rounded(part: Column, rest: Column) -> Column:
    """`part` of `part + rest` in percent with two decimals, 0 for nothing."""
    return F.round(percent(part, part + rest), 2)


def batch_count(rows: Column, batch_size: int) -> Column:
    """Number of batches of `batch_size` that hold `rows` rows."""
    return int_div(rows + (batch_size - 1), batch_size)


def batch_number(position: Column, batch_size: int) -> Column:
    """1-based batch of a 1-based position."""
    return int_div(position - 1, batch_size) + 1


def update_share(rows: int | Column, ratio_percent: int) -> tuple:
    """How many of `rows` are updates and inserts; the updates are truncated."""
    whole = isinstance(rows, Column)
    updates = update_share_column(rows, ratio_percent) if whole else rows * ratio_percent // 100
    return updates, rows - updates


def update_share_column(rows: Column, ratio_percent: int) -> Column:
    return int_div(rows * ratio_percent, 100)
