"""Exact rounding and money arithmetic.

Spark and other engines disagree on ``round(double, 2)`` at binary ties and
a double sum depends on row order, so results are computed from integers:
whole minutes, decimal money (rounded once, at the end). ``ROUND(AVG(x), 2)`` over integer
inputs becomes an integer division that rounds half up on the exact ratio,
which is what the analysis means and is the same on every engine and under
every partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
MICRO_DOLLARS = 1_000_000
MONEY = "decimal(28,10)"


def int_div(a: Column, b: Column | int) -> Column:
    """Integral division (SQL ``a div b``), truncating toward zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def floor_div(a: Column, b: Column) -> Column:
    """Floor division for ``b > 0`` (exact for negative ``a`` too)."""
    return int_div(a - F.pmod(a, b), b)


def _positive(den: Column) -> Column:
    return den.isNotNull() & (den > 0)


def round2_ratio(num: Column, den: Column) -> Column:
    """``round(num / den, 2)`` half up (toward +inf) on integers; NULL when
    ``den`` is 0 or NULL (the reference divides; we never raise on an empty
    segment)."""
    num = num.cast("long")
    den = den.cast("long")
    cents = floor_div(num * 200 + den, den * 2)
    return F.when(_positive(den), cents.cast("double") / 100)


def round_half_up_ratio(num: Column, den: Column, scale_factor: int) -> Column:
    """Integer ``round(num / den * scale_factor)`` half up."""
    num = num.cast("long")
    den = den.cast("long")
    return F.when(_positive(den), floor_div(num * (2 * scale_factor) + den, den * 2))


def cents_of(ratio_num: Column, ratio_den: Column) -> Column:
    """The cents integer behind :func:`round2_ratio`."""
    return round_half_up_ratio(ratio_num, ratio_den, 100)


def round2(x: Column) -> Column:
    """Half-up rounding of a non-negative double to 2 places."""
    return F.floor(x * 100 + 0.5) / 100


def money(amount: Column) -> Column:
    """A monetary double as an exact decimal with ten places: sums of it do
    not depend on row order, and no digit an amount has is cut off."""
    return amount.cast(MONEY)


def money_sum(amount: Column) -> Column:
    return F.sum(amount).cast(MONEY)


def mean_money(total: Column, n: Column) -> Column:
    """``total / n`` with twenty places; NULL when ``n`` is 0 or NULL."""
    return F.when(_positive(n), total / n.cast("long"))


def round_money(total: Column, n: Column, places: int) -> Column:
    """``round(total / n, places)`` half up, in units of the last place."""
    return (F.round(mean_money(total, n), places) * 10 ** places).cast("long")


def minutes_between(start_us: Column, end_us: Column) -> Column:
    """Whole minutes from ``start_us`` to ``end_us`` (epoch microseconds,
    ``end >= start``); equals the warehouse's TIMESTAMP_DIFF(..., MINUTE)."""
    return int_div(end_us - start_us, MICROS_PER_MINUTE)
