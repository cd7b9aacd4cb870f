"""Order-independent arithmetic on money and counts.

Sums of doubles depend on the order in which tasks deliver their rows.  Money is therefore summed as whole
cents in a BIGINT buffer (codegen-friendly, exact up to 9.2e16 currency units, overflow raises under ANSI)
and turned into a double once, after the final merge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = 100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_cents(c: Column | str) -> Column:
    return F.rint(_col(c) * CENTS).cast("bigint")


def round_cents(c: Column | str) -> Column:
    """Half-even rounding to cents, as a double."""
    return F.rint(_col(c) * CENTS) / CENTS


def sum_money(c: Column | str, where: Column | None = None) -> Column:
    cents = to_cents(c)
    if where is not None:
        cents = F.when(where, cents)
    return F.sum(cents).cast("double") / CENTS


def mean_money(c: Column | str, where: Column | None = None) -> Column:
    """Exact total over count of the non-null values; NULL over no rows."""
    value = to_cents(c)
    if where is not None:
        value = F.when(where, value)
    return F.try_divide(F.sum(value).cast("double") / CENTS, F.count(value).cast("double"))


def sum_int(c: Column | str, where: Column | None = None) -> Column:
    value = _col(c).cast("bigint")
    if where is not None:
        value = F.when(where, value)
    return F.sum(value)


def mean_int(c: Column | str, where: Column | None = None) -> Column:
    value = _col(c).cast("bigint")
    if where is not None:
        value = F.when(where, value)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Double quotient, NULL on a zero or NULL divisor."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def share_of(condition: Column) -> Column:
    """Fraction of rows for which `condition` holds; NULL conditions count as false."""
    return F.try_divide(F.count_if(condition).cast("double"), F.count(F.lit(1)).cast("double"))


def pct_change(recent: Column, base: Column) -> Column:
    return (ratio(recent, base) - 1) * 100


FIXED = "decimal(30,8)"  # sums of it have 30 digits before the point


def _fixed(c: Column | str, where: Column | None) -> Column:
    value = _col(c).try_cast(FIXED)
    return value if where is None else F.when(where, value)


def sum_fixed(c: Column | str, where: Column | None = None) -> Column:
    """Sum of numbers of any unit to 8 decimals, free of the order of rows; what is no finite number counts as missing."""
    return F.sum(_fixed(c, where)).cast("double")


def mean_fixed(c: Column | str, where: Column | None = None) -> Column:
    """Mean of numbers of any unit to 8 decimals, free of the order of rows; what is no finite number counts as missing."""
    value = _fixed(c, where)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))
