"""Month arithmetic on dates and on integer month keys (YYYYMM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_index(yyyymm: int) -> int:
    """Months since year 0, for a Python month key."""
    return yyyymm // 100 * 12 + yyyymm % 100 - 1


def index_key(index: int) -> int:
    return index // 12 * 100 + index % 12 + 1


def key_plus(yyyymm: int, months: int) -> int:
    return index_key(key_index(yyyymm) + months)


def month_start(yyyymm: Column) -> Column:
    """First day of an integer month; NULL if the month part is not 1..12."""
    year = F.floor(yyyymm / 100).cast("int")
    month = (yyyymm % 100).cast("int")
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def month_floor(date: Column) -> Column:
    return F.trunc(date, "month").cast("date")


def month_key(date: Column) -> Column:
    return F.year(date) * 100 + F.month(date)


def month_index(yyyymm: Column) -> Column:
    """Months since year 0, so that distances are plain differences."""
    year = F.floor(yyyymm / 100).cast("int")
    return yyyymm - year * 88 - 1


def index_to_key(index: Column) -> Column:
    return (F.floor(index / 12) * 100 + index % 12 + 1).cast("int")


def months_apart(later: Column, earlier: Column) -> Column:
    """Whole months between two first-of-month dates."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
