"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: Column, *formats: str) -> Column:
    """The first format that fits; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def parse_date(c: Column, *formats: str) -> Column:
    return parse_time(c, *formats).cast("date")


def month_key(c: Column) -> Column:
    """``yyyy-MM`` text: sorts the same way as time."""
    return F.date_format(c, "yyyy-MM")


def day_of(c: Column) -> Column:
    return c.cast("date")


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def weekday_short(c: Column) -> Column:
    return F.date_format(c, "E")


def is_weekend(c: Column) -> Column:
    """1 on Saturday and Sunday."""
    return F.when(F.dayofweek(c).isin(1, 7), 1).otherwise(0)


def days_since(as_of: str, c: Column) -> Column:
    """Whole days from ``c`` up to a fixed day."""
    return F.datediff(F.lit(as_of).cast("date"), c)


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours as a fraction, from the exact microsecond difference."""
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(later) - micros(earlier)) / F.lit(3.6e9)


def loan_end(start: Column, term_months: Column) -> Column:
    """A month of a loan term counts 30 days."""
    return F.date_add(start, term_months * 30)
