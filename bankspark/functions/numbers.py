"""Numeric expressions: money, bins, clipping, encoding, arithmetic hashing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


_LOW_BITS = 20


def cents(c: Column) -> Column:
    """Money as whole cents, so that sums do not depend on row order."""
    return F.floor(c * 100 + F.lit(0.5))


def cents_sum(c: Column) -> Column:
    """Exact total in cents (a decimal; sum it again freely, then :func:`as_money`).

    The high and the low bits are summed as two plain integers, which stay far from overflow for
    trillions of rows and are many times faster than a decimal per row.
    """
    whole = cents(c)
    high = F.sum(F.shiftright(whole, _LOW_BITS)).cast("decimal(20,0)")
    return high * F.lit(1 << _LOW_BITS) + F.sum(whole.bitwiseAND((1 << _LOW_BITS) - 1))


def as_money(total: Column) -> Column:
    """A total in cents as a double."""
    return total.cast("double") / 100.0


def money_sum(c: Column) -> Column:
    """Exact sum of a money column, as a double."""
    return as_money(cents_sum(c))


def money_avg(c: Column) -> Column:
    """Exact sum over the non-null count; null for a group without values."""
    return F.try_divide(money_sum(c), F.count(c))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null when the whole is zero."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def finite_or_null(c: Column) -> Column:
    """NaN and both infinities become null."""
    return F.when(~(F.isnan(c) | c.isin(math.inf, -math.inf)), c)


def log_amount(c: Column) -> Column:
    """log(1 + amount)."""
    return F.log1p(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def risk_tier(score: Column) -> Column:
    """Over 700 Low, over 600 Medium, else High."""
    return F.when(score > 700, "Low").when(score > 600, "Medium").otherwise("High")


def _bins(c: Column, edges: Sequence[float], labels: Sequence[str], inside) -> Column:
    result = None
    for low, high, label in zip(edges, edges[1:], labels):
        hit = inside(c, F.lit(low), F.lit(high))
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result


def bin_left_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """[low, high) bands; outside all bands is null, the top edge too."""
    return _bins(c, edges, labels, lambda v, low, high: (v >= low) & (v < high))


def bin_right_closed(
    c: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False
) -> Column:
    """(low, high] bands; the lowest edge is outside unless ``include_lowest``."""
    banded = _bins(c, edges, labels, lambda v, low, high: (v > low) & (v <= high))
    if include_lowest:
        return F.when(c == F.lit(edges[0]), F.lit(labels[0])).otherwise(banded)
    return banded


def ordinal(c: Column, levels: Sequence[str]) -> Column:
    """Position of the level in its fixed order, from 1; null for an unknown level."""
    result = None
    for i, level in enumerate(levels, start=1):
        result = F.when(c == level, i) if result is None else result.when(c == level, i)
    return result


def dummies(c: Column, levels: Sequence[str], prefix: str) -> dict[str, Column]:
    """One 0/1 column per level, every level kept."""
    return {
        f"{prefix}_{level.lower().replace(' ', '_')}": F.when(c == level, 1).otherwise(0)
        for level in levels
    }


# Knuth's multiplicative constant; ids below 2**31 keep the product inside 63 bits.
_HASH_FACTOR = 2654435761
HASH_RANGE = 1000003


def arithmetic_hash(id_column: Column, seed: int) -> Column:
    """Repeatable hash in [0, 1000003) that any SQL engine can compute.

    The id is first reduced below 2**31 so that the product cannot overflow whatever its size.
    """
    reduced = F.pmod(id_column.cast("bigint"), F.lit(2147483647).cast("bigint"))
    return F.pmod(reduced * F.lit(_HASH_FACTOR) + F.lit(seed), F.lit(HASH_RANGE)).cast("bigint")
