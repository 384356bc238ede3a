"""Ordered keys and ranges of bounded size: what a sort in one task would need, in pieces.

A value becomes a 64-bit key of the same order. The keys of a group form a tree: a node is all keys that
agree in their leading bits. Nodes are counted level by level, and only those with too many rows are opened,
so ranges are narrow where rows are dense. What lies before a node is added up among its sisters and
handed down from its parent.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankspark.session import cut_lineage

ROWS_PER_RANGE = 200_000
_DIGIT = 13  # bits by which a node is opened: at most 8,192 sisters
_LARGEST = 1.7976931348623157e308
LOWEST_KEY = -(2**63)


def double_key(value: Column) -> Column:
    """The bits of a double as a signed number of the same order; NaN is above infinity, -0.0 equals 0.0.

    Powers of two are exact, so exponent and mantissa are too. The first number after the largest double
    stands for infinity, as in the bits themselves. Null has no key.
    """
    size = F.least(F.abs(value), F.lit(_LARGEST))
    guess = F.floor(F.coalesce(F.log2(size), F.lit(-1022.0)))
    power = F.pow(F.lit(2.0), guess.cast("double"))
    exact = guess + F.when(size < power, -1).when(size / 2 >= power, 1).otherwise(0)
    exponent = F.greatest(exact, F.lit(-1022))
    mantissa = size / F.pow(F.lit(2.0), exponent.cast("double")) - 1
    beyond = F.when(F.isnan(value), 2).when(F.abs(value) == F.lit(float("inf")), 1).otherwise(0)
    bits = (exponent + 1023) * F.lit(2**52) + (mantissa * F.lit(2.0**52)).cast("bigint") + beyond
    return F.when(value < 0, -bits).when(value.isNotNull(), bits)


def double_of(key: int) -> float:
    """The double whose ``double_key`` is ``key``."""
    size = struct.unpack("<d", struct.pack("<Q", abs(key)))[0]
    return -size if key < 0 else size


def ordered_key(df: DataFrame, column: str) -> Column:
    """A 64-bit key in the order of a numeric column; null is lowest."""
    kind = df.schema[column].dataType.typeName()
    whole = kind in ("byte", "short", "integer", "long")
    key = F.col(column).cast("bigint") if whole else double_key(F.col(column).cast("double"))
    return F.coalesce(key, F.lit(LOWEST_KEY))


def digit_shifts(low: int, high: int) -> list[int]:
    """Where to cut keys between ``low`` and ``high``: from their first different bit, a digit at a time."""
    shift, shifts = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64, []
    while not shifts or shift > 0:
        shift = max(shift - _DIGIT, 0)
        shifts.append(shift)
    return shifts


def in_ranges(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    totals: Mapping[str, Column],
    before: Callable[[Column, Column, W], Column],
    rows: int,
    shifts: Sequence[int],
) -> tuple[DataFrame, DataFrame | None]:
    """Cut each group of ``df`` into ranges of ``key`` with at most ``rows`` rows.

    ``totals`` are summed up per node; ``before(total, parent's, earlier sisters)`` tells what a node takes
    over from the rows before it. Returns the rows with ``_shift`` and ``_node`` (their range) and
    ``_before_<name>``, and the rows of single keys that alone have more than ``rows`` rows (or None).
    ``df`` is read once per level for counts and once for the rows.
    """
    by = list(by)
    names = {name: f"_before_{name}" for name in totals}
    opened = df.withColumns({b: F.lit(None) for b in names.values()})
    done: list[DataFrame] = []
    above = None
    for shift in shifts:
        level = opened.withColumn("_node", F.shiftright(key, shift))
        handed = {} if above is None else {b: F.any_value(b).alias(f"_parent{b}") for b in names.values()}
        nodes = level.groupBy(*by, "_node").agg(
            F.count(F.lit(1)).alias("_rows"),
            *[total.alias(f"_total_{name}") for name, total in totals.items()], *handed.values(),
        )
        sisters = [] if above is None else [F.shiftright("_node", above - shift)]
        earlier = W.partitionBy(*by, *sisters).orderBy("_node").rowsBetween(W.unboundedPreceding, -1)
        taken = [
            before(F.col(f"_total_{n}"), F.col(f"_parent{b}") if handed else F.lit(None), earlier).alias(b)
            for n, b in names.items()
        ]
        own = [F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]
        nodes = cut_lineage(nodes.select(*own, F.col("_node").alias("_at"), "_rows", *taken))
        same = F.col("_node") == F.col("_at")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
        joined = level.drop(*names.values()).join(nodes, same).drop("_at", *[f"_by{i}" for i in range(len(by))])
        joined = joined.withColumn("_shift", F.lit(shift))
        if nodes.filter(F.col("_rows") > rows).isEmpty():
            done.append(joined)
            opened = None
            break
        done.append(joined.filter(F.col("_rows") <= rows))
        opened = joined.filter(F.col("_rows") > rows)
        if shift != shifts[-1]:
            opened = opened.drop("_node", "_rows", "_shift")
        above = shift
    ranged = done[0]
    for more in done[1:]:
        ranged = ranged.unionByName(more)
    return ranged.drop("_rows"), None if opened is None else opened.drop("_rows")


def sum_before(total: Column, parent: Column, earlier: W) -> Column:
    """Totals of all rows before a node."""
    zero = F.lit(0)
    return F.coalesce(parent, zero) + F.coalesce(F.sum(total).over(earlier), zero)


def last_before(total: Column, parent: Column, earlier: W) -> Column:
    """The largest value before a node, where later nodes have larger values."""
    return F.coalesce(F.max(total).over(earlier), parent)
