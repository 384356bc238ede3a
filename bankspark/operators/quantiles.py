"""Exact quantiles and running totals that stay distributed.

``percentile`` keeps every distinct value of a group in one task and an unpartitioned window
sorts everything in one task. Here quantiles are found digit by digit of an ordered key, and totals are
added up along a tree of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankspark.operators.ranges import (
    ROWS_PER_RANGE, digit_shifts, double_key, double_of, in_ranges, ordered_key, sum_before,
)
from bankspark.session import cut_lineage

_DIGIT = 16  # bits settled by one pass: four passes, at most 65,536 counts per wanted rank


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Linear-interpolated quantiles (R type 7), exact for any number of rows.

    Radix selection: each pass counts the next 16 bits of the keys that share the bits found so far, for
    all probabilities at once. Nothing is ordered but the counts, and every table takes the same four
    passes, over its keys only: they are written once (8 bytes a row), so what ``df`` costs is paid once. Nulls and NaN are left out; without other rows every quantile is None.
    """
    v = F.col(column).cast("double")
    keys = df.select(v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    keys = cut_lineage(keys.select(double_key(F.col("_v")).alias("_key")))
    n, targets, ranks, found = 0, [], [], []
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        left = keys.filter(F.shiftright("_key", shift + _DIGIT).isin(sorted(set(found)))) if found else keys
        counted = left.groupBy(F.shiftright("_key", shift).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
        counts = counted.toPandas().sort_values("bits")
        if not found:
            n = int(counts["n"].sum())
            if n == 0:
                return [None] * len(probs)
            targets = [(n - 1) * p for p in probs]
            ranks = [min(math.floor(t) + up, n - 1) for t in targets for up in (0, 1)]
        parent = counts["bits"].to_numpy() >> _DIGIT
        below = [0] * len(ranks)
        for i, rank in enumerate(ranks):
            sisters = counts[parent == found[i]] if found else counts
            upto = sisters["n"].cumsum().to_numpy()
            at = int((upto <= rank).sum())
            below[i], ranks[i] = int(sisters["bits"].iloc[at]), rank - int(upto[at] - sisters["n"].iloc[at])
        found = below
    values = [double_of(key) for key in found]
    return [_between(values[2 * i], values[2 * i + 1], t - math.floor(t)) for i, t in enumerate(targets)]


def _between(low: float, high: float, part: float) -> float:
    return low if part == 0 or low == high else low + (high - low) * part


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), rows: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add ``<name>_upto`` columns: totals of ``sums`` over all rows of the group up to ``order``.

    ``order`` must be numeric and unique within ``by`` (group by it first); a null comes first. Every range
    has at most ``rows`` rows and is finished by its own task; a few whole numbers per range are added up along
    the tree. The result does not depend on where the ranges end.
    """
    by = list(by)
    keyed = cut_lineage(df.withColumn("_key", ordered_key(df, order)))
    ends = keyed.agg(F.min("_key").alias("low"), F.max("_key").alias("high")).first()
    shifts = digit_shifts(ends["low"] or 0, ends["high"] or 0)
    totals = {c: F.sum(c) for c in sums}
    ranged, _ = in_ranges(keyed, by, "_key", totals, sum_before, rows, shifts)
    inside = W.partitionBy(*by, "_shift", "_node").orderBy("_key")
    out = ranged.withColumns({f"{c}_upto": F.sum(c).over(inside) + F.col(f"_before_{c}") for c in sums})
    return out.drop("_key", "_shift", "_node", *[f"_before_{c}" for c in sums])
