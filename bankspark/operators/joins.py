"""Joins with a defined meaning for null keys, missing rows and very frequent keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join where one key may own a large part of ``right``.

    A left outer join cannot split its right side. Written as the inner join (both sides can be
    split when skewed) plus the left rows without a match, found against the distinct keys, it can.
    """
    matched = left.join(right, key)
    alone = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def null_safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on equality where null matches null, as data frame libraries do."""
    renamed = right.withColumnRenamed(key, "_right_key")
    return left.join(renamed, F.col(key).eqNullSafe(F.col("_right_key")), how).drop("_right_key")


def with_suffix(df: DataFrame, keep: Sequence[str], suffix: str) -> DataFrame:
    """Rename all columns but the kept ones, so that a join has no equal names."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns])


def pair_all(many: DataFrame, few: DataFrame, spread_by: str, lanes: int = 64) -> DataFrame:
    """Every row of ``many`` with every row of ``few``, as an ordinary equality join.

    The rows of ``many`` are dealt to lanes by a hash of their key and ``few`` is copied to every
    lane, so each task handles its share of ``many`` whatever the size of either side.
    """
    dealt = many.withColumn("_lane", F.pmod(F.xxhash64(spread_by), F.lit(lanes)).cast("int"))
    copies = few.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return dealt.join(copies, "_lane").drop("_lane")


def repeated_by(rows: DataFrame, others: DataFrame, key: str, count_name: str) -> DataFrame:
    """A many-to-many inner join in compact form.

    Each row of ``rows`` stands for ``count_name`` equal copies, one per matching row of
    ``others``. Sums weight by that count, and the pairs themselves never exist.
    """
    counts = others.groupBy(key).agg(F.count(F.lit(1)).alias(count_name))
    return rows.join(counts, key)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join a lookup on a key with few and therefore hot values.

    Spark broadcasts the lookup if it is below its size limit, and else splits skewed partitions.
    """
    return rows.join(lookup, key, how)
