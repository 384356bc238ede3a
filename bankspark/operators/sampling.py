"""Repeatable splits and samples from an arithmetic hash of the row id.

The same rows come out on any number of partitions, after a retry, and in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankspark.functions.numbers import HASH_RANGE, arithmetic_hash

_HASHES_PER_BUCKET = 1024


def rank_by_hash(df: DataFrame, id_column: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Add ``_rank`` (1, 2, 3 ... in hash order within ``by``) and ``_size`` (rows of the group).

    A group may hold most of the table, so it is not ranked in one window: the hash range is cut
    into about a thousand buckets, each bucket is ranked on its own, and the number of rows in the
    earlier buckets of the group is added.
    """
    by = list(by)
    hashed = df.withColumn("_hash", arithmetic_hash(F.col(id_column), seed))
    hashed = hashed.withColumn("_bucket", F.floor(F.col("_hash") / _HASHES_PER_BUCKET))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *by, "_bucket",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(W.partitionBy(*by)).alias("_size"),
        )
    )
    inside = W.partitionBy(*by, "_bucket").orderBy("_hash", id_column)
    return (
        hashed.join(offsets, [*by, "_bucket"])
        .withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
        .drop("_hash", "_bucket", "_before")
    )


def split_flag(
    df: DataFrame, id_column: str, share: float, seed: int, by: Sequence[str] = (), round_up: bool = False
) -> DataFrame:
    """Add ``is_train``: the first ``share`` of each group in (hash, id) order, cut down or up to whole rows.

    ``id_column`` must be unique. Only two numbers per group are needed, the hash and the id of the
    last training row: the hash comes from counts per hash value (at most 1,000,003 per group), the
    id from the few rows that share that hash. The rows themselves are flagged where they are; the
    table is not shuffled.
    """
    by = list(by)
    quota = F.ceil if round_up else F.floor
    hashed = df.withColumn("_hash", arithmetic_hash(F.col(id_column), seed))
    groups = {f"_by{i}": c for i, c in enumerate(by)}
    keys = list(groups)
    named = hashed.withColumns({k: F.col(c) for k, c in groups.items()})

    def with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
        if not keys:  # one row: its values become literals
            row = cuts.first()
            return rows.withColumns({c: F.lit(row[c] if row else None).cast(t) for c, t in cuts.dtypes})
        small = cuts.select(*[F.col(k).alias(f"_c{k}") for k in keys], *[c for c in cuts.columns if c not in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_c{k}")) for k in keys]
        return rows.join(small, reduce(lambda a, b: a & b, same), "left").drop(
            *[f"_c{k}" for k in keys]
        )

    counted = named.groupBy(*keys, "_hash").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_hash"))
    wanted = quota(F.sum("_n").over(W.partitionBy(*keys)) * F.lit(share))
    edges = (
        counted.select(*keys, "_hash", "_n", upto.alias("_upto"), wanted.alias("_want"))
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(
            *keys, F.col("_hash").alias("_edge"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_take")
        )
    )
    at_edge = with_cuts(named.select(*keys, "_hash", id_column), edges).filter(F.col("_hash") == F.col("_edge"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(id_column))
    cuts = (
        at_edge.withColumn("_place", place).filter(F.col("_place") == F.col("_take"))
        .select(*keys, "_edge", F.col(id_column).alias("_last"))
    )
    before = F.col("_hash") < F.col("_edge")
    inside = (F.col("_hash") == F.col("_edge")) & (F.col(id_column) <= F.col("_last"))
    return with_cuts(named, cuts).withColumn("is_train", F.coalesce(before | inside, F.lit(False))).drop(
        "_hash", "_edge", "_last", *keys
    )


def complement(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not chosen."""
    return df.join(chosen.select(key), key, "left_anti")


def ab_group(id_column: Column, seed: int) -> Column:
    """A for hashes in the upper half, else B."""
    return F.when(arithmetic_hash(id_column, seed) > HASH_RANGE // 2, "A").otherwise("B")


def sample_rows(df: DataFrame, id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, the first in hash order."""
    return df.orderBy(arithmetic_hash(F.col(id_column), seed), id_column).limit(n)


def fold_of(id_column: Column, folds: int, seed: int) -> Column:
    """Fold number 0 .. folds-1 for cross validation."""
    return F.pmod(arithmetic_hash(id_column, seed), F.lit(folds)).cast("int")

