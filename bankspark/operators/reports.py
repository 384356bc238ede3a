"""Group-by reports over accounts and transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.functions.dates import month_key
from bankspark.functions.numbers import as_money, cents_sum, money_avg, money_sum


def value_counts(df: DataFrame, column: str, name: str = "count", keep_null: bool = False) -> DataFrame:
    """Rows per value; the null group is kept only on request (the SQL habit)."""
    kept = df if keep_null else df.filter(F.col(column).isNotNull())
    return kept.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def sum_by(df: DataFrame, keys: str | Sequence[str], amount: str, name: str) -> DataFrame:
    """Exact money total per key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(money_sum(F.col(amount)).alias(name))


def count_and_sum_through(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    dimension_column: str,
    fact_column: str | None,
    amount: str,
    count_name: str,
    sum_name: str,
) -> DataFrame:
    """Count and sum of facts per (dimension column[, fact column]).

    The facts are summed per key before the join, so a key that owns a large part of all rows
    reaches the join as a handful of rows.
    """
    per_key = [key] + ([fact_column] if fact_column else [])
    small = facts.groupBy(*per_key).agg(
        F.count(F.lit(1)).alias("_n"), cents_sum(F.col(amount)).alias("_s")
    )
    out = [dimension_column] + ([fact_column] if fact_column else [])
    return (
        small.join(dimension.select(key, dimension_column), key)
        .groupBy(*out)
        .agg(F.sum("_n").alias(count_name), as_money(F.sum("_s")).alias(sum_name))
    )


def monthly_summary(
    tx: DataFrame, by: Sequence[str] = (), average: bool = True, extremes: bool = True
) -> DataFrame:
    """Count, total[, average][, min, max] per month and further keys."""
    amount = F.col("amount")
    stats = [F.count(F.lit(1)).alias("transaction_count"), money_sum(amount).alias("total_amount")]
    if average:
        stats.append(money_avg(amount).alias("average_amount"))
    if extremes:
        stats += [F.min(amount).alias("min_amount"), F.max(amount).alias("max_amount")]
    return tx.groupBy(*by, month_key(F.col("transaction_date")).alias("date_time")).agg(*stats)


def channel_summary(tx: DataFrame) -> DataFrame:
    """Count, total and average per channel, busiest first."""
    return (
        tx.groupBy("channel")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            money_sum(F.col("amount")).alias("total_amount"),
            money_avg(F.col("amount")).alias("average_amount"),
        )
        .orderBy(F.desc("transaction_count"), "channel")
    )


def share_of_total(tx: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` keys by count with their share of all rows in percent.

    The total is a sum of the grouped rows, no task sees them all.
    """
    grouped = tx.groupBy(key).agg(
        F.count(F.lit(1)).alias("transaction_count"), money_sum(F.col("amount")).alias("total_amount")
    )
    whole = grouped.agg(F.sum("transaction_count")).scalar()
    share = F.round(F.col("transaction_count").cast("double") / whole * 100, 4)
    return (
        grouped.withColumn("percentage_of_total", share)
        .orderBy(F.desc("transaction_count"), key)
        .limit(top)
    )


def account_statistics(tx: DataFrame) -> DataFrame:
    """Mean, count, total, min, max and sample deviation of amounts per account."""
    amount = F.col("amount")
    return tx.groupBy("account_id").agg(
        money_avg(amount).alias("average_transaction"),
        F.count(amount).alias("transaction_count"),
        money_sum(amount).alias("total_amount"),
        F.min(amount).alias("min_transaction"),
        F.max(amount).alias("max_transaction"),
        F.round(F.stddev_samp(amount), 4).alias("transaction_std_dev"),
    )


def with_owner(stats: DataFrame, accounts: DataFrame) -> DataFrame:
    """Attach the customer of each account; accounts without a match keep a null owner."""
    return stats.join(accounts.select("account_id", "customer_id"), "account_id", "left")
