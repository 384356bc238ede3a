"""Peaks, top rows and extremes with defined ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.operators.reports import monthly_summary


def peak_and_least_months(tx: DataFrame, key: str = "location") -> DataFrame:
    """Best and worst month of each key by count and by amount; ties take the latest month.

    One aggregate over the monthly rows: ``max_by`` on (metric, month) orders ties by month, so
    no ranking window is needed.
    """
    monthly = monthly_summary(tx, [key], average=False, extremes=False)
    month, n, total = F.col("date_time"), F.col("transaction_count"), F.col("total_amount")
    return monthly.groupBy(key).agg(
        F.max_by(month, F.struct(n, month)).alias("peak_transaction_month"),
        F.max(n).alias("peak_transaction_count"),
        F.max_by(month, F.struct(-n, month)).alias("least_transaction_month"),
        F.min(n).alias("least_transaction_count"),
        F.max_by(month, F.struct(total, month)).alias("peak_amount_month"),
        F.max(total).alias("peak_total_amount"),
        F.max_by(month, F.struct(-total, month)).alias("least_amount_month"),
        F.min(total).alias("least_total_amount"),
    )


def first_peak_months(tx: DataFrame, key: str = "location") -> DataFrame:
    """Best month of each key by count and by amount; ties take the earliest month."""
    monthly = monthly_summary(tx, [key], average=False, extremes=False)
    month, n, total = F.col("date_time"), F.col("transaction_count"), F.col("total_amount")
    return monthly.groupBy(key).agg(
        F.min_by(month, F.struct(-n, month)).alias("peak_transaction_month"),
        F.max(n).alias("max_transactions"),
        F.min_by(month, F.struct(-total, month)).alias("peak_amount_month"),
        F.max(total).alias("max_total_amount"),
    )


def top_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of a full order; give a unique last key so the cut is defined."""
    return df.orderBy(*order).limit(n)


def top_with_ties(grouped: DataFrame, metric: str, n: int) -> DataFrame:
    """Rows whose metric is among the ``n`` best, every tie of the last place included.

    Meant for grouped rows, one per key, of any number: each task keeps its ``n`` best, and the worst
    of the best is the limit. Nulls come last.
    """
    m = F.col(metric)
    best = grouped.select(m.alias("_m")).orderBy(F.desc("_m")).limit(n)
    limit = best.agg(F.min("_m")).scalar()
    nulls_too = best.agg(F.count_if(F.col("_m").isNull()) > 0).scalar()
    return grouped.filter((m >= limit) | (m.isNull() & nulls_too))


def extremes(grouped: DataFrame, key: str, metric: str) -> DataFrame:
    """The keys with the largest and the smallest metric, ties by the lowest key."""
    m, k = F.col(metric), F.col(key)
    return grouped.agg(
        F.min_by(k, F.struct(-m, k)).alias("most_active"),
        F.max(m).alias("most_count"),
        F.min_by(k, F.struct(m, k)).alias("least_active"),
        F.min(m).alias("least_count"),
    )


def with_share(grouped: DataFrame, metric: str, name: str) -> DataFrame:
    """Each row's metric as percent of the whole, which is added up apart from the rows."""
    whole = grouped.agg(F.sum(metric)).scalar()
    return grouped.withColumn(name, F.col(metric).cast("double") / whole * 100)
