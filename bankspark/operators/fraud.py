"""Fraud features, rule flags and fraud reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions import dates as D
from bankspark.functions.numbers import log_amount, money_avg, money_sum, percent, ratio
from bankspark.operators.quantiles import exact_quantiles
from bankspark.operators.ranges import LOWEST_KEY, ROWS_PER_RANGE, in_ranges, last_before

RULE_FLAGS = ["amount_anomaly", "type_anomaly", "channel_anomaly", "time_anomaly", "location_anomaly"]
MODEL_FLAGS = ["iso_anomaly_flag", "ae_anomaly_flag"]
_TIME_SHIFTS = [32, 16, 0]  # ranges of 71 minutes, of 66 milliseconds, of one microsecond


def time_features(tx: DataFrame) -> DataFrame:
    """Hour, weekday and weekend flag of each transaction."""
    when = F.col("transaction_date")
    return tx.withColumns(
        {"hour": F.hour(when), "day_of_week": D.weekday_short(when), "is_weekend": D.is_weekend(when)}
    )


def group_modes(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Most frequent value of several text columns per key: nulls ignored, ties take the lowest.

    Values are counted per (key, column, value) first. A key with very many rows reaches the
    second step as one row per distinct value.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("_field"), F.col(c).alias("_value")) for c in fields])
    counted = (
        df.select(key, F.inline(pairs))
        .filter(F.col("_value").isNotNull())
        .groupBy(key, "_field", "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    best = F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("value"))
    return counted.groupBy(key).agg(
        *[F.min(F.when(F.col("_field") == c, best))["value"].alias(name) for c, name in fields.items()]
    )


def usual_patterns(tx: DataFrame) -> DataFrame:
    """Per account: mean and deviation of amounts and the usual type, channel, hour, merchant, location."""
    hours = tx.withColumn("_hour", F.lpad(F.hour("transaction_date").cast("string"), 2, "0"))
    modes = group_modes(
        hours, "account_id",
        {
            "type": "most_common_type", "channel": "preferred_channel", "_hour": "usual_hour",
            "merchant": "top_merchant", "location": "top_location",
        },
    ).withColumn("usual_hour", F.col("usual_hour").cast("int"))
    amounts = tx.groupBy("account_id").agg(
        money_avg(F.col("amount")).alias("avg_amount"), F.stddev_samp("amount").alias("std_amount")
    )
    return amounts.join(modes, "account_id", "left")


def time_since_last(tx: DataFrame, rows: int = ROWS_PER_RANGE) -> DataFrame:
    """Hours since the previous transaction of the account; null for the first.

    No account is sorted as a whole: its times are cut into ranges of at most ``rows`` rows, and the first
    row of a range takes the last time before it from a table with one row per range. Rows of one account
    and instant are ordered by their (unique) id; where they alone exceed a range, only the one with the
    lowest id looks further back, and the others have zero.
    """
    when = F.col("transaction_date")
    keyed = tx.withColumn("_key", F.coalesce(F.unix_micros(when.cast("timestamp")), F.lit(LOWEST_KEY)))
    ends = {"end": F.max("transaction_date")}
    ranged, crowded = in_ranges(keyed, ["account_id"], "_key", ends, last_before, rows, _TIME_SHIFTS)
    inside = W.partitionBy("account_id", "_shift", "_node").orderBy("_key", "transaction_id")
    out = ranged.withColumn("_previous", F.coalesce(F.lag("transaction_date").over(inside), F.col("_before_end")))
    if crowded is not None:
        firsts = crowded.groupBy(F.col("account_id").alias("_account"), F.col("_node").alias("_at")).agg(
            F.min("transaction_id").alias("_first")
        )
        same = F.col("account_id").eqNullSafe(F.col("_account")) & (F.col("_node") == F.col("_at"))
        earlier = F.when(F.col("transaction_id") == F.col("_first"), F.col("_before_end")).otherwise(when)
        found = crowded.join(firsts, same).withColumn("_previous", earlier)
        out = out.unionByName(found.drop("_account", "_at", "_first"))
    return out.withColumn("time_since_last", D.hours_between(when, F.col("_previous"))).drop(
        "_key", "_shift", "_node", "_before_end", "_previous"
    )


def _flag(condition: Column) -> Column:
    """1 or 0; an unknown condition stays null."""
    return condition.cast("int")


def rule_flags(tx: DataFrame, patterns: DataFrame) -> DataFrame:
    """Attach the account's patterns and flag what departs from them."""
    c = F.col
    return tx.join(patterns, "account_id", "left").withColumns(
        {
            "amount_anomaly": _flag(c("amount") > c("avg_amount") + 3 * c("std_amount")),
            "type_anomaly": _flag(c("type") != c("most_common_type")),
            "channel_anomaly": _flag(c("channel") != c("preferred_channel")),
            "time_anomaly": _flag(F.abs(c("hour") - c("usual_hour")) > 4),
            "location_anomaly": _flag(c("location") != c("top_location")),
        }
    )


def combine_flags(df: DataFrame, flags: Sequence[str], limit: int = V.FRAUD_FLAG_LIMIT) -> DataFrame:
    """Sum of the flags and the fraud flag; a null flag makes both null."""
    total = F.col(flags[0])
    for f in flags[1:]:
        total = total + F.col(f)
    return df.withColumn("combined_anomaly_score", total).withColumn(
        "fraud_flag", _flag(F.col("combined_anomaly_score") >= limit)
    )


def rule_scored(tx: DataFrame) -> DataFrame:
    """Transactions with time features and the five rule flags combined."""
    return combine_flags(rule_flags(time_features(tx), usual_patterns(tx)), RULE_FLAGS)


def top_share_flag(df: DataFrame, column: str, name: str, share: float = 0.99) -> DataFrame:
    """1 for values strictly above the exact quantile."""
    limit = exact_quantiles(df, column, [share])[0]
    return df.withColumn(name, _flag(F.col(column) > F.lit(limit)))


def with_intensity(df: DataFrame) -> DataFrame:
    """Amount times anomaly score, and the marker radius of the map."""
    return df.withColumns(
        {
            "fraud_intensity": F.col("amount") * F.col("combined_anomaly_score"),
            "marker_radius": log_amount(F.col("amount")) * 2,
        }
    )


def locate(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Attach city coordinates and tell whether they lie within the country's box."""
    lat, lng = F.col("lat"), F.col("lng")
    inside = lat.between(*V.LAT_RANGE) & lng.between(*V.LNG_RANGE)
    return df.join(cities, "location", "left").withColumn("inside", F.coalesce(inside, F.lit(False)))


def daily_series(flagged: DataFrame) -> DataFrame:
    """Total, average amount and fraud count per day; missing values are skipped."""
    return flagged.groupBy(D.day_of(F.col("transaction_date")).alias("date")).agg(
        money_sum(F.col("amount")).alias("total_amount"),
        money_avg(F.col("amount")).alias("avg_amount"),
        F.sum("fraud_flag").alias("fraud_count"),
    )


def _fraud_amount() -> Column:
    return F.coalesce(money_sum(F.when(F.col("fraud_flag") == 1, F.col("amount"))), F.lit(0.0))


def daily_summary(flagged: DataFrame) -> DataFrame:
    """Transactions, amount, fraud cases and fraud amount per day."""
    return flagged.groupBy(D.day_of(F.col("transaction_date")).alias("date")).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        money_sum(F.col("amount")).alias("total_amount"),
        F.sum("fraud_flag").alias("fraud_cases"),
        _fraud_amount().alias("fraud_amount"),
    )


def account_risk(flagged: DataFrame) -> DataFrame:
    """Risk profile per account, riskiest first."""
    return flagged.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("fraud_flag").alias("fraud_count"),
        ratio(F.sum("fraud_flag"), F.count("fraud_flag")).alias("fraud_ratio"),
        money_sum(F.col("amount")).alias("total_amount"),
        _fraud_amount().alias("fraud_amount"),
    ).orderBy(F.desc("fraud_ratio"), "account_id")


def location_risk(flagged: DataFrame, at_least: int = V.MIN_LOCATION_TRANSACTIONS) -> DataFrame:
    """Fraud rate (a fraction) per location with enough transactions, riskiest first."""
    return (
        flagged.groupBy("location")
        .agg(
            F.count(F.lit(1)).alias("transaction_count"),
            F.sum("fraud_flag").alias("fraud_count"),
            ratio(F.sum("fraud_flag"), F.count("fraud_flag")).alias("fraud_rate"),
            money_avg(F.col("amount")).alias("avg_amount"),
        )
        .filter(F.col("transaction_count") > at_least)
        .orderBy(F.desc("fraud_rate"), "location")
    )


def dashboard(flagged: DataFrame) -> DataFrame:
    """Rows, fraud cases and fraud rate in percent."""
    return flagged.agg(
        F.count(F.lit(1)).alias("total_transactions"), F.sum("fraud_flag").alias("fraud_cases")
    ).withColumn("fraud_rate_pct", F.round(percent(F.col("fraud_cases"), F.col("total_transactions")), 2))


def with_alerts(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Transactions with the label of their alert; no alert counts as no fraud."""
    labels = alerts.select("transaction_id", "is_fraud")
    return tx.join(labels, "transaction_id", "left").withColumn(
        "is_fraud", F.coalesce("is_fraud", F.lit(False))
    )


def fraud_by(labelled: DataFrame, key: str) -> DataFrame:
    """Transactions, frauds and fraud rate in percent per value; missing values are Unknown."""
    return (
        labelled.groupBy(F.coalesce(F.col(key), F.lit("Unknown")).alias(key))
        .agg(F.count(F.lit(1)).alias("total_transactions"), F.count_if("is_fraud").alias("fraud_count"))
        .withColumn("fraud_rate", percent(F.col("fraud_count"), F.col("total_transactions")))
    )


def fraud_by_date(alerts: DataFrame) -> DataFrame:
    """Confirmed frauds per alert day."""
    return (
        alerts.filter("is_fraud").groupBy(F.col("fraud_date").alias("fraud_date_only"))
        .agg(F.count(F.lit(1)).alias("fraud_count"))
    )


def fraud_kpis(labelled: DataFrame) -> DataFrame:
    """Totals, rate and amounts of labelled frauds in one row, two decimals."""
    amount = F.when(F.col("is_fraud"), F.col("amount"))
    return labelled.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if("is_fraud").alias("total_fraud_cases"),
        F.round(percent(F.count_if("is_fraud"), F.count(F.lit(1))), 2).alias("fraud_rate_pct"),
        money_sum(amount).alias("total_fraud_amount"),
        F.round(money_avg(amount), 2).alias("average_fraud_amount"),
        F.max(amount).alias("max_fraud_amount"),
        F.min(amount).alias("min_fraud_amount"),
    )
