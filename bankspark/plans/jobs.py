"""End-to-end jobs: several operators over shared, already grouped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.functions.dates import month_key
from bankspark.functions.numbers import as_money, cents_sum
from bankspark.session import cut_lineage


def _report_rows(df: DataFrame, report: str, key1: str, key2: str | None = None) -> DataFrame:
    second = F.col(key2) if key2 else F.lit(None).cast("string")
    return df.select(
        F.lit(report).alias("report"),
        F.col(key1).alias("key1"),
        second.alias("key2"),
        "transaction_count",
        as_money(F.col("_total")).alias("total_amount"),
    )


def transaction_report(tx: DataFrame) -> DataFrame:
    """All tables of the transaction report in long form.

    The transactions are grouped once by month, type, location and channel; every table of the
    report is a further sum of that small cube, so the large table is scanned a single time. The
    cube is written once (it is at most months x types x locations x channels rows).
    """
    cube = (
        tx.groupBy(month_key(F.col("transaction_date")).alias("date_time"), "type", "location", "channel")
        .agg(F.count(F.lit(1)).alias("_n"), cents_sum(F.col("amount")).alias("_s"))
        .persist()
    )

    def by(*keys: str) -> DataFrame:
        return cube.groupBy(*keys).agg(F.sum("_n").alias("transaction_count"), F.sum("_s").alias("_total"))

    monthly = by("date_time")
    parts = [
        _report_rows(monthly, "monthly", "date_time"),
        _report_rows(by("type", "date_time"), "monthly_by_type", "date_time", "type"),
        _report_rows(by("location", "date_time"), "monthly_by_location", "date_time", "location"),
        _report_rows(by("channel"), "channel", "channel"),
        _report_rows(
            by("location").orderBy(F.desc("transaction_count"), "location").limit(10),
            "top_locations",
            "location",
        ),
        _report_rows(
            monthly.orderBy(F.desc("transaction_count"), "date_time").limit(5), "peak_months", "date_time"
        ),
        _report_rows(
            monthly.orderBy(F.desc("_total"), "date_time").limit(5), "highest_revenue_months", "date_time"
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def account_report(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Profile, histogram, distinct counts, ownership and region rows of the account table."""
    from bankspark.operators import profile as P
    from bankspark.operators.reports import count_and_sum_through

    regions = count_and_sum_through(
        accounts, customers, "customer_id", "region", "status", "balance", "n", "total"
    )
    by_region = regions.select(
        F.inline(
            F.array(
                F.struct(
                    F.concat(F.lit("Status in "), "region").alias("column"), F.lit("bigint").alias("dtype"),
                    F.col("status").alias("value"), F.col("n").cast("double").alias("count"),
                ),
                F.struct(
                    F.concat(F.lit("Balance in "), "region").alias("column"), F.lit("double").alias("dtype"),
                    F.col("status").alias("value"), F.col("total").alias("count"),
                ),
            )
        )
    )
    chosen = ["account_type", "status", "open_date", "customer_id", "balance"]
    parts = [
        P.scalar_profile(accounts, "balance", "Balance"),
        P.banded_histogram(accounts, "balance"),
        P.distinct_profile(accounts),
        P.count_of_counts(accounts, "customer_id"),
        P.value_profile(accounts, "account_id", chosen),
        by_region,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def campaign_report(customers: DataFrame, responses: DataFrame) -> DataFrame:
    """Response rates overall and by region, gender, age group and income in one long table.

    The customer rows with their yes and no counts are built once; each customer row then feeds
    all dimensions in a single grouped pass.
    """
    from bankspark import fixed_values as V
    from bankspark.functions.numbers import bin_left_closed, ratio
    from bankspark.operators.campaign import merged_counts

    merged = merged_counts(customers, responses)
    age = bin_left_closed(F.col("age"), V.AGE_EDGES, V.AGE_LABELS)
    dimensions = {
        "overall": F.lit("all"),
        "region": F.col("region"),
        "gender": F.col("gender"),
        "age_group": age,
        "income": F.col("income").cast("decimal(18,2)").cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("value")) for d, c in dimensions.items()])
    counted = (
        merged.select("_no", "_yes", F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.sum("_no").alias("no_response"), F.sum("_yes").alias("responded"))
    )
    # every age group has a row, also one that no customer falls into
    bands = customers.sparkSession.createDataFrame(
        [("age_group", label, 0, 0) for label in V.AGE_LABELS],
        "dimension STRING, value STRING, no_response BIGINT, responded BIGINT",
    )
    complete = counted.unionByName(bands).groupBy("dimension", "value").agg(
        F.sum("no_response").alias("no_response"), F.sum("responded").alias("responded")
    )
    total = F.col("no_response") + F.col("responded")
    return complete.withColumn("total", total).withColumn(
        "response_rate_pct", ratio(F.col("responded"), F.col("total")) * 100
    )


def fraud_reports(flagged: DataFrame) -> DataFrame:
    """Daily, per account, per location and overall fraud figures in one long table.

    The columns in use are written once; each report is an aggregate of its own over them, so rows
    are summed within their tasks and every report shuffles only its own groups.
    """
    from bankspark import fixed_values as V

    day = F.col("transaction_date").cast("date").cast("string")
    rows = cut_lineage(
        flagged.select(
            day.alias("day"), F.col("account_id").cast("string").alias("account"), "location", "fraud_flag", "amount"
        )
    )
    keys = {"daily": F.col("day"), "account": F.col("account"), "location": F.col("location"), "all": F.lit("all")}
    parts = [
        rows.groupBy(key.alias("key")).agg(
            F.count(F.lit(1)).alias("transactions"), F.sum("fraud_flag").alias("frauds"),
            as_money(cents_sum(F.col("amount"))).alias("amount"),
        ).select(F.lit(report).alias("report"), "key", "transactions", "frauds", "amount")
        for report, key in keys.items()
    ]
    reports = parts[0]
    for part in parts[1:]:
        reports = reports.unionByName(part)
    return reports.filter(
        (F.col("report") != "location") | (F.col("transactions") > V.MIN_LOCATION_TRANSACTIONS)
    )
