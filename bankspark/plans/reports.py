"""Account and transaction reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark.operators import ranking as K
from bankspark.operators import reports as R
from bankspark.plans.registry import query

_SUM = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
_AVG = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({0})"
SUM_AMOUNT, AVG_AMOUNT = _SUM.format("amount"), _AVG.format("amount")
SUM_BALANCE = _SUM.format("balance")
MONTH = "strftime(transaction_date, '%Y-%m')"

_ACCOUNT_COUNT = "SELECT {0}, COUNT(*) AS count FROM accounts WHERE {0} IS NOT NULL GROUP BY {0}"


@query("ag1_value_counts", "accounts", _ACCOUNT_COUNT.format("account_type"))
def _(b):
    return R.value_counts(b.accounts, "account_type")


@query("ag1_value_counts_status", "accounts", _ACCOUNT_COUNT.format("status"))
def _(b):
    return R.value_counts(b.accounts, "status")


@query(
    "ag1_value_counts_location",
    "transactions",
    "SELECT location, COUNT(*) AS number_of_transactions FROM transactions GROUP BY location",
)
def _(b):
    return R.value_counts(b.transactions, "location", "number_of_transactions", keep_null=True)


@query("ag2_sum_by_key", "accounts", f"SELECT status, {SUM_BALANCE} AS total_balance FROM accounts GROUP BY status")
def _(b):
    return R.sum_by(b.accounts, "status", "balance", "total_balance").orderBy(F.desc("total_balance"), "status")


@query(
    "ag2_sum_by_account_type",
    "accounts",
    f"SELECT account_type, {SUM_BALANCE} AS total_balance FROM accounts GROUP BY account_type",
)
def _(b):
    return R.sum_by(b.accounts, "account_type", "balance", "total_balance")


@query(
    "ag2_sum_by_region",
    "accounts customers",
    f"SELECT region, COUNT(*) AS account_count, {SUM_BALANCE} AS balance "
    "FROM accounts JOIN customers USING (customer_id) GROUP BY region",
)
def _(b):
    return R.count_and_sum_through(
        b.accounts, b.customers, "customer_id", "region", None, "balance", "account_count", "balance"
    )


@query(
    "ag2_sum_by_location",
    "transactions",
    f"SELECT location, {SUM_AMOUNT} AS total_transaction_amount FROM transactions GROUP BY location",
)
def _(b):
    return R.sum_by(b.transactions, "location", "amount", "total_transaction_amount")


_TWO_KEYS = (
    "SELECT region, {0}, COUNT(*) AS {1}, " + SUM_BALANCE + " AS balance "
    "FROM accounts JOIN customers USING (customer_id) GROUP BY region, {0}"
)


@query("ag3_count_and_sum_by_two_keys", "accounts customers", _TWO_KEYS.format("status", "status_count"))
def region_status(b):
    return R.count_and_sum_through(
        b.accounts, b.customers, "customer_id", "region", "status", "balance", "status_count", "balance"
    ).orderBy("region", "status")


@query(
    "ag3_count_and_sum_by_region_account_type",
    "accounts customers",
    _TWO_KEYS.format("account_type", "account_type_count"),
)
def _(b):
    return R.count_and_sum_through(
        b.accounts, b.customers, "customer_id", "region", "account_type", "balance",
        "account_type_count", "balance",
    ).orderBy("region", "account_type")


_MONTHLY = f"""SELECT {MONTH} AS date_time, COUNT(*) AS transaction_count, {SUM_AMOUNT} AS total_amount,
 {AVG_AMOUNT} AS average_amount, MIN(amount) AS min_amount, MAX(amount) AS max_amount
 FROM transactions GROUP BY 1"""


@query("ag4_monthly_summary", "transactions", _MONTHLY)
def monthly(b):
    return R.monthly_summary(b.transactions).orderBy("date_time")


@query(
    "ag5_monthly_by_type",
    "transactions",
    f"SELECT type, {MONTH} AS date_time, COUNT(*) AS transaction_count, {SUM_AMOUNT} AS total_amount "
    "FROM transactions GROUP BY 1, 2",
)
def _(b):
    return R.monthly_summary(b.transactions, ["type"], average=False, extremes=False).orderBy("type", "date_time")


_LOCATION_MONTHLY = (
    f"SELECT location, {MONTH} AS date_time, COUNT(*) AS transaction_count, {SUM_AMOUNT} AS total_amount, "
    f"{AVG_AMOUNT} AS average_amount FROM transactions GROUP BY 1, 2"
)


@query("ag6_monthly_by_location", "transactions", _LOCATION_MONTHLY)
def _(b):
    return R.monthly_summary(b.transactions, ["location"], extremes=False).orderBy("location", "date_time")


@query(
    "ag7_channel_summary",
    "transactions",
    f"SELECT channel, COUNT(*) AS transaction_count, {SUM_AMOUNT} AS total_amount, "
    f"{AVG_AMOUNT} AS average_amount FROM transactions GROUP BY channel",
)
def _(b):
    return R.channel_summary(b.transactions)


_SHARE = f"""SELECT location, COUNT(*) AS transaction_count, {SUM_AMOUNT} AS total_amount,
 round(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM transactions) * 100, 4) AS percentage_of_total
 FROM transactions GROUP BY location ORDER BY transaction_count DESC, location LIMIT 10"""


@query("ag8_share_of_total", "transactions", _SHARE)
def _(b):
    return R.share_of_total(b.transactions, "location", 10)


ACCOUNT_STATS = f"""SELECT account_id, {AVG_AMOUNT} AS average_transaction, COUNT(amount) AS transaction_count,
 {SUM_AMOUNT} AS total_amount, MIN(amount) AS min_transaction, MAX(amount) AS max_transaction,
 round(stddev_samp(amount), 4) AS transaction_std_dev FROM transactions GROUP BY account_id"""


@query("ag9_per_account_statistics", "transactions", ACCOUNT_STATS)
def _(b):
    return R.account_statistics(b.transactions)


@query(
    "jb4_per_account_stats_with_owner",
    "transactions accounts",
    f"SELECT s.*, a.customer_id FROM ({ACCOUNT_STATS}) s LEFT JOIN accounts a ON s.account_id = a.account_id",
)
def _(b):
    return R.with_owner(R.account_statistics(b.transactions), b.accounts)


@query("tk1_order_by", "transactions", f"{_LOCATION_MONTHLY} ORDER BY date_time, total_amount DESC, location")
def _(b):
    monthly_rows = R.monthly_summary(b.transactions, ["location"], extremes=False)
    return monthly_rows.orderBy("date_time", F.desc("total_amount"), "location")


@query(
    "tk2_top_n_rows", "transactions", f"{_MONTHLY} ORDER BY transaction_count DESC, date_time LIMIT 5"
)
def _(b):
    return K.top_rows(R.monthly_summary(b.transactions), [F.desc("transaction_count"), "date_time"], 5)


@query(
    "tk2_top_n_rows_by_amount", "transactions", f"{_MONTHLY} ORDER BY total_amount DESC, date_time LIMIT 5"
)
def _(b):
    return K.top_rows(R.monthly_summary(b.transactions), [F.desc("total_amount"), "date_time"], 5)


@query(
    "tk5_head",
    "transactions",
    f"SELECT * FROM ({ACCOUNT_STATS}) ORDER BY account_id LIMIT 5",
)
def _(b):
    return K.top_rows(R.account_statistics(b.transactions), ["account_id"], 5)


@query(
    "jb2_transaction_report",
    "transactions",
    f"""WITH m AS ({_MONTHLY}),
 l AS ({_LOCATION_MONTHLY}),
 t AS (SELECT type, {MONTH} AS date_time, COUNT(*) AS n, {SUM_AMOUNT} AS s FROM transactions GROUP BY 1, 2),
 c AS (SELECT channel, COUNT(*) AS n, {SUM_AMOUNT} AS s FROM transactions GROUP BY 1)
 SELECT 'monthly' AS report, date_time AS key1, CAST(NULL AS VARCHAR) AS key2,
   transaction_count, total_amount FROM m
 UNION ALL SELECT 'monthly_by_type', date_time, type, n, s FROM t
 UNION ALL SELECT 'monthly_by_location', date_time, location, transaction_count, total_amount FROM l
 UNION ALL SELECT 'channel', channel, NULL, n, s FROM c
 UNION ALL SELECT 'top_locations', location, NULL, transaction_count, total_amount FROM ({_SHARE})
 UNION ALL SELECT 'peak_months', date_time, NULL, transaction_count, total_amount
   FROM (SELECT * FROM m ORDER BY transaction_count DESC, date_time LIMIT 5)
 UNION ALL SELECT 'highest_revenue_months', date_time, NULL, transaction_count, total_amount
   FROM (SELECT * FROM m ORDER BY total_amount DESC, date_time LIMIT 5)""",
)
def _(b):
    from bankspark.plans.jobs import transaction_report

    return transaction_report(b.transactions)
