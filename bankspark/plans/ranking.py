"""Peak months, top locations and other ranked results."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark.operators import ranking as K
from bankspark.operators import reports as R
from bankspark.plans.registry import query
from bankspark.plans.reports import MONTH, SUM_AMOUNT

# Check side: the extreme values of each location first, then the months that have them.
_MONTHS = f"""WITH per_month AS (
  SELECT location, {MONTH} AS month, COUNT(*) AS n, {SUM_AMOUNT} AS total FROM transactions GROUP BY ALL),
extremes AS (
  SELECT location, max(n) AS most, min(n) AS fewest, max(total) AS highest, min(total) AS lowest
  FROM per_month GROUP BY location)
"""


def peak_and_least_sql(more: str = "") -> str:
    """Twin of the peak and least months; of several months with the same value the latest counts."""
    return _MONTHS + f"""SELECT e.location,{more}
  (SELECT max(month) FROM per_month p WHERE p.location IS NOT DISTINCT FROM e.location AND n = most) AS peak_transaction_month,
  most AS peak_transaction_count,
  (SELECT max(month) FROM per_month p WHERE p.location IS NOT DISTINCT FROM e.location AND n = fewest) AS least_transaction_month,
  fewest AS least_transaction_count,
  (SELECT max(month) FROM per_month p WHERE p.location IS NOT DISTINCT FROM e.location AND total = highest) AS peak_amount_month,
  highest AS peak_total_amount,
  (SELECT max(month) FROM per_month p WHERE p.location IS NOT DISTINCT FROM e.location AND total = lowest) AS least_amount_month,
  lowest AS least_total_amount
FROM extremes e"""


PEAK_AND_LEAST = peak_and_least_sql()


@query("wn1_peak_least_month", "transactions", PEAK_AND_LEAST)
def peak_and_least(b):
    return K.peak_and_least_months(b.transactions)


_FIRST_PEAK = _MONTHS + """SELECT e.location,
  (SELECT min(month) FROM per_month p WHERE p.location IS NOT DISTINCT FROM e.location AND n = most) AS peak_transaction_month,
  most AS max_transactions,
  (SELECT min(month) FROM per_month p WHERE p.location IS NOT DISTINCT FROM e.location AND total = highest) AS peak_amount_month,
  highest AS max_total_amount
FROM extremes e"""


@query("wn2_peak_month_idxmax", "transactions", _FIRST_PEAK)
def _(b):
    return K.first_peak_months(b.transactions)


@query("jn7_join_of_two_group_maxima", "transactions", _FIRST_PEAK)
def _(b):
    monthly = R.monthly_summary(b.transactions, ["location"], average=False, extremes=False)
    month, n, total = F.col("date_time"), F.col("transaction_count"), F.col("total_amount")
    by_count = monthly.groupBy("location").agg(
        F.min_by(month, F.struct(-n, month)).alias("peak_transaction_month"), F.max(n).alias("max_transactions")
    )
    by_amount = monthly.groupBy("location").agg(
        F.min_by(month, F.struct(-total, month)).alias("peak_amount_month"),
        F.max(total).alias("max_total_amount"),
    )
    return by_count.join(by_amount, "location")


@query(
    "tk3_top_n_with_ties",
    "transactions",
    """SELECT location, n FROM (SELECT location, n, RANK() OVER (ORDER BY n DESC) AS place FROM (
  SELECT COALESCE(location, 'Unknown') AS location, COUNT(*) AS n FROM transactions GROUP BY 1)) WHERE place <= 20""",
)
def _(b):
    known = b.transactions.withColumn("location", F.coalesce("location", F.lit("Unknown")))
    return K.top_with_ties(R.value_counts(known, "location", "n"), "n", 20)


@query(
    "tk4_most_least_active",
    "transactions",
    """WITH g AS (SELECT location, COUNT(*) AS n FROM transactions GROUP BY 1)
SELECT (SELECT location FROM g ORDER BY n DESC, location LIMIT 1) AS most_active,
  (SELECT MAX(n) FROM g) AS most_count,
  (SELECT location FROM g ORDER BY n, location LIMIT 1) AS least_active,
  (SELECT MIN(n) FROM g) AS least_count""",
)
def _(b):
    return K.extremes(R.value_counts(b.transactions, "location", "n"), "location", "n")


@query(
    "wn5_percent_of_whole",
    "campaign_responses",
    """SELECT responded, COUNT(*) AS count, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () * 100 AS percentage
FROM campaign_responses GROUP BY responded""",
)
def _(b):
    return K.with_share(
        R.value_counts(b.campaign_responses, "responded", keep_null=True), "count", "percentage"
    )
