"""Campaign queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions import numbers as N
from bankspark.operators import campaign as C
from bankspark.operators.quantiles import exact_quantiles
from bankspark.plans.registry import query
from bankspark.plans.scalars import INCOME_BRACKET_SQL, INCOME_EDGES_SQL, _bin_sql

_MERGED = """merged AS (SELECT c.*, CASE WHEN responded THEN 1 ELSE 0 END AS flag FROM customers c
  LEFT JOIN campaign_responses r ON c.customer_id = r.customer_id)"""


@query(
    "ag17_overall_response_split",
    "customers campaign_responses",
    f"""WITH {_MERGED} SELECT CASE flag WHEN 1 THEN 'Responded' ELSE 'No Response' END AS responded_status,
  COUNT(customer_id) AS count, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () * 100 AS percentage
FROM merged GROUP BY flag""",
)
def _(b):
    return C.overall_split(b.customers, b.campaign_responses)


def _rate_sql(expr: str, name: str) -> str:
    return f"""WITH {_MERGED} SELECT {expr} AS {name}, CAST(SUM(1 - flag) AS BIGINT) AS no_response,
  CAST(SUM(flag) AS BIGINT) AS responded, COUNT(*) AS total,
  CAST(SUM(flag) AS DOUBLE) / COUNT(*) * 100 AS response_rate_pct FROM merged GROUP BY 1"""


def _register_rates():
    for dimension in ("region", "gender", "income"):
        name = "ag18_response_rate_by_dimension" + ("" if dimension == "region" else f"_{dimension}")

        @query(name, "customers campaign_responses", _rate_sql(dimension, dimension))
        def _(b, dimension=dimension):
            return C.response_rate_by(b.customers, b.campaign_responses, F.col(dimension), dimension)


_register_rates()

_AGE = _bin_sql("age", V.AGE_EDGES, V.AGE_LABELS, ">=", "<")


def _age_rates(b):
    band = N.bin_left_closed(F.col("age"), V.AGE_EDGES, V.AGE_LABELS)
    return C.response_rate_by_bands(b.customers, b.campaign_responses, band, V.AGE_LABELS, "age_group")


AGE_RATES = f"""WITH {_MERGED}, bands AS (SELECT unnest({V.AGE_LABELS}) AS age_group),
g AS (SELECT {_AGE} AS age_group, SUM(1 - flag) AS no, SUM(flag) AS yes FROM merged GROUP BY 1)
SELECT age_group, CAST(COALESCE(no, 0) AS BIGINT) AS no_response, CAST(COALESCE(yes, 0) AS BIGINT) AS responded,
  CAST(COALESCE(no, 0) + COALESCE(yes, 0) AS BIGINT) AS total,
  CAST(yes AS DOUBLE) / NULLIF(no + yes, 0) * 100 AS response_rate_pct
FROM bands LEFT JOIN g USING (age_group)"""

query("ag18_response_rate_by_dimension_age_group", "customers campaign_responses", AGE_RATES)(_age_rates)


@query(
    "ag22_response_history",
    "campaign_responses",
    """SELECT customer_id, CAST(SUM(responded::INT) AS BIGINT) AS total_responses, COUNT(*) AS total_campaigns,
  CAST(SUM(responded::INT) AS DOUBLE) / COUNT(*) AS response_rate FROM campaign_responses GROUP BY customer_id""",
)
def _(b):
    return C.response_history(b.campaign_responses)


_CHANNELS = ", ".join(
    f"COUNT(*) FILTER (channel = '{ch}') AS {C.column_name(ch)}" for ch in V.CAMPAIGN_CHANNELS
)
_CHANNEL_SQL = f"""SELECT customer_id, {_CHANNELS} FROM campaign_responses r
LEFT JOIN campaigns p ON r.campaign_id = p.campaign_id GROUP BY customer_id"""


@query("ag23_channel_counts_pivot", "campaign_responses campaigns", _CHANNEL_SQL)
def _(b):
    return C.channel_counts(b.campaign_responses, b.campaigns)


_HEAT_AGE = _bin_sql("age", V.HEATMAP_AGE_EDGES, V.HEATMAP_AGE_LABELS, ">", "<=")
_HEAT_RATES = ", ".join(
    f"COALESCE(CAST(SUM(responded::INT) FILTER (channel = '{ch}') AS DOUBLE) / "
    f"NULLIF(COUNT(*) FILTER (channel = '{ch}'), 0), 0.0) AS {C.column_name(ch)}"
    for ch in V.CAMPAIGN_CHANNELS
)


@query(
    "ag24_rate_pivot",
    "campaign_responses campaigns customers",
    f"""SELECT {_HEAT_AGE} AS age_group, {_HEAT_RATES} FROM campaign_responses r
LEFT JOIN campaigns p ON r.campaign_id = p.campaign_id
LEFT JOIN customers c ON r.customer_id = c.customer_id GROUP BY 1""",
)
def _(b):
    band = N.bin_right_closed(F.col("age"), V.HEATMAP_AGE_EDGES, V.HEATMAP_AGE_LABELS)
    return C.rate_by_band_and_channel(
        b.campaign_responses, b.campaigns, b.customers.select("customer_id", "age"), band, "age_group"
    )


_LAST = """SELECT customer_id, COUNT(*) AS last_campaign_contacts FROM campaign_responses
WHERE campaign_id = (SELECT campaign_id FROM campaigns ORDER BY end_date DESC, campaign_id LIMIT 1) GROUP BY 1"""


@query("ag25_last_campaign_contacts", "campaign_responses campaigns", _LAST)
def _(b):
    return C.last_campaign_contacts(b.campaign_responses, b.campaigns)


@query(
    "ag26_funnel",
    "customers campaign_responses",
    """WITH s AS (
  SELECT 'Reached' AS stage, COUNT(*) AS count FROM customers
  UNION ALL SELECT 'Opened', COUNT(DISTINCT customer_id) FROM campaign_responses
  UNION ALL SELECT 'Converted', COUNT(*) FROM customers WHERE customer_id IN
    (SELECT customer_id FROM campaign_responses WHERE responded)),
p AS (SELECT *, CAST(round(100.0 * count / (SELECT COUNT(*) FROM customers), 1) AS DOUBLE) AS percent FROM s)
SELECT *, stage || chr(10) || CAST(count AS VARCHAR) || ' (' || CAST(percent AS VARCHAR) || '%)' AS label FROM p""",
)
def _(b):
    return C.funnel(b.customers, b.campaign_responses)


_PAIRS = """merged AS (SELECT r.customer_id, t.channel, t.amount, t.location, t.transaction_date, t.account_id
  FROM campaign_responses r JOIN accounts a ON r.customer_id = a.customer_id
  JOIN transactions t ON t.account_id = a.account_id WHERE r.responded)"""
_PAIR_VIEWS = "campaign_responses accounts transactions"


@query(
    "ag27_two_level_mean",
    _PAIR_VIEWS,
    f"""WITH {_PAIRS} SELECT round(AVG(total), 4) AS average_revenue_per_response FROM
  (SELECT CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM merged GROUP BY customer_id)""",
)
def _(b):
    return C.revenue_stats(b.transactions, b.accounts, b.campaign_responses)


ROI = f"""SELECT campaign_id, responders, campaign_name, start_date, end_date, channel, cost_mmk,
  CAST(responders * {V.REVENUE_PER_RESPONSE} AS DOUBLE) AS total_revenue,
  CAST(responders * {V.REVENUE_PER_RESPONSE} - cost_mmk AS DOUBLE) / CAST(cost_mmk AS DOUBLE) AS roi
FROM campaigns JOIN (SELECT campaign_id, COUNT(*) AS responders FROM campaign_responses
  WHERE responded GROUP BY 1) USING (campaign_id)"""


@query("ag28_campaign_roi", "campaign_responses campaigns", ROI)
def _(b):
    return C.campaign_roi(b.campaign_responses, b.campaigns, V.REVENUE_PER_RESPONSE)


@query(
    "ag29_offer_summary",
    _PAIR_VIEWS,
    f"""WITH {_PAIRS} SELECT customer_id, channel,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent, COUNT(*) AS transactions,
  last(location ORDER BY transaction_date, account_id, amount, location) AS last_location
FROM merged GROUP BY customer_id, channel""",
)
def _(b):
    return C.offer_summary(b.transactions, b.accounts, b.campaign_responses)


@query(
    "ag30_a_b_group_stats",
    "campaign_responses",
    """SELECT "group", COUNT(*) AS total, CAST(SUM(responded::INT) AS BIGINT) AS responded,
  CAST(SUM(responded::INT) AS DOUBLE) / COUNT(*) AS response_rate FROM (SELECT responded,
  CASE WHEN ((response_id % 2147483647) * 2654435761 + 123) % 1000003 > 500001 THEN 'A' ELSE 'B' END AS "group"
  FROM campaign_responses) GROUP BY 1""",
)
def _(b):
    return C.ab_statistics(b.campaign_responses, 123)


@query(
    "ag31_quintile_conversion",
    "customers campaign_responses",
    f"""SELECT {INCOME_BRACKET_SQL} AS income_bracket, round(AVG(COALESCE(rate, 0)), 9) AS conversion_rate
FROM customers LEFT JOIN (SELECT customer_id, CAST(SUM(responded::INT) AS DOUBLE) / COUNT(*) AS rate
  FROM campaign_responses GROUP BY 1) USING (customer_id), {INCOME_EDGES_SQL} GROUP BY 1""",
)
def _(b):
    # conversion by bracket over any per-customer probability; here the historic response rate
    edges = exact_quantiles(b.customers, "income", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    bracket = N.bin_right_closed(F.col("income"), edges, V.INCOME_BRACKETS, include_lowest=True)
    rates = C.response_history(b.campaign_responses).select("customer_id", "response_rate")
    scored = b.customers.select("customer_id", "income").join(rates, "customer_id", "left").fillna(0.0)
    return C.mean_by_bracket(scored, bracket, "response_rate", "conversion_rate")


@query(
    "jb8_campaign_response_report",
    "customers campaign_responses",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, no_response, responded, total, "
        f"response_rate_pct FROM ({_rate_sql(d, d)})"
        for d in ("region", "gender")
    )
    + f" UNION ALL SELECT 'age_group', age_group, no_response, responded, total, response_rate_pct FROM ({AGE_RATES})"
    + f" UNION ALL SELECT 'income', CAST(CAST(income AS DECIMAL(18,2)) AS VARCHAR), no_response, responded, total, "
    f"response_rate_pct FROM ({_rate_sql('income', 'income')})"
    + f""" UNION ALL SELECT 'overall', 'all', CAST(SUM(1 - flag) AS BIGINT), CAST(SUM(flag) AS BIGINT), COUNT(*),
  CAST(SUM(flag) AS DOUBLE) / COUNT(*) * 100 FROM (WITH {_MERGED} SELECT * FROM merged)""",
)
def _(b):
    from bankspark.plans.jobs import campaign_report

    return campaign_report(b.customers, b.campaign_responses)


@query(
    "jb9_campaign_features",
    "customers campaign_responses campaigns",
    f"""SELECT c.*, COALESCE(total_responses, 0) AS total_responses, COALESCE(total_campaigns, 0) AS total_campaigns,
  COALESCE(response_rate, 0) AS response_rate,
  {", ".join(f"COALESCE({C.column_name(ch)}, 0) AS {C.column_name(ch)}" for ch in V.CAMPAIGN_CHANNELS)},
  COALESCE(last_campaign_contacts, 0) AS last_campaign_contacts,
  CASE WHEN total_responses > 0 THEN 1 ELSE 0 END AS responded
FROM customers c LEFT JOIN (SELECT customer_id, CAST(SUM(responded::INT) AS BIGINT) AS total_responses,
  COUNT(*) AS total_campaigns, CAST(SUM(responded::INT) AS DOUBLE) / COUNT(*) AS response_rate
  FROM campaign_responses GROUP BY customer_id) USING (customer_id)
LEFT JOIN ({_CHANNEL_SQL}) USING (customer_id) LEFT JOIN ({_LAST}) USING (customer_id)""",
)
def _(b):
    return C.campaign_features(b.customers, b.campaign_responses, b.campaigns)


@query(
    "jb10_campaign_roi_and_revenue",
    "campaign_responses accounts transactions campaigns",
    f"""WITH {_PAIRS}, rev AS (SELECT round(AVG(total), 4) AS r FROM
  (SELECT CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM merged GROUP BY customer_id))
SELECT campaign_id, responders, campaign_name, start_date, end_date, channel, cost_mmk,
  round(responders * r, 2) AS total_revenue, round((responders * r - cost_mmk) / cost_mmk, 6) AS roi
FROM rev, campaigns JOIN (SELECT campaign_id, COUNT(*) AS responders FROM campaign_responses
  WHERE responded GROUP BY 1) USING (campaign_id)""",
)
def _(b):
    # the measured revenue per responder feeds the ROI instead of a constant
    revenue = C.revenue_stats(b.transactions, b.accounts, b.campaign_responses).first()[0]
    roi = C.campaign_roi(b.campaign_responses, b.campaigns, revenue)
    return roi.withColumns({"total_revenue": F.round("total_revenue", 2), "roi": F.round("roi", 6)})
