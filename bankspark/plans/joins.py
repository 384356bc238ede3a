"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark.operators import joins as J
from bankspark.operators import reports as R
from bankspark.operators import sampling as S
from bankspark.plans.registry import query
from bankspark.plans.reports import SUM_BALANCE
from bankspark.plans.scalars import split_sql


@query(
    "jn1_inner_equi",
    "accounts customers",
    "SELECT account_id, a.customer_id, region, status FROM accounts a JOIN customers c ON a.customer_id = c.customer_id",
)
def _(b):
    return (
        b.accounts.select("account_id", "customer_id", "status")
        .join(b.customers.select("customer_id", "region"), "customer_id")
    )


@query(
    "jn2_left_equi",
    "customers campaign_responses",
    """SELECT c.customer_id, region, response_id, responded FROM customers c
LEFT JOIN campaign_responses r ON c.customer_id = r.customer_id""",
)
def _(b):
    return J.left_join_hot(
        b.customers.select("customer_id", "region"),
        b.campaign_responses.select("customer_id", "response_id", "responded"),
        "customer_id",
    )


@query(
    "jn3_left_chain_star",
    "campaign_responses campaigns customers",
    """SELECT response_id, r.campaign_id, r.customer_id, responded, channel, age, region FROM campaign_responses r
LEFT JOIN campaigns p ON r.campaign_id = p.campaign_id LEFT JOIN customers c ON r.customer_id = c.customer_id""",
)
def _(b):
    responses = b.campaign_responses.select("response_id", "campaign_id", "customer_id", "responded")
    return J.lookup_join(responses, b.campaigns.select("campaign_id", "channel"), "campaign_id").join(
        b.customers.select("customer_id", "age", "region"), "customer_id", "left"
    )


@query(
    "jn4_left_join_of_pre_aggregates",
    "customers accounts loans",
    f"""SELECT c.customer_id, total_balance, total_loans FROM customers c
LEFT JOIN (SELECT customer_id, {SUM_BALANCE} AS total_balance FROM accounts GROUP BY 1) a USING (customer_id)
LEFT JOIN (SELECT customer_id, COUNT(*) AS total_loans FROM loans GROUP BY 1) l USING (customer_id)""",
)
def _(b):
    balances = R.sum_by(b.accounts, "customer_id", "balance", "total_balance")
    loans = R.value_counts(b.loans, "customer_id", "total_loans")
    return b.customers.select("customer_id").join(balances, "customer_id", "left").join(loans, "customer_id", "left")


@query(
    "jn5_many_to_many_inner",
    "campaign_responses transactions accounts",
    """SELECT a.customer_id, COUNT(*) AS pairs, CAST(SUM(CAST(round(t.amount * 100) AS HUGEINT)) AS BIGINT) AS cents
FROM transactions t JOIN accounts a USING (account_id)
JOIN campaign_responses r ON a.customer_id = r.customer_id AND r.responded GROUP BY 1""",
)
def _(b):
    # the check side forms all pairs; here each transaction stands for its copies and sums multiply
    from bankspark.operators.campaign import transactions_of_responders

    joined = transactions_of_responders(b.transactions, b.accounts, b.campaign_responses)
    cents = F.round(F.col("amount") * 100).cast("bigint")
    return joined.groupBy("customer_id").agg(
        F.sum("response_count").alias("pairs"), F.sum(cents * F.col("response_count")).alias("cents")
    )


@query(
    "jn6_inner_small_side",
    "campaign_responses campaigns",
    """SELECT campaign_id, responders, campaign_name, cost_mmk FROM campaigns JOIN
  (SELECT campaign_id, COUNT(*) AS responders FROM campaign_responses WHERE responded GROUP BY 1) USING (campaign_id)""",
)
def _(b):
    responders = R.value_counts(b.campaign_responses.filter("responded"), "campaign_id", "responders")
    return responders.join(b.campaigns.select("campaign_id", "campaign_name", "cost_mmk"), "campaign_id")


@query(
    "jn8_cross_join",
    "campaigns customers",
    """SELECT age_from, channel, customers, campaigns FROM
  (SELECT CAST(age - age % 10 AS INT) AS age_from, COUNT(*) AS customers FROM customers GROUP BY 1)
  CROSS JOIN (SELECT channel, COUNT(*) AS campaigns FROM campaigns GROUP BY 1)""",
)
def _(b):
    # both sides are grouped first: ten-year age bands and channels, so the grid has a fixed size
    bands = b.customers.groupBy((F.col("age") - F.col("age") % 10).cast("int").alias("age_from")).agg(
        F.count("*").alias("customers")
    )
    channels = b.campaigns.groupBy("channel").agg(F.count("*").alias("campaigns"))
    return J.pair_all(bands, channels, "age_from", lanes=4)


@query(
    "jn9_complement_anti",
    "loans",
    f"SELECT loan_id, status FROM ({split_sql('loans', 'loan_id', None, 123, 0.8)}) WHERE NOT is_train",
)
def _(b):
    loans = b.loans.select("loan_id", "status")
    train = S.split_flag(loans, "loan_id", 0.8, 123).filter("is_train")
    return S.complement(loans, train, "loan_id")


@query(
    "jn10_name_collision",
    "customers",
    'SELECT customer_id, income AS "income.x", income * 2 AS "income.y" FROM customers',
)
def _(b):
    scored = b.customers.select("customer_id", "income")
    again = b.customers.select("customer_id", (F.col("income") * 2).alias("income"))
    return J.with_suffix(scored, ["customer_id"], ".x").join(
        J.with_suffix(again, ["customer_id"], ".y"), "customer_id"
    )


@query(
    "jn11_null_keys_match",
    "transactions_ev",
    """WITH m AS (SELECT merchant, COUNT(*) AS sold FROM transactions_ev GROUP BY merchant)
SELECT transaction_id, t.merchant, sold FROM transactions_ev t LEFT JOIN m ON t.merchant IS NOT DISTINCT FROM m.merchant""",
)
def _(b):
    sold = R.value_counts(b.transactions_ev, "merchant", "sold", keep_null=True)
    return J.null_safe_join(b.transactions_ev.select("transaction_id", "merchant"), sold, "merchant")
