"""Churn, customer features and loan data queries."""

from __future__ import annotations

from bankspark.operators import customers as U
from bankspark.plans.registry import query
from bankspark.plans.reports import SUM_AMOUNT, SUM_BALANCE
from bankspark.plans.scalars import AS_OF

_LAST_TXN = f"""SELECT customer_id, MAX(CAST(transaction_date AS DATE)) AS last_transaction_date,
  CAST(date_diff('day', MAX(CAST(transaction_date AS DATE)), DATE '{AS_OF}') AS INTEGER) AS days_since_last_txn
FROM transactions LEFT JOIN accounts USING (account_id) GROUP BY customer_id"""


@query("ag19_last_transaction", "transactions accounts", _LAST_TXN)
def _(b):
    return U.last_transactions(b.transactions, b.accounts, AS_OF)


_CLOSED = "SELECT customer_id, bool_and(status = 'Closed') AS all_closed FROM accounts GROUP BY customer_id"
_KINDS = """SELECT customer_id, CAST(bool_or(account_type = 'Savings') AS INTEGER) AS has_savings,
  CAST(bool_or(account_type = 'Credit') AS INTEGER) AS has_credit,
  CAST(bool_or(account_type = 'Loan') AS INTEGER) AS has_loan_account,
  CAST(bool_or(account_type = 'Current') AS INTEGER) AS has_current FROM accounts GROUP BY customer_id"""


@query("ag20_all_any", "accounts", f"SELECT * FROM ({_CLOSED}) JOIN ({_KINDS}) USING (customer_id)")
def _(b):
    return U.all_closed(b.accounts).join(U.account_type_flags(b.accounts), "customer_id")


_LOANS = """SELECT customer_id, COUNT(*) AS total_loans, COUNT(*) FILTER (status = 'Defaulted') AS defaults,
  COUNT(*) FILTER (status = 'Paid') AS paid_loans, COUNT(*) FILTER (status = 'Approved') AS approved_loans
FROM loans GROUP BY customer_id"""


@query("ag21_conditional_count_sum", "loans", _LOANS)
def _(b):
    return U.loan_counts(b.loans)


_CHURN = f"""SELECT c.*, last_transaction_date, days_since_last_txn, all_closed,
  CASE WHEN days_since_last_txn IS NULL AND all_closed THEN 1
    WHEN days_since_last_txn IS NULL AND all_closed = FALSE THEN NULL
    WHEN days_since_last_txn > 90 AND all_closed THEN 1 ELSE 0 END AS churned
FROM customers c LEFT JOIN ({_LAST_TXN}) USING (customer_id) LEFT JOIN ({_CLOSED}) USING (customer_id)"""


@query("jb5_churn_label", "customers transactions accounts", _CHURN)
def churn(b):
    return U.churn_labels(b.customers, b.transactions, b.accounts, AS_OF)


@query(
    "wn4_latest_per_key_ties_kept",
    "credit_scores",
    """SELECT customer_id, score, risk_level, score_id FROM (SELECT *,
  RANK() OVER (PARTITION BY customer_id ORDER BY date_recorded DESC) AS r FROM credit_scores) WHERE r = 1""",
)
def _(b):
    return U.latest_scores(b.credit_scores)


FEATURES = f"""SELECT c.customer_id, age, income, score, COALESCE(total_loans, 0) AS total_loans,
  COALESCE(defaults, 0) AS defaults, COALESCE(paid_loans, 0) AS paid_loans,
  COALESCE(approved_loans, 0) AS approved_loans, COALESCE(total_balance, 0) AS total_balance,
  COALESCE(average_transaction, 0) AS average_transaction, COALESCE(has_savings, 0) AS has_savings,
  COALESCE(has_credit, 0) AS has_credit, COALESCE(has_loan_account, 0) AS has_loan_account,
  COALESCE(has_current, 0) AS has_current
FROM customers c
LEFT JOIN (SELECT customer_id, arg_max(score, (date_recorded, score_id)) AS score FROM credit_scores GROUP BY 1)
  USING (customer_id)
LEFT JOIN ({_LOANS}) USING (customer_id)
LEFT JOIN (SELECT customer_id, {SUM_BALANCE} AS total_balance FROM accounts GROUP BY 1) USING (customer_id)
LEFT JOIN (SELECT customer_id, {SUM_AMOUNT} / COUNT(*) AS average_transaction
  FROM transactions JOIN accounts USING (account_id) GROUP BY 1) USING (customer_id)
LEFT JOIN ({_KINDS}) USING (customer_id)"""


@query("jb6_customer_features", "customers credit_scores loans accounts transactions", FEATURES)
def features(b):
    return U.customer_features(b.customers, b.credit_scores, b.loans, b.accounts, b.transactions)


@query(
    "jb11_loan_default_dataset",
    "loans customers credit_scores",
    """SELECT loan_id, score_id, CASE WHEN status = 'Defaulted' THEN 1 ELSE 0 END AS "default", loan_amount,
  interest_rate, term_months, income, age, score, risk_level FROM loans
LEFT JOIN customers USING (customer_id)
LEFT JOIN (SELECT *, RANK() OVER (PARTITION BY customer_id ORDER BY date_recorded DESC) AS r
  FROM credit_scores) s USING (customer_id)
WHERE r = 1 AND score IS NOT NULL AND income IS NOT NULL""",
)
def loan_data(b):
    return U.loan_default_data(b.loans, b.customers, b.credit_scores)
