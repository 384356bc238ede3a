"""Churn labels, customer features and the loan default data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions.dates import day_of, days_since
from bankspark.functions.numbers import as_money, cents_sum, money_sum


def last_transactions(transactions: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """Day of the last transaction per customer and the days from there to ``as_of``.

    The maximum is taken per account before accounts are joined.
    """
    per_account = transactions.groupBy("account_id").agg(
        F.max(day_of(F.col("transaction_date"))).alias("_last")
    )
    return (
        per_account.join(accounts.select("account_id", "customer_id"), "account_id", "left")
        .groupBy("customer_id")
        .agg(F.max("_last").alias("last_transaction_date"))
        .withColumn("days_since_last_txn", days_since(as_of, F.col("last_transaction_date")))
    )


def all_closed(accounts: DataFrame) -> DataFrame:
    """Per customer: are all accounts closed?"""
    return accounts.groupBy("customer_id").agg(
        F.bool_and(F.col("status") == "Closed").alias("all_closed")
    )


def account_type_flags(accounts: DataFrame) -> DataFrame:
    """Per customer: 0/1 for owning each kind of account."""
    kinds = {"has_savings": "Savings", "has_credit": "Credit", "has_loan_account": "Loan", "has_current": "Current"}
    return accounts.groupBy("customer_id").agg(
        *[F.bool_or(F.col("account_type") == kind).cast("int").alias(name) for name, kind in kinds.items()]
    )


def loan_counts(loans: DataFrame) -> DataFrame:
    """Loans per customer, in total and by outcome."""
    status = F.col("status")
    return loans.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.count_if(status == "Defaulted").alias("defaults"),
        F.count_if(status == "Paid").alias("paid_loans"),
        F.count_if(status == "Approved").alias("approved_loans"),
    )


def churn_labels(
    customers: DataFrame, transactions: DataFrame, accounts: DataFrame, as_of: str
) -> DataFrame:
    """Churned = 1 / 0 / unknown; the first rule that holds decides.

    No transaction and all closed: 1. No transaction and some open: unknown. Idle for more than
    90 days and all closed: 1. Everyone else, customers without any account too: 0.
    """
    idle, closed = F.col("days_since_last_txn"), F.col("all_closed")
    churned = (
        F.when(idle.isNull() & closed, 1)
        .when(idle.isNull() & ~closed, F.lit(None).cast("int"))
        .when((idle > V.CHURN_DAYS) & closed, 1)
        .otherwise(0)
    )
    return (
        customers.join(last_transactions(transactions, accounts, as_of), "customer_id", "left")
        .join(all_closed(accounts), "customer_id", "left")
        .withColumn("churned", churned)
    )


def latest_scores(credit_scores: DataFrame) -> DataFrame:
    """Scores of the latest day per customer, all of them when several fall on that day.

    A maximum per customer and a join back instead of a ranking window: a customer with very many
    scores is combined before the shuffle.
    """
    latest = credit_scores.groupBy("customer_id").agg(F.max("date_recorded").alias("date_recorded"))
    return credit_scores.join(latest, ["customer_id", "date_recorded"]).select(
        "customer_id", "score", "risk_level", "score_id"
    )


def one_score_each(credit_scores: DataFrame) -> DataFrame:
    """The latest score of each customer, the highest score id on a tie."""
    return credit_scores.groupBy("customer_id").agg(
        F.max_by("score", F.struct("date_recorded", "score_id")).alias("score")
    )


def customer_features(
    customers: DataFrame, credit_scores: DataFrame, loans: DataFrame, accounts: DataFrame, transactions: DataFrame
) -> DataFrame:
    """One row per customer for segmentation; counts and sums without a source are 0."""
    per_account = transactions.groupBy("account_id").agg(
        cents_sum(F.col("amount")).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    spending = (
        per_account.join(accounts.select("account_id", "customer_id"), "account_id")
        .groupBy("customer_id")
        .agg(F.try_divide(as_money(F.sum("_s")), F.sum("_n")).alias("average_transaction"))
    )
    holdings = accounts.groupBy("customer_id").agg(money_sum(F.col("balance")).alias("total_balance"))
    joined = customers.select("customer_id", "age", "income")
    for part in (
        one_score_each(credit_scores), loan_counts(loans), holdings, spending, account_type_flags(accounts)
    ):
        joined = joined.join(part, "customer_id", "left")
    filled = [c for c in joined.columns if c not in ("customer_id", "age", "income", "score")]
    return joined.fillna(0, subset=filled)


LOAN_FEATURES = ["loan_amount", "interest_rate", "term_months", "income", "age", "score", "risk_level"]


def loan_default_data(loans: DataFrame, customers: DataFrame, credit_scores: DataFrame) -> DataFrame:
    """Loans with customer and latest score, label 1 for a default; incomplete rows are dropped.

    A loan appears once per score of the latest day, as the join has it.
    """
    return (
        loans.join(customers.select("customer_id", "income", "age"), "customer_id", "left")
        .join(latest_scores(credit_scores), "customer_id", "left")
        .filter(F.col("score").isNotNull())
        .withColumn("default", F.when(F.col("status") == "Defaulted", 1).otherwise(0))
        .select("loan_id", "score_id", "default", *LOAN_FEATURES)
        .dropna("any")
    )
