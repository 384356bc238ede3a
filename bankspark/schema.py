"""Explicit schemas of the logical bank tables."""

from __future__ import annotations

from bankspark import fixed_values as V


DDL = {
    "customers": "customer_id BIGINT, name STRING, gender STRING, date_of_birth DATE, age INT, "
    "marital_status STRING, education_level STRING, occupation STRING, income DOUBLE, region STRING, "
    "join_date DATE, email STRING, phone STRING",
    "accounts": "account_id BIGINT, customer_id BIGINT, account_type STRING, open_date DATE, "
    "status STRING, balance DOUBLE",
    "transactions": "transaction_id BIGINT, account_id BIGINT, transaction_date TIMESTAMP_NTZ, "
    "amount DOUBLE, type STRING, channel STRING, merchant STRING, location STRING",
    "loans": "loan_id BIGINT, customer_id BIGINT, loan_type STRING, loan_amount DOUBLE, "
    "interest_rate DOUBLE, term_months INT, start_date DATE, end_date DATE, status STRING",
    "credit_scores": "score_id BIGINT, customer_id BIGINT, score INT, date_recorded DATE, risk_level STRING",
    "campaigns": "campaign_id BIGINT, campaign_name STRING, start_date DATE, end_date DATE, channel STRING",
    "campaign_costs": "campaign_id BIGINT, campaign_name STRING, start_date STRING, end_date STRING, "
    "channel STRING, cost_mmk BIGINT",
    "campaign_responses": "response_id BIGINT, campaign_id BIGINT, customer_id BIGINT, "
    "response_date DATE, responded BOOLEAN",
    "fraud_alerts": "fraud_id BIGINT, transaction_id BIGINT, fraud_date DATE, is_fraud BOOLEAN",
    "live_transactions": "transaction_id BIGINT, account_id BIGINT, transaction_date TIMESTAMP, "
    "amount DOUBLE, type STRING, channel STRING, location STRING, fraud_score DOUBLE",
}

# Values each column may take; anything else is reported by the domain check.
DOMAINS = {
    "customers": {"gender": V.GENDERS, "marital_status": V.MARITAL_STATUSES},
    "accounts": {"account_type": V.ACCOUNT_TYPES, "status": V.ACCOUNT_STATUSES},
    "transactions": {"type": V.TRANSACTION_TYPES, "channel": V.TRANSACTION_CHANNELS},
    "loans": {"loan_type": V.LOAN_TYPES, "status": V.LOAN_STATUSES},
    "credit_scores": {"risk_level": V.RISK_LEVELS},
    "campaigns": {"channel": V.CAMPAIGN_CHANNELS},
}


def ddl(table: str) -> str:
    """The schema of a table as DDL text, the form ``spark.read.schema`` takes."""
    return DDL[table]
