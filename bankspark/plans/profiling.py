"""Profile reports of the account table."""

from __future__ import annotations

from bankspark.operators import profile as P
from bankspark.plans.registry import query
from bankspark.plans.reports import AVG_AMOUNT, SUM_BALANCE

_ACCOUNT_TYPES = {
    "account_id": "bigint", "customer_id": "bigint", "account_type": "string",
    "open_date": "date", "status": "string", "balance": "double",
}
_AVG_BALANCE = AVG_AMOUNT.replace("amount", "balance")


def _report(column, dtype, value, count):
    return (
        f"SELECT '{column}' AS \"column\", '{dtype}' AS dtype, '{value}' AS value, "
        f"CAST({count} AS DOUBLE) AS count FROM accounts"
    )


SCALAR = " UNION ALL ".join(
    _report("Balance", "double", name, expr)
    for name, expr in [
        ("Total Accounts", "COUNT(balance)"), ("Total Sum", SUM_BALANCE), ("Mean", _AVG_BALANCE),
        ("Median", "quantile_cont(balance, 0.5)"), ("Min", "MIN(balance)"), ("Max", "MAX(balance)"),
        ("Std Deviation", "round(stddev_samp(balance), 2)"),
    ]
)


@query("ag11_scalar_profile_of_one_column", "accounts", SCALAR)
def _(b):
    return P.scalar_profile(b.accounts, "balance", "Balance")


BANDS = " UNION ALL ".join(
    _report("Balance Range", "category", label, f"COUNT(*) FILTER (balance >= {low} AND balance < {high})")
    for label, low, high in [
        ("<5M", 0, 5000000), ("5M-10M", 5000000, 10000000), ("10M-20M", 10000000, 20000000),
        ("20M-50M", 20000000, 50000000), (">50M", 50000000, 100000000),
    ]
)


@query("ag12_banded_histogram", "accounts", BANDS)
def _(b):
    return P.banded_histogram(b.accounts, "balance")


_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS non_null_count, '{t}' AS dtype FROM accounts"
    for c, t in _ACCOUNT_TYPES.items()
)


@query("ag13_null_dtype_profile", "accounts", _NULLS)
def _(b):
    return P.null_profile(b.accounts)


_RAW_TYPES = {
    "transaction_id": "bigint", "account_id": "bigint", "transaction_date": "timestamp_ntz", "amount": "double",
    "type": "string", "channel": "string", "merchant": "string", "location": "string",
}


@query(
    "dq2_null_report",
    "transactions_raw",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT({c}) AS non_null_count, '{t}' AS dtype FROM transactions_raw"
        for c, t in _RAW_TYPES.items()
    ),
)
def _(b):
    return P.null_profile(b.transactions_raw)


DISTINCT = " UNION ALL ".join(
    [_report("Total Rows", "", "", "COUNT(*)")]
    + [
        _report(
            f"Unique Values in {c}", t, "", f"COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
        )
        for c, t in _ACCOUNT_TYPES.items()
    ]
)


@query("ag14_distinct_per_column", "accounts", DISTINCT)
def _(b):
    return P.distinct_profile(b.accounts)


_OWNED = "(SELECT customer_id, COUNT(*) AS k FROM accounts WHERE customer_id IS NOT NULL GROUP BY 1)"
COUNTS = f"""SELECT 'Customers with >1 Account' AS "column", 'bigint' AS dtype, '' AS value,
  CAST(COUNT(*) FILTER (k > 1) AS DOUBLE) AS count FROM {_OWNED}
UNION ALL SELECT 'Max Accounts by One Customer', 'bigint', '', CAST(MAX(k) AS DOUBLE) FROM {_OWNED}
UNION ALL SELECT 'Customers with X Accounts', 'bigint', CAST(k AS VARCHAR) || ' accounts',
  CAST(COUNT(*) AS DOUBLE) FROM {_OWNED} GROUP BY k"""


@query("ag15_count_of_counts", "accounts", COUNTS)
def _(b):
    return P.count_of_counts(b.accounts, "customer_id")


_CHOSEN = ["account_type", "status", "open_date", "customer_id", "balance"]
VALUES = " UNION ALL ".join(
    [_report("Total Accounts (account_id)", "bigint", "", "COUNT(DISTINCT account_id)")]
    + [
        f"SELECT '{c}', '{_ACCOUNT_TYPES[c]}', "
        + (f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)" if c == "balance" else f"CAST({c} AS VARCHAR)")
        + f", CAST(COUNT(*) AS DOUBLE) FROM accounts GROUP BY {c}"
        for c in _CHOSEN
    ]
)


@query("ag16_value_counts_of_chosen_columns", "accounts", VALUES)
def _(b):
    return P.value_profile(b.accounts, "account_id", _CHOSEN)


@query("st_u2_assemble_report_rows", "accounts", f"{SCALAR} UNION ALL {BANDS}")
def _(b):
    return P.scalar_profile(b.accounts, "balance", "Balance").unionByName(
        P.banded_histogram(b.accounts, "balance")
    )


@query(
    "jb1_account_report",
    "accounts customers",
    f"""{SCALAR} UNION ALL {BANDS} UNION ALL {DISTINCT} UNION ALL {COUNTS} UNION ALL {VALUES}
UNION ALL SELECT 'Status in ' || region, 'bigint', status, CAST(COUNT(*) AS DOUBLE)
  FROM accounts JOIN customers USING (customer_id) GROUP BY region, status
UNION ALL SELECT 'Balance in ' || region, 'double', status, {SUM_BALANCE}
  FROM accounts JOIN customers USING (customer_id) GROUP BY region, status""",
)
def _(b):
    from bankspark.plans.jobs import account_report

    return account_report(b.accounts, b.customers)


@query(
    "ag40_five_number_summary",
    "scored",
    """SELECT MIN(prob) AS min, quantile_cont(prob, 0.25) AS q1, quantile_cont(prob, 0.5) AS median,
  round(AVG(prob), 9) AS mean, quantile_cont(prob, 0.75) AS q3, MAX(prob) AS max FROM scored""",
)
def _(b):
    return P.five_numbers(b.scored, "prob")


@query(
    "io10_schema_report",
    "accounts",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, COUNT(*) AS rows, "
        f"CAST(MIN({c}) AS VARCHAR) AS lowest FROM accounts"
        for i, (c, t) in enumerate(_ACCOUNT_TYPES.items())
    ),
)
def _(b):
    return P.schema_report(b.accounts)
