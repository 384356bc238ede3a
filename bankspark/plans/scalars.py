"""Projections, filters, scalar expressions, reshaping and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions import dates as D
from bankspark.functions import numbers as N
from bankspark.functions import text as X
from bankspark.operators import columns as L
from bankspark.operators import reports as R
from bankspark.operators import sampling as S
from bankspark.operators.quantiles import exact_quantiles
from bankspark.plans.registry import query
from bankspark.sources.tables import VECTOR_SIZE
from bankspark.plans.reports import MONTH, SUM_AMOUNT


@query(
    "pj1_select_drop_columns",
    "customers",
    "SELECT customer_id, gender, age, marital_status, education_level, occupation, income, region FROM customers",
)
def _(b):
    # email and phone are dropped only where the table has them
    return L.drop_if_present(b.customers, "email", "phone", "name", "join_date", "nation")


@query("pj2_rename", "accounts", "SELECT account_id AS id, balance AS total_balance FROM accounts")
def _(b):
    return b.accounts.select("account_id", "balance").withColumnsRenamed(
        {"account_id": "id", "balance": "total_balance"}
    )


@query(
    "pj3_derive_columns",
    "loans",
    """SELECT loan_id, CAST(status = 'Defaulted' AS INTEGER) AS "default",
  loan_amount / term_months AS monthly_principal FROM loans""",
)
def _(b):
    return b.loans.select("loan_id", "status", "loan_amount", "term_months").withColumns(
        {
            "default": F.when(F.col("status") == "Defaulted", 1).otherwise(0),
            "monthly_principal": F.col("loan_amount") / F.col("term_months"),
        }
    ).select("loan_id", "default", "monthly_principal")


@query(
    "pj4_align_features",
    "loans",
    """SELECT loan_id, CAST(term_months AS DOUBLE) AS term_months, CAST(0 AS DOUBLE) AS risk_level_low,
  loan_amount FROM loans""",
)
def _(b):
    L.require_columns(b.loans, ["loan_id", "loan_amount"])
    return L.align_features(b.loans, ["term_months", "risk_level_low", "loan_amount"], keep=["loan_id"])


@query(
    "fl1_comparison_range_filter",
    "campaign_responses",
    "SELECT response_id, customer_id FROM campaign_responses WHERE responded = TRUE AND campaign_id BETWEEN 2 AND 5",
)
def _(b):
    rows = b.campaign_responses.filter(F.col("responded") & F.col("campaign_id").between(2, 5))
    return rows.select("response_id", "customer_id")


@query(
    "fl2_not_null_filter",
    "transactions",
    "SELECT account_id, merchant, COUNT(*) AS n FROM transactions WHERE merchant IS NOT NULL GROUP BY ALL",
)
def _(b):
    return b.transactions.filter(F.col("merchant").isNotNull()).groupBy("account_id", "merchant").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "fl3_drop_any_null_rows",
    "transactions_raw",
    "SELECT transaction_id, merchant, location FROM transactions_raw WHERE merchant IS NOT NULL AND location IS NOT NULL",
)
def _(b):
    return b.transactions_raw.select("transaction_id", "merchant", "location").dropna("any")


@query("fl4_keep_active_only", "accounts", "SELECT * FROM accounts WHERE status = 'Active'")
def _(b):
    return b.accounts.filter(F.col("status") == "Active")


@query(
    "fl5_having",
    "transactions",
    "SELECT account_id, COUNT(*) AS n FROM transactions GROUP BY account_id HAVING COUNT(*) > 10",
)
def _(b):
    return b.transactions.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > V.MIN_LOCATION_TRANSACTIONS
    )


@query(
    "fl6_set_membership",
    "transactions_ev",
    """SELECT transaction_id, strftime(transaction_date, '%A') AS weekday FROM transactions_ev
WHERE strftime(transaction_date, '%a') IN ('Sat', 'Sun')""",
)
def _(b):
    when = F.col("transaction_date")
    return b.transactions_ev.filter(D.weekday_short(when).isin("Sat", "Sun")).select(
        "transaction_id", D.weekday_name(when).alias("weekday")
    )


@query(
    "sc4_fill_numeric_with_0",
    "accounts transactions",
    f"""SELECT account_id, COALESCE(a.balance, 0) AS balance, COALESCE(t.total, 0) AS total FROM accounts a
LEFT JOIN (SELECT account_id, {SUM_AMOUNT} AS total FROM transactions GROUP BY 1) t USING (account_id)""",
)
def _(b):
    totals = R.sum_by(b.transactions, "account_id", "amount", "total")
    joined = b.accounts.select("account_id", "balance").join(totals, "account_id", "left")
    return L.fill_numeric(joined)


@query(
    "sc6_parse_yes_like_flag",
    "campaign_responses",
    "SELECT response_id, CAST(responded AS INTEGER) AS responded_flag FROM campaign_responses",
)
def _(b):
    words = F.element_at(
        F.array(*map(F.lit, [" TRUE", "yes ", "1"])), (F.col("response_id") % 3 + 1).cast("int")
    )
    spelled = b.campaign_responses.withColumn("answer", F.when(F.col("responded"), words).otherwise("No"))
    return spelled.select("response_id", X.yes_flag(F.col("answer")).alias("responded_flag"))


@query(
    "sc7_map_code_to_label",
    "campaign_responses",
    """SELECT response_id, CASE WHEN responded THEN 'Responded' ELSE 'No Response' END AS responded_status
FROM campaign_responses""",
)
def _(b):
    return b.campaign_responses.select(
        "response_id",
        X.label_of(X.yes_flag(F.col("responded")), V.RESPONSE_LABELS).alias("responded_status"),
    )


@query(
    "sc8_case_when",
    "scored",
    """SELECT row_id, CASE WHEN label = 1 AND prob > 0.5 THEN 'True Positive' WHEN label = 0 AND prob > 0.5
  THEN 'False Positive' WHEN label = 1 AND prob <= 0.5 THEN 'False Negative' ELSE 'True Negative' END AS outcome
FROM scored""",
)
def _(b):
    from bankspark.ml.metrics import outcome

    return b.scored.select(
        "row_id", outcome(F.col("label"), (F.col("prob") > 0.5).cast("int")).alias("outcome")
    )


@query("sc9_parse_date_one_format", "customers", "SELECT customer_id, join_date FROM customers")
def _(b):
    text = b.customers.select("customer_id", F.col("join_date").cast("string").alias("text"))
    return text.select("customer_id", D.parse_date(F.col("text"), "yyyy-MM-dd").alias("join_date"))


@query(
    "sc10_parse_date_several_formats",
    "campaigns customers",
    "SELECT campaign_id, start_date, end_date FROM campaigns "
    "UNION ALL SELECT customer_id, join_date, join_date FROM customers",
)
def _(b):
    # campaign costs spell dates M/d/yyyy, the other tables yyyy-MM-dd
    slashed = b.campaigns.select(
        "campaign_id",
        F.date_format("start_date", "M/d/yyyy").alias("start"),
        F.date_format("end_date", "M/d/yyyy").alias("end"),
    )
    dashed = b.customers.select("customer_id", F.col("join_date").cast("string"), F.col("join_date").cast("string"))
    formats = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    return slashed.union(dashed).select(
        "campaign_id",
        D.parse_date(F.col("start"), *formats).alias("start_date"),
        D.parse_date(F.col("end"), *formats).alias("end_date"),
    )


@query(
    "sc11_date_parts",
    "transactions_ev",
    """SELECT transaction_id, CAST(hour(transaction_date) AS INTEGER) AS hour,
  strftime(transaction_date, '%A') AS weekday, strftime(transaction_date, '%a') AS day_of_week,
  CAST(strftime(transaction_date, '%a') IN ('Sat', 'Sun') AS INTEGER) AS is_weekend FROM transactions_ev""",
)
def _(b):
    when = F.col("transaction_date")
    return b.transactions_ev.select(
        "transaction_id", F.hour(when).alias("hour"), D.weekday_name(when).alias("weekday"),
        D.weekday_short(when).alias("day_of_week"), D.is_weekend(when).alias("is_weekend"),
    )


@query(
    "sc12_month_key", "transactions_ev", f"SELECT transaction_id, {MONTH} AS month FROM transactions_ev"
)
def _(b):
    return b.transactions_ev.select("transaction_id", D.month_key(F.col("transaction_date")).alias("month"))


AS_OF = "2001-11-30"


@query(
    "sc13_date_difference",
    "accounts",
    f"SELECT account_id, CAST(date_diff('day', open_date, DATE '{AS_OF}') AS INTEGER) AS days_open FROM accounts",
)
def _(b):
    return b.accounts.select("account_id", D.days_since(AS_OF, F.col("open_date")).alias("days_open"))


@query(
    "sc14_date_add",
    "loans",
    "SELECT loan_id, CAST(start_date + CAST(term_months * 30 AS INTEGER) AS DATE) AS end_date FROM loans",
)
def _(b):
    return b.loans.select("loan_id", D.loan_end(F.col("start_date"), F.col("term_months")).alias("end_date"))


@query(
    "sc15_log_transform",
    "transactions_ev",
    """SELECT transaction_id, round(ln(amount + 1), 6) AS log_amount, round(ln(amount + 1) * 2, 6) AS marker_radius
FROM transactions_ev""",
)
def _(b):
    log = N.log_amount(F.col("amount"))
    return b.transactions_ev.select(
        "transaction_id", F.round(log, 6).alias("log_amount"), F.round(log * 2, 6).alias("marker_radius")
    )


@query(
    "sc16_rounding_percent_label_text",
    "campaign_responses",
    """SELECT campaign_id, percent, CAST(campaign_id AS VARCHAR) || chr(10) || CAST(n AS VARCHAR) || ' (' ||
  CAST(percent AS VARCHAR) || '%)' AS label FROM (SELECT campaign_id, COUNT(*) AS n,
  CAST(round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM campaign_responses), 1) AS DOUBLE) AS percent
  FROM campaign_responses GROUP BY 1)""",
)
def _(b):
    from bankspark.operators.ranking import with_share

    counted = with_share(R.value_counts(b.campaign_responses, "campaign_id", "n"), "n", "share")
    percent = F.round("share", 1)
    return counted.select(
        "campaign_id", percent.alias("percent"),
        X.percent_label(F.col("campaign_id").cast("string"), F.col("n"), percent).alias("label"),
    )


def _bin_sql(column, edges, labels, low_op, high_op):
    whens = " ".join(
        f"WHEN {column} {low_op} {low} AND {column} {high_op} {high} THEN '{label}'"
        for low, high, label in zip(edges, edges[1:], labels)
    )
    return f"CASE {whens} END"


@query(
    "sc17_bin_left_closed",
    "customers",
    f"SELECT customer_id, {_bin_sql('age', V.AGE_EDGES, V.AGE_LABELS, '>=', '<')} AS age_group FROM customers",
)
def _(b):
    band = N.bin_left_closed(F.col("age"), V.AGE_EDGES, V.AGE_LABELS)
    return b.customers.select("customer_id", band.alias("age_group"))


@query(
    "sc18_bin_right_closed",
    "customers",
    f"SELECT customer_id, {_bin_sql('age', V.HEATMAP_AGE_EDGES, V.HEATMAP_AGE_LABELS, '>', '<=')} AS age_group "
    "FROM customers",
)
def _(b):
    band = N.bin_right_closed(F.col("age"), V.HEATMAP_AGE_EDGES, V.HEATMAP_AGE_LABELS)
    return b.customers.select("customer_id", band.alias("age_group"))


INCOME_BRACKET_SQL = """CASE WHEN income <= q[2] THEN 'Low' WHEN income <= q[3] THEN 'Medium-Low'
  WHEN income <= q[4] THEN 'Medium' WHEN income <= q[5] THEN 'Medium-High' ELSE 'High' END"""
INCOME_EDGES_SQL = "(SELECT quantile_cont(income, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM customers)"


@query(
    "sc19_quantile_bins",
    "customers",
    f"SELECT customer_id, {INCOME_BRACKET_SQL} AS income_bracket FROM customers, {INCOME_EDGES_SQL}",
)
def _(b):
    edges = exact_quantiles(b.customers, "income", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    bracket = N.bin_right_closed(F.col("income"), edges, V.INCOME_BRACKETS, include_lowest=True)
    return b.customers.select("customer_id", bracket.alias("income_bracket"))


@query(
    "sc22_risk_tier_from_score",
    "credit_scores",
    "SELECT score_id, risk_level FROM credit_scores",
)
def _(b):
    return b.credit_scores.select("score_id", N.risk_tier(F.col("score")).alias("risk_level"))


@query(
    "sc23_clip",
    "credit_scores",
    "SELECT score_id, LEAST(850, GREATEST(300, score * 2 - 400)) AS score FROM credit_scores",
)
def _(b):
    return b.credit_scores.select("score_id", N.clip(F.col("score") * 2 - 400, 300, 850).alias("score"))


_HASH = "(({0} % 2147483647) * 2654435761 + {1}) % 1000003"


def split_sql(table: str, key: str, label: str | None, seed: int, share: float, cut: str = "floor") -> str:
    """Check SQL of :func:`split_flag`: rank by hash within the label."""
    part = f"PARTITION BY {label}" if label else ""
    return (
        f"SELECT *, ROW_NUMBER() OVER ({part} ORDER BY {_HASH.format(key, seed)}, {key}) "
        f"<= {cut}(COUNT(*) OVER ({part}) * CAST({share} AS DOUBLE)) AS is_train FROM {table}"
    )


@query(
    "sp1_random_split",
    "loans",
    f"SELECT loan_id, is_train FROM ({split_sql('loans', 'loan_id', None, 123, 0.8)})",
)
def _(b):
    return S.split_flag(b.loans.select("loan_id"), "loan_id", 0.8, 123)


@query(
    "sp2_stratified_split",
    "scored",
    f"SELECT row_id, label, is_train FROM ({split_sql('scored', 'row_id', 'label', 123, 0.8)})",
)
def _(b):
    return S.split_flag(b.scored.select("row_id", "label"), "row_id", 0.8, 123, ["label"])


@query(
    "sp2_stratified_split_rounded_up",
    "campaign_responses",
    "SELECT response_id, responded, is_train FROM ("
    + split_sql("campaign_responses", "response_id", "responded", 123, 0.7, "ceil")
    + ")",
)
def _(b):
    rows = b.campaign_responses.select("response_id", "responded")
    return S.split_flag(rows, "response_id", 0.7, 123, ["responded"], round_up=True)


@query(
    "sp3_a_b_assignment",
    "campaign_responses",
    f"""SELECT response_id, CASE WHEN {_HASH.format('response_id', 123)} > 500001 THEN 'A' ELSE 'B' END AS "group"
FROM campaign_responses""",
)
def _(b):
    return b.campaign_responses.select("response_id", S.ab_group(F.col("response_id"), 123).alias("group"))


@query(
    "sp4_sample_n_rows",
    "customers",
    f"SELECT customer_id, income FROM customers ORDER BY {_HASH.format('customer_id', 123)}, customer_id LIMIT 500",
)
def _(b):
    return S.sample_rows(b.customers.select("customer_id", "income"), "customer_id", 500, 123)


@query(
    "st_u1_stack_rows",
    "scored",
    f"SELECT row_id, label, prob FROM ({split_sql('scored', 'row_id', 'label', 123, 0.8)}) WHERE is_train",
)
def _(b):
    # the strata are split apart, cut, and stacked again
    strata = [
        S.split_flag(b.scored.filter(F.col("label") == label), "row_id", 0.8, 123).filter("is_train")
        for label in (0, 1)
    ]
    return strata[0].unionByName(strata[1]).drop("is_train")


@query("st_u3_distinct_values", "transactions", "SELECT DISTINCT location FROM transactions")
def _(b):
    return b.transactions.select("location").distinct()


@query(
    "st_u5_long_to_wide",
    "customers",
    """SELECT region, COUNT(*) FILTER (gender = 'Male') AS male, COUNT(*) FILTER (gender = 'Female') AS female,
  COUNT(*) FILTER (gender = 'Other') AS other FROM customers GROUP BY region""",
)
def _(b):
    counts = b.customers.groupBy("region").pivot("gender", V.GENDERS).count().fillna(0)
    return counts.withColumnsRenamed({g: g.lower() for g in V.GENDERS})


@query(
    "st_u6_wide_to_long",
    "vectors",
    " UNION ALL ".join(f"SELECT vec_id, 'v{i}' AS feature, v{i} AS value FROM vectors" for i in range(1, VECTOR_SIZE + 1)),
)
def _(b):
    return L.wide_to_long(b.vectors, ["vec_id"], [f"v{i}" for i in range(1, VECTOR_SIZE + 1)], "feature", "value")
