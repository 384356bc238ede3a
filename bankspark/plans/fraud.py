"""Fraud queries on rule flags and labelled alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.ml import metrics as M
from bankspark.operators import fraud as D
from bankspark.operators.cleaning import clean_transactions
from bankspark.plans.cleaning import CLEANED
from bankspark.plans.registry import query
from bankspark.plans.reports import AVG_AMOUNT, SUM_AMOUNT


def _mode_sql(expr: str, name: str) -> str:
    return f"""(SELECT account_id, v AS {name} FROM (SELECT account_id, {expr} AS v,
  ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY COUNT(*) DESC, {expr}) AS r
  FROM transactions_ev WHERE {expr} IS NOT NULL GROUP BY account_id, {expr}) WHERE r = 1)"""


_HOUR = "CAST(hour(transaction_date) AS INTEGER)"
PATTERNS = f"""SELECT * FROM (SELECT account_id, {AVG_AMOUNT} AS avg_amount, stddev_samp(amount) AS std_amount
  FROM transactions_ev GROUP BY account_id)
LEFT JOIN {_mode_sql('type', 'most_common_type')} USING (account_id)
LEFT JOIN {_mode_sql('channel', 'preferred_channel')} USING (account_id)
LEFT JOIN {_mode_sql(_HOUR, 'usual_hour')} USING (account_id)
LEFT JOIN {_mode_sql('merchant', 'top_merchant')} USING (account_id)
LEFT JOIN {_mode_sql('location', 'top_location')} USING (account_id)"""
_PATTERNS_ROUNDED = f"SELECT * REPLACE (round(std_amount, 4) AS std_amount) FROM ({PATTERNS})"


def _patterns(b):
    return D.usual_patterns(b.transactions_ev).withColumn("std_amount", F.round("std_amount", 4))


query("ag10_usual_patterns", "transactions_ev", _PATTERNS_ROUNDED)(_patterns)


@query(
    "jb15_usual_patterns",
    "transactions_raw",
    CLEANED + f"SELECT * FROM ({_PATTERNS_ROUNDED.replace('transactions_ev', 'cleaned')})",
)
def _(b):
    # the job: clean the raw rows first, then learn the patterns
    patterns = D.usual_patterns(clean_transactions(b.transactions_raw))
    return patterns.withColumn("std_amount", F.round("std_amount", 4))


_SINCE = """SELECT *, date_diff('microsecond', LAG(transaction_date) OVER (PARTITION BY account_id
  ORDER BY transaction_date, transaction_id), transaction_date) / 3.6e9 AS time_since_last FROM transactions_ev"""


@query(
    "wn3_time_since_last",
    "transactions_ev",
    f"SELECT transaction_id, account_id, time_since_last FROM ({_SINCE})",
)
def _(b):
    return D.time_since_last(b.transactions_ev).select(
        "transaction_id", "account_id", "time_since_last"
    )


FLAGGED = f"""WITH patterns AS ({PATTERNS}),
flags AS (SELECT t.*, {_HOUR} AS hour,
  CAST(amount > avg_amount + 3 * std_amount AS INTEGER) AS amount_anomaly,
  CAST(type <> most_common_type AS INTEGER) AS type_anomaly,
  CAST(channel <> preferred_channel AS INTEGER) AS channel_anomaly,
  CAST(abs({_HOUR} - usual_hour) > 4 AS INTEGER) AS time_anomaly,
  CAST(location <> top_location AS INTEGER) AS location_anomaly
  FROM transactions_ev t LEFT JOIN patterns USING (account_id)),
summed AS (SELECT *, amount_anomaly + type_anomaly + channel_anomaly + time_anomaly + location_anomaly
  AS combined_anomaly_score FROM flags),
flagged AS (SELECT *, CAST(combined_anomaly_score >= 3 AS INTEGER) AS fraud_flag FROM summed)
"""


def flagged_query(name: str, sql: str):
    return query(name, "transactions_ev", FLAGGED + sql)


_FLAG_LIST = ", ".join(D.RULE_FLAGS)


@flagged_query("ml5_rule_flags", f"SELECT transaction_id, {_FLAG_LIST} FROM flagged")
def _(b):
    return D.rule_scored(b.transactions_ev).select("transaction_id", *D.RULE_FLAGS)


@flagged_query(
    "ml6_combined_score_and_flag", "SELECT transaction_id, combined_anomaly_score, fraud_flag FROM flagged"
)
def _(b):
    return D.rule_scored(b.transactions_ev).select("transaction_id", "combined_anomaly_score", "fraud_flag")


@flagged_query(
    "ml7_fraud_intensity",
    "SELECT transaction_id, amount * combined_anomaly_score AS fraud_intensity FROM flagged WHERE fraud_flag = 1",
)
def _(b):
    risky = D.rule_scored(b.transactions_ev).filter(F.col("fraud_flag") == 1)
    return D.with_intensity(risky).select("transaction_id", "fraud_intensity")


@flagged_query(
    "jb13_fraud_rule_part",
    f"""SELECT f.transaction_id, f.account_id, f.hour, strftime(f.transaction_date, '%a') AS day_of_week,
  CAST(strftime(f.transaction_date, '%a') IN ('Sat', 'Sun') AS INTEGER) AS is_weekend, time_since_last,
  {_FLAG_LIST}, combined_anomaly_score, fraud_flag
FROM flagged f JOIN ({_SINCE}) s ON f.transaction_id = s.transaction_id""",
)
def _(b):
    rows = D.rule_scored(D.time_since_last(b.transactions_ev))
    return rows.select(
        "transaction_id", "account_id", "hour", "day_of_week", "is_weekend", "time_since_last",
        *D.RULE_FLAGS, "combined_anomaly_score", "fraud_flag",
    )


@query(
    "ml3_top_1_flag",
    "transactions_ev",
    """SELECT transaction_id, CAST(amount > (SELECT quantile_cont(amount, 0.99) FROM transactions_ev) AS INTEGER)
  AS top_amount FROM transactions_ev""",
)
def _(b):
    return D.top_share_flag(b.transactions_ev, "amount", "top_amount").select("transaction_id", "top_amount")


@flagged_query(
    "ag32_daily_fraud_series",
    f"""SELECT CAST(transaction_date AS DATE) AS date, {SUM_AMOUNT} AS total_amount, {AVG_AMOUNT} AS avg_amount,
  CAST(SUM(fraud_flag) AS BIGINT) AS fraud_count FROM flagged GROUP BY 1""",
)
def _(b):
    return D.daily_series(D.rule_scored(b.transactions_ev))


_FRAUD_AMOUNT = "CAST(COALESCE(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (fraud_flag = 1), 0) AS DOUBLE)"


@flagged_query(
    "ag33_daily_fraud_summary",
    f"""SELECT CAST(transaction_date AS DATE) AS date, COUNT(*) AS total_transactions, {SUM_AMOUNT} AS total_amount,
  CAST(SUM(fraud_flag) AS BIGINT) AS fraud_cases, {_FRAUD_AMOUNT} AS fraud_amount FROM flagged GROUP BY 1""",
)
def _(b):
    return D.daily_summary(D.rule_scored(b.transactions_ev))


@flagged_query(
    "ag34_account_risk_profile",
    f"""SELECT account_id, COUNT(*) AS total_transactions, CAST(SUM(fraud_flag) AS BIGINT) AS fraud_count,
  CAST(SUM(fraud_flag) AS DOUBLE) / COUNT(fraud_flag) AS fraud_ratio, {SUM_AMOUNT} AS total_amount,
  {_FRAUD_AMOUNT} AS fraud_amount FROM flagged GROUP BY account_id""",
)
def _(b):
    return D.account_risk(D.rule_scored(b.transactions_ev))


_LOCATION_RISK = f"""SELECT location, COUNT(*) AS transaction_count, CAST(SUM(fraud_flag) AS BIGINT) AS fraud_count,
  CAST(SUM(fraud_flag) AS DOUBLE) / COUNT(fraud_flag) AS fraud_rate, {AVG_AMOUNT} AS avg_amount
FROM flagged GROUP BY location HAVING COUNT(*) > 10"""


@flagged_query("ag35_location_risk", _LOCATION_RISK)
def _(b):
    return D.location_risk(D.rule_scored(b.transactions_ev))


_LABELLED = """labelled AS (SELECT t.*, COALESCE(is_fraud, FALSE) AS is_fraud FROM transactions_ev t
  LEFT JOIN fraud_alerts f ON t.transaction_id = f.transaction_id)"""


def _fraud_by_sql(key):
    return f"""WITH {_LABELLED} SELECT COALESCE({key}, 'Unknown') AS {key}, COUNT(*) AS total_transactions,
  COUNT(*) FILTER (is_fraud) AS fraud_count, 100.0 * COUNT(*) FILTER (is_fraud) / CAST(COUNT(*) AS DOUBLE)
  AS fraud_rate FROM labelled GROUP BY 1"""


@query("ag36_fraud_by_location_merchant", "transactions_ev fraud_alerts", _fraud_by_sql("location"))
def _(b):
    return D.fraud_by(D.with_alerts(b.transactions_ev, b.fraud_alerts), "location")


@query("ag36_fraud_by_merchant", "transactions_ev fraud_alerts", _fraud_by_sql("merchant"))
def _(b):
    return D.fraud_by(D.with_alerts(b.transactions_ev, b.fraud_alerts), "merchant")


@query(
    "ag37_fraud_by_date",
    "fraud_alerts",
    "SELECT fraud_date AS fraud_date_only, COUNT(*) AS fraud_count FROM fraud_alerts WHERE is_fraud GROUP BY 1",
)
def _(b):
    return D.fraud_by_date(b.fraud_alerts)


_KPI_AMOUNT = "CAST(SUM(CAST(amount AS DECIMAL(18,2))) FILTER (is_fraud) AS DOUBLE)"


@query(
    "ag38_fraud_kpi_row",
    "transactions_ev fraud_alerts",
    f"""WITH {_LABELLED} SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (is_fraud) AS total_fraud_cases,
  round(100.0 * COUNT(*) FILTER (is_fraud) / CAST(COUNT(*) AS DOUBLE), 2) AS fraud_rate_pct,
  {_KPI_AMOUNT} AS total_fraud_amount,
  round({_KPI_AMOUNT} / COUNT(*) FILTER (is_fraud), 2) AS average_fraud_amount,
  MAX(amount) FILTER (is_fraud) AS max_fraud_amount, MIN(amount) FILTER (is_fraud) AS min_fraud_amount
FROM labelled""",
)
def _(b):
    return D.fraud_kpis(D.with_alerts(b.transactions_ev, b.fraud_alerts))


@flagged_query(
    "ag39_dashboard_kpis",
    """SELECT COUNT(*) AS total_transactions, CAST(SUM(fraud_flag) AS BIGINT) AS fraud_cases,
  round(100.0 * SUM(fraud_flag) / CAST(COUNT(*) AS DOUBLE), 2) AS fraud_rate_pct FROM flagged""",
)
def _(b):
    return D.dashboard(D.rule_scored(b.transactions_ev))


# A city table with one place out of bounds and one without coordinates.
_CITIES = [
    (name, {"Monywa": 50.0, "Sittwe": None}.get(name, lat), lng) for name, lat, lng in V.CITY_COORDINATES
]
_CITY_VALUES = ", ".join(
    f"('{name}', CAST({'NULL' if lat is None else lat} AS DOUBLE), CAST({lng} AS DOUBLE))"
    for name, lat, lng in _CITIES
)


@flagged_query(
    "fl7_geo_bounds_leftovers",
    f"""SELECT transaction_id, f.location, lat, lng, COALESCE(lat BETWEEN 10 AND 28 AND lng BETWEEN 92 AND 101, FALSE)
  AS inside FROM flagged f LEFT JOIN (VALUES {_CITY_VALUES}) AS c(location, lat, lng) ON f.location = c.location
WHERE fraud_flag = 1""",
)
def _(b):
    cities = b.spark.createDataFrame(_CITIES, "location STRING, lat DOUBLE, lng DOUBLE")
    risky = D.rule_scored(b.transactions_ev).filter(F.col("fraud_flag") == 1)
    return D.locate(risky, F.broadcast(cities)).select("transaction_id", "location", "lat", "lng", "inside")


@query(
    "jb14_fraud_reports",
    "transactions_ev",
    FLAGGED
    + f"""SELECT 'daily' AS report, CAST(CAST(transaction_date AS DATE) AS VARCHAR) AS key, COUNT(*) AS transactions,
  CAST(SUM(fraud_flag) AS BIGINT) AS frauds, {SUM_AMOUNT} AS amount FROM flagged GROUP BY 2
UNION ALL SELECT 'account', CAST(account_id AS VARCHAR), COUNT(*), CAST(SUM(fraud_flag) AS BIGINT), {SUM_AMOUNT}
  FROM flagged GROUP BY 2
UNION ALL SELECT 'location', location, COUNT(*), CAST(SUM(fraud_flag) AS BIGINT), {SUM_AMOUNT}
  FROM flagged GROUP BY 2 HAVING COUNT(*) > 10
UNION ALL SELECT 'all', 'all', COUNT(*), CAST(SUM(fraud_flag) AS BIGINT), {SUM_AMOUNT} FROM flagged""",
)
def _(b):
    from bankspark.plans.jobs import fraud_reports

    return fraud_reports(D.rule_scored(b.transactions_ev))


# --- metrics over given scores -------------------------------------------------------------------


@query(
    "wn6_average_rank",
    "scored",
    """SELECT prob, COUNT(*) AS n, MIN(r) + (COUNT(*) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM
  (SELECT prob, ROW_NUMBER() OVER (ORDER BY prob) AS r FROM scored) GROUP BY prob""",
)
def _(b):
    return M.average_ranks(b.scored, "prob")


AUC = """SELECT round((SUM(CASE WHEN label = 1 THEN r END) - p * (p + 1) / CAST(2 AS DOUBLE)) / (p * q), 9) AS auc
FROM (SELECT label, RANK() OVER (ORDER BY {s}) + (COUNT(*) OVER (PARTITION BY {s}) - 1) / CAST(2 AS DOUBLE) AS r,
  COUNT(*) FILTER (label = 1) OVER () AS p, CAST(COUNT(*) FILTER (label = 0) OVER () AS DOUBLE) AS q FROM {t})
GROUP BY p, q"""


@query("ml13_roc_auc", "scored", AUC.format(s="prob", t="scored"))
def _(b):
    return M.auc(b.scored, "label", "prob")


@query(
    "ml13_roc_points",
    "scored",
    """WITH t AS (SELECT DISTINCT prob FROM scored), n AS (SELECT CAST(COUNT(*) FILTER (label = 1) AS DOUBLE) AS p,
  CAST(COUNT(*) FILTER (label = 0) AS DOUBLE) AS q FROM scored)
SELECT t.prob AS threshold, COUNT(*) FILTER (s.label = 0) / ANY_VALUE(q) AS fpr,
  COUNT(*) FILTER (s.label = 1) / ANY_VALUE(p) AS tpr FROM t JOIN scored s ON s.prob >= t.prob, n GROUP BY t.prob""",
)
def _(b):
    return M.roc_points(b.scored, "label", "prob")


def confusion_sql(table: str, score: str = "prob", by: str = "") -> str:
    lead = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}n00, n10, n01, n11, round(CAST(n00 + n11 AS DOUBLE) / n, 9) AS accuracy,
  round(CAST(n00 AS DOUBLE) / (n00 + n01), 9) AS sensitivity, round(CAST(n11 AS DOUBLE) / (n10 + n11), 9) AS specificity,
  round((CAST(n00 + n11 AS DOUBLE) / n - e) / (1 - e), 9) AS kappa FROM (SELECT *,
  (CAST(n00 + n01 AS DOUBLE) * (n00 + n10) + CAST(n10 + n11 AS DOUBLE) * (n01 + n11)) / (CAST(n AS DOUBLE) * n) AS e
  FROM (SELECT {lead}COUNT(*) AS n, COUNT(*) FILTER (label = 0 AND {score} <= 0.5) AS n00,
    COUNT(*) FILTER (label = 1 AND {score} <= 0.5) AS n10, COUNT(*) FILTER (label = 0 AND {score} > 0.5) AS n01,
    COUNT(*) FILTER (label = 1 AND {score} > 0.5) AS n11 FROM {table}{tail}))"""


@query("ml14_confusion_matrix_and_metrics", "scored", confusion_sql("scored"))
def _(b):
    return M.confusion(b.scored, "label", "prob")


def _model_sql(name, table):
    return (
        f"SELECT '{name}' AS model, accuracy, sensitivity, specificity, auc "
        f"FROM ({confusion_sql(table)}), ({AUC.format(s='prob', t=table)})"
    )


@query(
    "ml21_model_comparison_table",
    "scored",
    "WITH flipped AS (SELECT row_id, label, 1 - prob AS prob FROM scored), "
    "halved AS (SELECT row_id, label, CASE WHEN row_id % 2 = 0 THEN prob ELSE 0.25 END AS prob FROM scored) "
    + " UNION ALL ".join([_model_sql("as_is", "scored"), _model_sql("flipped", "flipped"), _model_sql("halved", "halved")]),
)
def _(b):
    variants = {
        "as_is": F.col("prob"),
        "flipped": 1 - F.col("prob"),
        "halved": F.when(F.col("row_id") % 2 == 0, F.col("prob")).otherwise(0.25),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("prob")) for m, p in variants.items()])
    return M.compare_models(b.scored.select("label", F.inline(rows)), "model", "label", "prob")


@query(
    "ml22_error_analysis",
    "scored",
    """SELECT row_id, label, prob, CAST(prob > 0.5 AS INTEGER) AS predicted,
  CASE WHEN label = 0 THEN 'False Positive' ELSE 'False Negative' END AS classification
FROM scored WHERE (label = 1) <> (prob > 0.5)""",
)
def _(b):
    predicted = b.scored.withColumn("predicted", (F.col("prob") > 0.5).cast("int"))
    return M.errors_only(predicted, "label", "predicted")
