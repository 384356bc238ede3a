"""Sources and sinks, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark.ml import anomaly as A
from bankspark.operators import fraud as D
from bankspark.operators import ranking as K
from bankspark.operators import reports as R
from bankspark.plans.fraud import FLAGGED
from bankspark.plans.ranking import peak_and_least_sql
from bankspark.plans.registry import query
from bankspark.plans.reports import SUM_AMOUNT
from bankspark.session import fresh_path
from bankspark.sources import files as S


@query("io1_read_csv_table", "accounts", "SELECT * FROM accounts")
def _(b):
    path = fresh_path(b.spark, "accounts-csv")
    S.write_csv(b.accounts, path)
    return S.read_bank_csv(b.spark, path, "accounts")


@query(
    "io2_sql_query",
    "transactions",
    f"""SELECT location, COUNT(*) AS transaction_count, {SUM_AMOUNT} AS total_amount FROM transactions
GROUP BY location ORDER BY transaction_count DESC, location LIMIT 10""",
)
def _(b):
    return S.read_query(
        b.spark,
        """SELECT location, COUNT(*) AS transaction_count,
  CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM {tx} GROUP BY location ORDER BY transaction_count DESC, location LIMIT 10""",
        tx=b.transactions,
    )


@query(
    "io3_write_csv",
    "transactions",
    "SELECT channel, COUNT(*) AS transaction_count FROM transactions GROUP BY channel",
)
def _(b):
    path = fresh_path(b.spark, "channels-csv")
    S.write_csv(R.value_counts(b.transactions, "channel", "transaction_count"), path)
    return S.read_csv(b.spark, path, "channel STRING, transaction_count BIGINT")


@query("io4_write_gzip", "transactions_ev", "SELECT * FROM transactions_ev")
def _(b):
    path = fresh_path(b.spark, "transactions-gz")
    S.write_gzip(b.transactions_ev, path)
    return S.read_bank_csv(b.spark, path, "transactions")



def _per_location(b):
    path = fresh_path(b.spark, "per-location")
    peaks = K.peak_and_least_months(b.transactions)
    S.write_per_key(peaks, "location", path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in peaks.schema)
    return S.read_csv(b.spark, path, schema + ", location_slug STRING")


_SLUG_SQL = peak_and_least_sql(" replace(lower(e.location), ' ', '_') AS location_slug,")
query("io5_write_per_key", "transactions", _SLUG_SQL)(_per_location)
query("jb3_peak_least_by_location", "transactions", _SLUG_SQL)(_per_location)


_RUN_DAY = "2025-05-10"


@query(
    "io6_write_dated_run",
    "transactions_ev",
    FLAGGED + f"SELECT transaction_id, fraud_flag, DATE '{_RUN_DAY}' AS run_date FROM flagged",
)
def _(b):
    path = fresh_path(b.spark, "dated-runs")
    rows = D.rule_scored(b.transactions_ev).select("transaction_id", "fraud_flag")
    S.write_dated_run(rows, path, _RUN_DAY)
    return b.spark.read.parquet(path)


@query(
    "io7_append_run_log",
    "transactions_ev",
    FLAGGED
    + """SELECT t AS timestamp, COUNT(*) AS records_processed, CAST(SUM(fraud_flag) AS BIGINT) AS fraud_cases_detected
FROM flagged, (VALUES (TIMESTAMP '2025-05-10 10:00:00'), (TIMESTAMP '2025-05-10 11:00:00')) AS v(t) GROUP BY t""",
)
def _(b):
    path = fresh_path(b.spark, "run-log")
    flagged = D.rule_scored(b.transactions_ev).select("fraud_flag")
    for when in ("2025-05-10 10:00:00", "2025-05-10 11:00:00"):
        S.append_run_log(flagged, path, when)
    return b.spark.read.parquet(path)


@query(
    "io8_append_table",
    "transactions_ev",
    """SELECT transaction_id, amount, 'v1.0' AS model_version FROM transactions_ev
UNION ALL SELECT transaction_id, amount, 'v1.1' FROM transactions_ev WHERE amount > 100""",
)
def _(b):
    path = fresh_path(b.spark, "appended")
    rows = b.transactions_ev.select("transaction_id", "amount")
    S.append_table(rows, path, model_version="v1.0")
    S.append_table(rows.filter(F.col("amount") > 100), path, model_version="v1.1")
    return b.spark.read.parquet(path)


@query("io9_save_model")
def _(b):
    # the isolation forest is a table of nodes; it is written, read back and used
    from bankspark.plans.models import _ISO, _iso_rows, fraud_forest

    path = fresh_path(b.spark, "isolation-forest")
    fraud_forest(b).write.parquet(path)
    forest = b.spark.read.parquet(path)
    return A.isolation_scores(forest, _iso_rows(b).select("transaction_id", *_ISO), _ISO)
