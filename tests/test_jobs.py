"""Generator tolerances, CSV jobs from end to end, sinks and the live router."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.generate.bank import BankGenerator
from bankspark.plans.run import JOBS, Run
from bankspark.schema import ddl
from bankspark.session import fresh_path
from bankspark.sources import files
from bankspark.streaming import router


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("bank"))
    JOBS["generate"](Run(spark, "", out))
    costs = files.read_bank_csv(spark, f"{out}/campaigns.csv", "campaigns").select(
        "campaign_id", "campaign_name", F.date_format("start_date", "M/d/yyyy").alias("start_date"),
        F.date_format("end_date", "M/d/yyyy").alias("end_date"), "channel", F.lit(250000).alias("cost_mmk"),
    )
    files.write_csv(costs, f"{out}/campaign_costs.csv")
    return out


def read(spark, made, table):
    return files.read_bank_csv(spark, f"{made}/{table}.csv", table)


def test_generated_shares(spark, made):
    customers, accounts = read(spark, made, "customers"), read(spark, made, "accounts")
    assert customers.count() == 1000 and customers.select("customer_id").distinct().count() == 1000
    ages = customers.agg(F.min("age"), F.max("age")).first()
    assert ages[0] >= 17 and ages[1] <= 81
    n = accounts.count()
    assert 1350 < n < 1650 and accounts.select("account_id").distinct().count() == n
    active = accounts.filter("status = 'Active'").count() / n
    assert 0.80 < active < 0.90
    tx = read(spark, made, "transactions")
    per = tx.count() / accounts.filter("status = 'Active'").count()
    assert 19 < per < 21
    debit = tx.filter("type = 'Debit'")
    assert 0.57 < debit.count() / tx.count() < 0.63
    assert tx.filter("type = 'Credit' AND merchant IS NOT NULL").isEmpty()
    early = tx.join(accounts, "account_id").filter(F.col("transaction_date").cast("date") < F.col("open_date"))
    assert early.isEmpty() and tx.join(accounts.filter("status <> 'Active'"), "account_id", "left_semi").isEmpty()
    loans = read(spark, made, "loans")
    assert 250 < loans.count() < 350
    assert loans.filter("datediff(end_date, start_date) <> term_months * 30").isEmpty()
    scores = read(spark, made, "credit_scores")
    assert scores.filter("score < 300 OR score > 850").isEmpty() and 2700 < scores.count() < 3300
    tiers = scores.filter("risk_level <> CASE WHEN score > 700 THEN 'Low' WHEN score > 600 THEN 'Medium' ELSE 'High' END")
    assert tiers.isEmpty()
    answers = read(spark, made, "campaign_responses")
    assert answers.count() == 10000 and 4700 < answers.filter("responded").count() < 5300
    alerts = read(spark, made, "fraud_alerts")
    assert alerts.count() == tx.count()


def test_generator_does_not_depend_on_partitions(spark):
    g = BankGenerator(spark)
    a = g.customers(g.ids(300, "customer_id"))
    b = g.customers(g.ids(300, "customer_id").repartition(7))
    assert a.exceptAll(b).isEmpty()


FAST = [
    "clean_transactions", "account_report", "transaction_report", "location_peaks", "account_statistics",
    "usual_patterns", "campaign_response", "campaign_analysis", "churn", "fraud_label_reports", "campaign_models",
]


@pytest.mark.parametrize("name", FAST)
def test_job_writes_results(spark, made, tmp_path, name):
    JOBS[name](Run(spark, made, str(tmp_path), rounds=3))
    assert os.listdir(tmp_path)
    for result in os.listdir(tmp_path):
        assert not spark.read.option("header", True).csv(f"{tmp_path}/{result}").isEmpty(), result


def test_original_headers_and_cross_totals(spark, made, tmp_path):
    JOBS["campaign_response"](Run(spark, made, str(tmp_path)))
    ages = spark.read.option("header", True).csv(f"{tmp_path}/responses_by_age_group")
    assert ages.columns == ["age_group", "No Response", "Responded", "Total", "Response Rate (%)"]
    assert ages.agg(F.sum("Total")).first()[0] == 10000
    regions = sorted(os.listdir(f"{tmp_path}/responses_per_region"))
    assert [r for r in regions if r.startswith("region_slug=")] == [f"region_slug={x.lower()}" for x in sorted(V.LOCATIONS)]


def test_fraud_job(spark, made, tmp_path):
    JOBS["fraud_detection"](Run(spark, made, str(tmp_path)))
    JOBS["fraud_detection"](Run(spark, made, str(tmp_path)))  # the same day again
    n = read(spark, made, "transactions").count()
    assert spark.read.parquet(f"{tmp_path}/runs").count() == n  # the day was replaced
    log = spark.read.parquet(f"{tmp_path}/run_log")
    assert [r["records_processed"] for r in log.collect()] == [n, n]  # the log was appended
    flagged = spark.read.option("header", True).option("inferSchema", True).csv(
        f"{tmp_path}/flagged_transactions"
    )
    share = flagged.agg(F.avg("iso_anomaly_flag"), F.avg("ae_anomaly_flag")).first()
    assert 0.002 < share[0] <= 0.0101 and 0.002 < share[1] <= 0.0101


def test_roi_of_the_published_campaigns():
    # revenue and ROI follow from responders, cost and the constant
    responders, cost = 499, 450000
    revenue = responders * V.REVENUE_PER_RESPONSE
    assert revenue == 178834989248
    assert (revenue - cost) / cost == pytest.approx(397410.087217778)


def _live(spark, rows):
    return spark.createDataFrame(
        rows,
        "transaction_id BIGINT, account_id BIGINT, transaction_date TIMESTAMP, amount DOUBLE, type STRING, "
        "channel STRING, location STRING, fraud_score DOUBLE",
    )


def test_router_flags_strictly_and_drops_repeats(spark):
    incoming, out, ck = (fresh_path(spark, n) for n in ("in", "out", "ck"))
    day = dt.datetime(2025, 1, 10, 12)
    rows = [
        (1, 7, day, 10.0, "Debit", "ATM", "Bago", 0.85), (2, 7, day, 10.0, "Debit", "ATM", "Bago", 0.86),
        (3, 7, day, 900.0, "Debit", "ATM", "Bago", None),
    ]
    _live(spark, rows).coalesce(1).write.parquet(incoming)
    router.route_stream(spark, incoming, out, ck, "XGBoost", "v1.2")
    late = [(2, 7, day, 10.0, "Debit", "ATM", "Bago", 0.99), (4, 8, day, 1.0, "Debit", "POS", "Bago", 0.9)]
    _live(spark, late).coalesce(1).write.mode("append").parquet(incoming)
    router.route_stream(spark, incoming, out, ck, "XGBoost", "v1.2")
    ids = {t: sorted(r["transaction_id"] for r in router.stored(spark, out, t).collect()) for t in router.TABLES}
    assert ids == {"transactions": [1, 2, 3, 4], "fraud_alerts": [2, 3, 4], "model_logs": [1, 2, 3, 4]}
    log = router.stored(spark, out, "model_logs").filter("transaction_id = 2").first()
    assert (log["model_name"], log["model_version"], log["fraud_score"]) == ("XGBoost", "v1.2", 0.86)
    # a replay into fresh folders gives the same rows
    out2 = fresh_path(spark, "out")
    router.route_stream(spark, incoming, out2, fresh_path(spark, "ck"), "XGBoost", "v1.2")
    for t in ("transactions", "model_logs"):
        assert router.stored(spark, out2, t).count() == 4


def test_router_keeps_late_rows(spark):
    incoming, out = fresh_path(spark, "in"), fresh_path(spark, "out")
    for k, day in enumerate((10, 20, 1, 2)):  # a file per batch, out of time order
        rows = [(k, 7, dt.datetime(2025, 1, day), 10.0, "Debit", "ATM", "Bago", 0.9), (0, 7, dt.datetime(2025, 3, day), 5.0, "Debit", "ATM", "Bago", 0.1)]
        _live(spark, rows).coalesce(1).write.mode("append").parquet(incoming)
    router.route_stream(spark, incoming, out, fresh_path(spark, "ck"), files_per_batch=1)
    for table in router.TABLES:
        assert sorted(r["transaction_id"] for r in router.stored(spark, out, table).collect()) == [0, 1, 2, 3]


def _router_input(spark, files):
    """Files of 40 rows each; a third of the rows repeat ids of earlier files or of their own."""
    incoming = fresh_path(spark, "in")
    for k in range(files):
        day = dt.datetime(2025, 1, 1 + (7 * k) % 28)
        rows = [(max(0, 30 * k - 10 + i % 35), i, day, 10.0 + i, "Debit", "ATM", "Bago", (i % 10) / 10) for i in range(40)]
        rows.append((None, k, day, 1.0, "Debit", "POS", "Bago", 0.9))
        _live(spark, rows).coalesce(1).write.mode("append").parquet(incoming)
    return incoming


def _tables(spark, out):
    return {t: sorted((tuple(r)[:-1] for r in router.stored(spark, out, t).collect()), key=repr) for t in router.TABLES}


def test_router_reads_no_history(spark):
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def __init__(self):
            self.rows, self.state = [], []

        def onQueryStarted(self, event): ...
        def onQueryIdle(self, event): ...
        def onQueryTerminated(self, event): ...

        def onQueryProgress(self, event):
            self.rows.append(event.progress.numInputRows)
            self.state.append([o.numRowsTotal for o in event.progress.stateOperators])

    files = 8
    incoming, out = _router_input(spark, files), fresh_path(spark, "out")
    seen = Progress()
    spark.streams.addListener(seen)
    try:
        router.route_stream(spark, incoming, out, fresh_path(spark, "ck"), files_per_batch=1)
    finally:
        for _ in range(100):
            if len([n for n in seen.rows if n]) >= files:
                break
            time.sleep(0.1)
        spark.streams.removeListener(seen)
    # the source stands twice in the plan (rows with and without id): 41 rows a file, in every batch
    assert [n for n in seen.rows if n] == [82] * files
    got = _tables(spark, out)
    ids = {r[0] for r in got["transactions"]} - {None}
    assert len(got["transactions"]) == len(got["model_logs"]) == len(ids) + files
    assert max(n for state in seen.state for n in state) == len(ids)
    batch = spark.read.schema(ddl("live_transactions")).parquet(incoming)
    assert ids == {r[0] for r in batch.select("transaction_id").distinct().collect()} - {None}


def test_router_goes_on_after_a_failure(spark):
    incoming = _router_input(spark, 5)
    out, other = fresh_path(spark, "out"), fresh_path(spark, "out")
    router.route_stream(spark, incoming, other, fresh_path(spark, "ck"), files_per_batch=1)
    ck, calls = fresh_path(spark, "ck"), []

    def fails_once_in_between(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return router.rule_score(df)

    with pytest.raises(Exception, match="lost"):
        router.route_stream(spark, incoming, out, ck, score=fails_once_in_between, files_per_batch=1)
    partly = router.stored(spark, out, "transactions").count()
    router.route_stream(spark, incoming, out, ck, score=fails_once_in_between, files_per_batch=1)
    assert 0 < partly < len(_tables(spark, out)["transactions"])
    assert _tables(spark, out) == _tables(spark, other)


def test_shared_folder_is_required_off_one_machine(spark, monkeypatch):
    from bankspark import session

    monkeypatch.setattr(session, "is_local", lambda s: False)
    monkeypatch.setattr(session.SparkSession, "conf", property(lambda s: type("C", (), {"get": staticmethod(lambda k, d=None: d)})()), raising=False)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)


def test_staged_files_and_tasks_grow_with_the_stream(spark, monkeypatch, folder):
    from bankspark.plans import streams
    from bankspark.sources.tables import Bank

    routed = []
    monkeypatch.setattr(streams, "STAGED_ROWS", 100)
    monkeypatch.setattr(streams.router, "route_stream", lambda spark, incoming, out, ck, files_per_batch, count_ids: routed.append((incoming, files_per_batch)))
    bank = Bank(spark, folder)
    streams._route(bank)
    incoming, per_batch = routed[0]
    staged = spark.read.parquet(incoming)
    rows = bank.transactions_ev.count()
    assert staged.count() == 2 * rows and len(staged.inputFiles()) == 3 * -(-2 * rows // 300) and 3 * per_batch == len(staged.inputFiles())
