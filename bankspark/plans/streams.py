"""The live fraud router, run over the event transactions as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from bankspark.plans.models import once
from bankspark.plans.registry import query
from bankspark.session import fresh_path
from bankspark.streaming import router


STAGED_FILES, STAGED_ROWS = 9, 250_000  # files at least, and rows of a file


def _routed(b) -> str:
    """The output folder of one run of the router, shared by the queries on its tables."""
    return once(b, "routed stream", lambda: _route(b))


def _route(b) -> str:
    """Stage the transactions as a folder of files, each id twice and out of time order, and route them
    in several batches."""
    incoming, out = fresh_path(b.spark, "incoming"), fresh_path(b.spark, "routed")
    live = b.transactions_ev.select(
        "transaction_id", "account_id", F.col("transaction_date").cast("timestamp").alias("transaction_date"),
        "amount", "type", "channel", "location",
        F.when(F.col("transaction_id") % 3 == 0, F.col("amount") / 100.0).alias("fraud_score"),
    )
    # dealt by a hash: a file has rows of all days, and repeats of rows of other files
    files = 3 * max(STAGED_FILES // 3, -(-2 * live.count() // (3 * STAGED_ROWS)))
    twice = live.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    twice.repartition(files, F.xxhash64("transaction_id", "copy")).drop("copy").write.parquet(incoming)
    router.route_stream(b.spark, incoming, out, fresh_path(b.spark, "checkpoint"), files_per_batch=files // 3, count_ids=False)
    return out


_SCORED = """scored AS (SELECT *, CASE WHEN transaction_id % 3 = 0 THEN amount / CAST(100.0 AS DOUBLE)
  ELSE amount / (amount + CAST(100.0 AS DOUBLE)) END AS fraud_score FROM transactions_ev)"""


@query(
    "st1_live_fraud_router",
    "transactions_ev",
    f"WITH {_SCORED} SELECT transaction_id, fraud_score, TRUE AS fraud_flag FROM scored WHERE fraud_score > 0.85",
)
def _(b):
    return router.stored(b.spark, _routed(b), "fraud_alerts").drop("batch_id")


@query(
    "st1_live_transactions",
    "transactions_ev",
    "SELECT transaction_id, account_id, amount, type, channel, location FROM transactions_ev",
)
def _(b):
    return router.stored(b.spark, _routed(b), "transactions").drop("batch_id", "transaction_date")


@query(
    "st1_live_model_logs",
    "transactions_ev",
    f"""WITH {_SCORED} SELECT transaction_id, 'ManualCheck' AS model_name, 'v1.0' AS model_version, fraud_score
FROM scored""",
)
def _(b):
    return router.stored(b.spark, _routed(b), "model_logs").drop("batch_id")
