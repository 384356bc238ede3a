"""Live fraud routing: every transaction is stored, scored, logged and, if risky, alerted.

Repeats are found in keyed state: a streaming aggregation holds, per transaction id, when the id was
first seen. A batch reads its own rows and the state of their ids, never what was stored before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark.fixed_values import FRAUD_SCORE_LIMIT
from bankspark.schema import ddl

TABLES = ("transactions", "fraud_alerts", "model_logs")


def rule_score(df: DataFrame) -> DataFrame:
    """Score of rows that bring none: grows with the amount, from 0 towards 1."""
    amount = F.col("amount")
    return df.withColumn("fraud_score", F.coalesce("fraud_score", amount / (amount + 100.0)))


def route_batch(scored: DataFrame, model_name: str, model_version: str) -> dict[str, DataFrame]:
    """The rows of the three tables that one batch adds."""
    flag = F.col("fraud_score") > FRAUD_SCORE_LIMIT
    return {
        "transactions": scored.select(
            "transaction_id", "account_id", "amount", "type", "channel", "location", "transaction_date"
        ),
        "fraud_alerts": scored.filter(flag).select(
            "transaction_id", "fraud_score", F.lit(True).alias("fraud_flag")
        ),
        "model_logs": scored.select(
            "transaction_id", F.lit(model_name).alias("model_name"),
            F.lit(model_version).alias("model_version"), "fraud_score",
        ),
    }


def route_stream(
    spark: SparkSession,
    incoming: str,
    out: str,
    checkpoint: str,
    model_name: str = "ManualCheck",
    model_version: str = "v1.0",
    score: Callable[[DataFrame], DataFrame] = rule_score,
    files_per_batch: int = 64,
    count_ids: bool = True,
) -> None:
    """Read the folder of incoming Parquet files to its end and write the three tables.

    Every transaction is stored, scored and logged, however late it comes. An id that came in an
    earlier batch is a repeat and is dropped; of several rows with one id in a batch the earliest (then
    the smallest in the order of columns) counts. A row without id is never a repeat. Each table is
    partitioned by the batch number and a batch overwrites only its own partition, so a batch that is
    run again after a failure leaves the same rows. State is kept by RocksDB, in as many partitions
    as ``spark.sql.shuffle.partitions`` says when the stream runs for the first time. Without ``count_ids``
    its progress does not tell how many ids the state holds, and no id is looked up once more to be counted.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", str(count_ids).lower())
    files = spark.readStream.schema(ddl("live_transactions")).option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch).persist()
        for name, rows in route_batch(scored, model_name, model_version).items():
            (
                rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id").parquet(f"{out}/{name}")
            )
        scored.unpersist()

    fresh = first_rows(files.parquet(incoming)).unionByName(files.parquet(incoming).filter("transaction_id IS NULL"))
    query = (
        fresh.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_rows(live: DataFrame) -> DataFrame:
    """The rows of a stream whose id no earlier batch had, one per id, in update mode.

    All rows of a batch have one arrival time, also when the batch is run again, so an id is new where
    the earliest arrival in its state is the batch's own.
    """
    columns = ["transaction_date", *[c for c in live.columns if c not in ("transaction_id", "transaction_date")]]
    arrival = F.current_timestamp()
    state = (
        live.filter("transaction_id IS NOT NULL").withColumn("_arrival", arrival)
        .groupBy("transaction_id").agg(F.min(F.struct(*columns)).alias("row"), F.min("_arrival").alias("first_seen"))
    )
    return state.filter(F.col("first_seen") == arrival).select("transaction_id", "row.*").select(live.columns)


_STORED = {
    "transactions": "transaction_id BIGINT, account_id BIGINT, amount DOUBLE, type STRING, channel STRING, "
    "location STRING, transaction_date TIMESTAMP, batch_id BIGINT",
    "fraud_alerts": "transaction_id BIGINT, fraud_score DOUBLE, fraud_flag BOOLEAN, batch_id BIGINT",
    "model_logs": "transaction_id BIGINT, model_name STRING, model_version STRING, fraud_score DOUBLE, "
    "batch_id BIGINT",
}


def stored(spark: SparkSession, out: str, table: str) -> DataFrame:
    """One of the three tables as written so far."""
    return spark.read.schema(_STORED[table]).parquet(f"{out}/{table}")
