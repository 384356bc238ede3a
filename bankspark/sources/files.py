"""Reading and writing tables: CSV, compressed CSV, per-key folders, dated runs, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark.functions.text import slug
from bankspark.schema import ddl


_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header and a stated schema; empty fields are null, bad rows stop the job."""
    return (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
        .option("timestampNTZFormat", _TIME_FORMAT).option("timestampFormat", _TIME_FORMAT).csv(path)
    )


def read_bank_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A CSV file of one of the bank tables."""
    return read_csv(spark, path, ddl(table))


def read_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text; ``{name}`` in the text stands for the table given under that name."""
    return spark.sql(sql, **tables)


def read_jdbc(
    spark: SparkSession, url: str, table: str, split_column: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table read in parallel by ranges of a numeric column."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .options(partitionColumn=split_column, lowerBound=low, upperBound=high, numPartitions=parts)
        .load()
    )


def write_csv(df: DataFrame, path: str, mode: str = "error", compression: str = "none") -> None:
    """A folder of CSV part files with headers; every task writes its own part."""
    (
        df.write.mode(mode).option("header", True).option("compression", compression)
        .option("timestampNTZFormat", _TIME_FORMAT).option("timestampFormat", _TIME_FORMAT).csv(path)
    )


def write_gzip(df: DataFrame, path: str, mode: str = "error") -> None:
    write_csv(df, path, mode, "gzip")


def write_per_key(df: DataFrame, key: str, path: str, mode: str = "error", files_per_key: int = 1) -> None:
    """One folder per value of ``key``, named by the lower-case value with underscores.

    All keys are written in one pass. Rows without a key are left out. ``files_per_key`` deals the
    rows of each key to that many tasks, so a key with most of the rows is not written by one task.
    """
    keyed = df.filter(F.col(key).isNotNull()).withColumn(f"{key}_slug", slug(F.col(key)))
    if files_per_key > 1:
        lane = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_key))
        keyed = keyed.repartition(f"{key}_slug", lane)
    keyed.write.mode(mode).option("header", True).partitionBy(f"{key}_slug").csv(path)


def write_dated_run(df: DataFrame, path: str, run_date: str) -> None:
    """Write a run under its date; a second run of the day replaces only that day."""
    (
        df.withColumn("run_date", F.lit(run_date).cast("date"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date").parquet(path)
    )


def append_run_log(flagged: DataFrame, path: str, when: str) -> None:
    """Append one row: time, records processed, fraud cases detected."""
    flagged.agg(
        F.lit(when).cast("timestamp_ntz").alias("timestamp"),
        F.count(F.lit(1)).alias("records_processed"),
        F.coalesce(F.sum("fraud_flag"), F.lit(0)).alias("fraud_cases_detected"),
    ).write.mode("append").parquet(path)


def append_table(df: DataFrame, path: str, **stamps) -> None:
    """Append rows to a Parquet table, with extra constant columns."""
    df.withColumns({k: F.lit(v) for k, v in stamps.items()}).write.mode("append").parquet(path)
