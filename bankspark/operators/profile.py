"""Profile reports: long rows of (column, dtype, value, count) built from one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark import fixed_values as V
from bankspark.functions.numbers import money_avg, money_sum
from bankspark.operators.quantiles import exact_quantiles


def stack_rows(one_row: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Turn the columns of a one-row aggregate into several rows."""
    structs = [F.struct(*[c.alias(n) for c, n in zip(row, names)]) for row in rows]
    return one_row.select(F.inline(F.array(*structs)))


_REPORT = ["column", "dtype", "value", "count"]


def _report_row(column: str, dtype: str, value: str, count: Column) -> list[Column]:
    return [F.lit(column), F.lit(dtype), F.lit(value), count.cast("double")]


def scalar_profile(df: DataFrame, column: str, title: str) -> DataFrame:
    """Count, sum, mean, median, min, max and sample deviation as report rows."""
    c = F.col(column)
    median = exact_quantiles(df, column, [0.5])[0]
    stats = df.agg(
        F.count(c).alias("n"), money_sum(c).alias("s"), money_avg(c).alias("mean"),
        F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.stddev_samp(c), 2).alias("sd"),
    )
    values = [
        ("Total Accounts", F.col("n")), ("Total Sum", F.col("s")), ("Mean", F.col("mean")),
        ("Median", F.lit(median)), ("Min", F.col("low")), ("Max", F.col("high")), ("Std Deviation", F.col("sd")),
    ]
    return stack_rows(stats, [_report_row(title, "double", name, v) for name, v in values], _REPORT)


def banded_histogram(df: DataFrame, column: str, edges=None, labels=None) -> DataFrame:
    """Rows per [low, high) band, empty bands included; values outside all bands are not counted."""
    edges, labels = edges or V.BALANCE_EDGES, labels or V.BALANCE_LABELS
    c = F.col(column)
    counts = df.agg(
        *[
            F.count_if((c >= low) & (c < high)).alias(f"_{i}")
            for i, (low, high) in enumerate(zip(edges, edges[1:]))
        ]
    )
    rows = [_report_row("Balance Range", "category", label, F.col(f"_{i}")) for i, label in enumerate(labels)]
    return stack_rows(counts, rows, _REPORT)


def null_profile(df: DataFrame) -> DataFrame:
    """Non-null count and type of every column, from one aggregate."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = [[F.lit(f.name), F.col(f.name), F.lit(f.dataType.simpleString())] for f in df.schema.fields]
    return stack_rows(counts, rows, ["column", "non_null_count", "dtype"])


def schema_report(df: DataFrame) -> DataFrame:
    """Position, name, type, number of rows and lowest value of every column, from one aggregate."""
    fields = list(enumerate(df.schema.fields))
    low = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.min(F.col(f.name)).cast("string").alias(f"_{i}") for i, f in fields]
    )
    rows = [
        [F.lit(i), F.lit(f.name), F.lit(f.dataType.simpleString()), F.col("_rows"), F.col(f"_{i}")] for i, f in fields
    ]
    return stack_rows(low, rows, ["position", "column", "dtype", "rows", "lowest"])


def _as_text(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("string")


COUNTED_ROWS = 100_000  # rows of a large table that a task counts at a time


def value_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count) for all the columns at once; null is a value.

    Values are told apart by their exact text; doubles are then shown with two decimals. A large table is
    counted in parts of a bounded number of rows, and the counts are summed in tasks of a bounded number of values.
    """
    doubles = [c for c, t in df.dtypes if t == "double"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in columns])
    tasks = df.count() // COUNTED_ROWS
    if tasks < 10:
        counted = df.select(F.inline(pairs)).groupBy("column", "value").count()
    else:
        part = F.pmod(F.xxhash64(*columns), F.lit(8 * tasks)).alias("_part")
        dealt = df.select(*columns, part).repartition(tasks, "_part")
        parts = dealt.select("_part", F.inline(pairs)).groupBy("_part", "column", "value").count()
        counted = parts.repartition(tasks, "column", "value").groupBy("column", "value").agg(F.sum("count").alias("count"))
    shown = F.coalesce(F.col("value").try_cast("double").try_cast("decimal(18,2)").cast("string"), F.col("value"))
    return counted.withColumn("value", F.when(F.col("column").isin(doubles), shown).otherwise(F.col("value")))


def distinct_profile(df: DataFrame) -> DataFrame:
    """Number of rows and number of distinct values per column, null counted as a value.

    All columns go through one grouped count, so a frequent value is combined before the shuffle.
    """
    types = dict(df.dtypes)
    per_column = (
        value_histogram(df, df.columns)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("unique"), F.sum("count").alias("rows"))
    )
    dtype = F.create_map(*[F.lit(x) for c in df.columns for x in (c, types[c])])
    first = F.lit(df.columns[0])
    is_first = F.col("column") == first
    unique_row = F.struct(
        F.concat(F.lit("Unique Values in "), "column").alias("column"), dtype[F.col("column")].alias("dtype"),
        F.lit("").alias("value"), F.col("unique").cast("double").alias("count"),
    )
    total_row = F.struct(
        F.lit("Total Rows").alias("column"), F.lit("").alias("dtype"), F.lit("").alias("value"),
        F.col("rows").cast("double").alias("count"),
    )
    return per_column.select(
        F.inline(F.when(is_first, F.array(total_row, unique_row)).otherwise(F.array(unique_row)))
    )


def count_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys own 1, 2, 3 ... rows, with the number above one and the maximum."""
    owned = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    spread = owned.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    summary = stack_rows(
        spread.agg(
            F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("several"),
            F.max("k").alias("most"),
        ),
        [
            _report_row("Customers with >1 Account", "bigint", "", F.col("several")),
            _report_row("Max Accounts by One Customer", "bigint", "", F.col("most")),
        ],
        _REPORT,
    )
    rows = spread.select(
        F.lit("Customers with X Accounts").alias("column"), F.lit("bigint").alias("dtype"),
        F.concat(F.col("k").cast("string"), F.lit(" accounts")).alias("value"),
        F.col("n").cast("double").alias("count"),
    )
    return summary.unionByName(rows)


def value_profile(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Counts of every value of the chosen columns, plus the number of distinct keys."""
    types = dict(df.dtypes)
    counted = value_histogram(df, [key, *columns])
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    keys = counted.filter((F.col("column") == key) & F.col("value").isNotNull()).agg(
        F.lit(f"Total Accounts ({key})").alias("column"), F.lit(types[key]).alias("dtype"),
        F.lit("").alias("value"), F.count(F.lit(1)).cast("double").alias("count"),
    )
    values = counted.filter(F.col("column") != key).select(
        "column", dtype[F.col("column")].alias("dtype"), "value", F.col("count").cast("double").alias("count")
    )
    return keys.unionByName(values)


def five_numbers(df: DataFrame, column: str) -> DataFrame:
    """Minimum, quartiles, mean and maximum of one column."""
    q1, median, q3 = exact_quantiles(df, column, [0.25, 0.5, 0.75])
    c = F.col(column)
    return df.agg(
        F.min(c).alias("min"), F.lit(q1).alias("q1"), F.lit(median).alias("median"),
        F.round(F.avg(c), 9).alias("mean"), F.lit(q3).alias("q3"), F.max(c).alias("max"),
    )
