"""Whole-frame column work: feature alignment, scaling, numeric defaults, reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankspark.functions.numbers import finite_or_null

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in _NUMERIC or t.startswith("decimal")]


def fill_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null becomes 0 in the given columns, or in every numeric column."""
    return df.fillna(0, subset=list(columns) if columns else numeric_columns(df))


def only_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite values become null."""
    return df.withColumns({c: finite_or_null(F.col(c).cast("double")) for c in columns})


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Stop when columns that a later step needs are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the model's features in the model's order: missing ones 0, extra ones dropped."""
    have = set(df.columns)
    cols = [(F.col(f) if f in have else F.lit(0.0)).cast("double").alias(f) for f in features]
    return df.select(*keep, *cols)


def drop_if_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation; the moments are one small row taken to the driver."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_samp(c).alias(f"{c}_s") for c in columns]
    ).first()
    return df.withColumns(
        {c: F.try_divide(F.col(c) - F.lit(stats[f"{c}_m"]), F.lit(stats[f"{c}_s"])) for c in columns}
    )


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value
    )
