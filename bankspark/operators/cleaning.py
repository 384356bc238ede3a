"""Clean-up of raw transactions by trimming, canonical spellings and location rules.

The rule table is a constant of ten merchants, so it is part of the expression: no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankspark.fixed_values import MERCHANT_LOCATIONS
from bankspark.functions.text import or_default, strip, title_case

def canonical_merchant(merchant: Column) -> Column:
    """The listed spelling of a merchant that differs in case only; others unchanged."""
    spellings = F.create_map(*[F.lit(x) for name in MERCHANT_LOCATIONS for x in (name.lower(), name)])
    return F.coalesce(F.try_element_at(spellings, F.lower(merchant)), merchant)


def allowed_location(merchant: Column, location: Column) -> Column:
    """The location, or the merchant's first allowed one when the merchant may not be there.

    Merchants without a rule keep any location; a missing location is never allowed.
    """
    rules = F.create_map(
        *[x for name, places in MERCHANT_LOCATIONS.items() for x in (F.lit(name), F.array(*map(F.lit, places)))]
    )
    allowed = F.try_element_at(rules, merchant)
    is_wrong = allowed.isNotNull() & ~F.coalesce(F.array_contains(allowed, location), F.lit(False))
    return F.when(is_wrong, allowed[0]).otherwise(location)


def canonicalise_by_lookup(df: DataFrame, column: str, lookup: DataFrame, canonical: str) -> DataFrame:
    """Replace values by the lookup's spelling where they agree ignoring case.

    The general form of :func:`canonical_merchant` for a lookup that is itself a table; Spark
    decides by its size whether to broadcast it.
    """
    names = lookup.select(F.lower(canonical).alias("_key"), F.col(canonical).alias("_name"))
    names = names.groupBy("_key").agg(F.min("_name").alias("_name"))  # one spelling per key
    return (
        df.join(names, F.lower(F.col(column)) == F.col("_key"), "left")
        .withColumn(column, F.coalesce("_name", F.col(column)))
        .drop("_key", "_name")
    )


def clean_transactions(raw: DataFrame) -> DataFrame:
    """The whole clean-up as one projection; running it again changes nothing."""
    merchant = canonical_merchant(or_default(strip(F.col("merchant"))))
    tidy = raw.withColumns({"merchant": merchant, "location": title_case(strip(F.col("location")))})
    return tidy.withColumn("location", allowed_location(F.col("merchant"), F.col("location")))
