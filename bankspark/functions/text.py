"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bankspark.fixed_values import YES_WORDS


_WHITE_SPACE = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (``F.trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(_WHITE_SPACE))


def title_case(c: Column) -> Column:
    """First letter of each word upper, the rest lower."""
    return F.initcap(c)


def or_default(c: Column, default: str = "Unknown") -> Column:
    """Null becomes ``default``."""
    return F.coalesce(c, F.lit(default))


def blank_to_null(c: Column) -> Column:
    """An empty or blank text is a missing value."""
    return F.when(strip(c) != "", c)


def yes_flag(c: Column) -> Column:
    """1 for true / yes / 1 in any case and padding, else 0; null counts as 0."""
    return F.when(F.lower(strip(c.cast("string"))).isin(YES_WORDS), 1).otherwise(0)


def label_of(c: Column, labels: dict, default: str | None = None) -> Column:
    """Map codes to labels; unknown codes and null get ``default``."""
    result = None
    for code, label in labels.items():
        hit = c == F.lit(code)
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return result.otherwise(F.lit(default))


def slug(c: Column) -> Column:
    """Lower case with blanks as underscores, the form used in file names."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def percent_label(stage: Column, count: Column, percent: Column) -> Column:
    """``stage count (percent%)`` on two lines."""
    return F.concat(
        stage, F.lit("\n"), count.cast("string"), F.lit(" ("), percent.cast("string"), F.lit("%)")
    )
