"""NULL is the only missing value: helpers that keep NaN and infinities out."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def div(n: Column, d: Column) -> Column:
    """n / d, NULL where d is 0."""
    return F.try_divide(n, F.nullif(d, F.lit(0.0)))


def log_ratio(n: Column, d: Column) -> Column:
    """ln(n / d), NULL unless both are positive."""
    return F.when((n > 0) & (d > 0), F.ln(F.try_divide(n, d)))


def number(text: Column) -> Column:
    """Text as double; NULL where it is none."""
    return clean(text.try_cast("double"))


def flag(text: Column) -> Column:
    """Boolean from true, 1, yes, y in any case."""
    return F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes", "y")
