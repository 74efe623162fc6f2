"""Average ranks; NULLs are ranked last, apart, and stay NULL. One sort serves rank, ties and count."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _parts(x: Column, by: list[str]) -> tuple[Column, Column]:
    """(least rank + number of values up to x) / 2 is the average rank of ties."""
    ordered = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    upto = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.count(x).over(Window.partitionBy(*by))
    return (F.rank().over(ordered) + F.count(x).over(upto)) / F.lit(2.0), n


def average_rank(x: Column, by: list[str]) -> Column:
    return F.when(x.isNotNull(), _parts(x, by)[0])


def pct_rank(x: Column, by: list[str]) -> Column:
    """Average rank / n."""
    rank, n = _parts(x, by)
    return F.when(x.isNotNull(), rank / n)


def unit_rank(x: Column, by: list[str]) -> Column:
    """(average rank - 1) / (n - 1); 0.5 for a single value."""
    rank, n = _parts(x, by)
    return F.when(x.isNotNull(), F.when(n == 1, 0.5).otherwise((rank - 1) / F.nullif(n - 1, F.lit(0))))
