"""Rolling frames per ticker, with a minimum count of values in the frame."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def rolling(agg, x: Column, n: int, least: int | None = None, of: Column | None = None) -> Column:
    """agg(x) over the last n rows where at least `least` (default n) of them have a value of `of` (default x)."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    return F.when(F.count(x if of is None else of).over(frame) >= (least or n), agg(x).over(frame))


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(by_ticker())


def lead(x: Column | str, k: int = 1) -> Column:
    return F.lead(x, k).over(by_ticker())


def skew(x: Column, n: int) -> Column:
    """Bias-adjusted skewness over n full rows; NULL where the rows are constant."""
    ok = F.when(F.var_pop(x).over(by_ticker().rowsBetween(1 - n, 0)) > 0, F.lit(1))
    return F.when(ok == 1, rolling(F.skewness, x, n)) * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurt(x: Column, n: int) -> Column:
    """Bias-adjusted excess kurtosis over n full rows."""
    return ((n + 1) * rolling(F.kurtosis, x, n) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def corr(x: Column, y: Column, n: int) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    a, b = F.when(both == 1, x), F.when(both == 1, y)
    frame = by_ticker().rowsBetween(1 - n, 0)
    spread = F.stddev_samp(a).over(frame) * F.stddev_samp(b).over(frame)
    return F.when(F.count(a).over(frame) >= n, F.try_divide(F.covar_samp(a, b).over(frame), F.nullif(spread, F.lit(0.0))))


def slope(y: Column, n: int, step: Column) -> Column:
    """OLS slope on the row number `step`."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    return F.when(F.count(y).over(frame) >= n, F.regr_slope(y, step).over(frame))


def drawdown(x: Column, n: int) -> Column:
    """Worst fall from a running maximum within the last n rows."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    worst = F.aggregate(
        F.collect_list(x).over(frame),
        F.struct(F.lit(float("-inf")).alias("top"), F.lit(0.0).alias("low")),
        lambda s, v: F.struct(F.greatest(s["top"], v).alias("top"), F.least(s["low"], v / F.greatest(s["top"], v) - 1).alias("low")),
        lambda s: s["low"],
    )
    return F.when(F.count(x).over(frame) >= n, worst)
