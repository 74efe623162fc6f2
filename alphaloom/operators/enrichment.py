"""The older generation's signals that need more than a ticker's own bars: residuals, sectors, the market, shares afloat.

Each input beside the panel is optional; without it the signals that need it are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import div
from ..functions.rolling_ols import add_residual
from ..functions.windows import by_ticker, rolling
from .asof import asof_backward
from .cross_section import minus_sector_median

#: Factor columns of the enrichment, the risk-free rate left out.
FACTORS = ("mkt_rf", "smb", "hml", "mom")
YEAR = 252.0


def residual_signals(panel: DataFrame, y: str, factors: list[str], lagged_rows: int = 231, annual: bool = True) -> DataFrame:
    """Adds alpha_33 and alpha_59 from residuals of complete 252-row windows.

    `lagged_rows` 231 and `annual` are the enrichment's form, 232 and no scaling that of the batch builder.
    """
    rows = add_residual(panel, y, factors, 252, 252).withColumn("_late", F.lag("residual", 21).over(by_ticker()))
    scale = YEAR**0.5 if annual else 1.0
    out = rows.withColumns({"alpha_33": rolling(F.sum, F.col("_late"), lagged_rows), "alpha_59": scale * rolling(F.stddev_samp, F.col("residual"), 63)})
    return out.drop("residual", "_late")


def market_beta(panel: DataFrame, r: str = "alpha_26", market: str = "market_return", n: int = 252) -> DataFrame:
    """Adds alpha_60: covariance with the market over the market's variance in n rows that have both."""
    frame = by_ticker().rowsBetween(1 - n, 0)
    m = F.when(F.col(r).isNotNull(), F.col(market))
    return panel.withColumn("alpha_60", F.when(F.count(m).over(frame) >= n, div(F.covar_samp(F.col(r), m).over(frame), F.var_samp(m).over(frame))))


def group_return_sum(panel: DataFrame, group_return: str, out: str, n: int = 63) -> DataFrame:
    """Adds the n-row sum of the return of a row's sector or industry, NULL without n values."""
    return panel.withColumn(out, rolling(F.sum, F.col(group_return), n))


def minus_index_momentum(panel: DataFrame, index: DataFrame, momentum: str, n: int = 126) -> DataFrame:
    """Adds alpha_34 of the oldest form: a ticker's momentum less its sector index's n-row sum of returns.

    `index` has (sector, date, index_return): a row a sector and date, so it is small beside the panel, but is not broadcast.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("sector").orderBy("date").rowsBetween(1 - n, 0)
    total = F.when(F.count("index_return").over(w) >= n, F.sum("index_return").over(w))
    sums = index.select("sector", "date", total.alias("_index"))
    return panel.join(sums, ["sector", "date"], "left").withColumn("alpha_34", F.col(momentum) - F.col("_index")).drop("_index")


def enrich(panel: DataFrame, factors: DataFrame | None = None, market: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """Adds alpha_33, 34, 35, 59, 60 and 66 to a panel of (ticker, date, sector, volume, alpha_26, alpha_30).

    factors: date, mkt_rf, smb, hml, mom, rf; market: date, market_return; snapshots: ticker, date, float_shares. Factors and
    market have one row a date: bounded by the calendar, so they are broadcast. 33 and 59 are NULL after the last factor date, 34 in
    sectors of fewer than five values or without a sector, 35 always, 66 before the first snapshot.
    """
    given = panel.columns
    null = F.lit(None).cast("double")
    if factors is None:
        out = panel.withColumns({"alpha_33": null, "alpha_59": null})
    else:
        rows = panel.select("ticker", "date", "alpha_26").join(F.broadcast(factors.select("date", *FACTORS, "rf")), "date", "left")
        got = residual_signals(rows.withColumn("_y", F.col("alpha_26") - F.col("rf")), "_y", list(FACTORS))
        last = factors.agg(F.max("date").alias("_last"))  # one row
        got = got.crossJoin(F.broadcast(last)).filter("date <= _last").select("ticker", "date", "alpha_33", "alpha_59")
        out = panel.join(got, ["ticker", "date"], "left")
    if market is None:
        out = out.withColumn("alpha_60", null)
    else:
        out = market_beta(out.join(F.broadcast(market.select("date", F.col("market_return").alias("_market"))), "date", "left"), market="_market")
    if snapshots is None:
        out = out.withColumn("alpha_66", null)
    else:
        known = asof_backward(out, snapshots.withColumnRenamed("float_shares", "_afloat"), "_afloat")
        out = known.withColumn("alpha_66", div(F.col("volume"), F.col("_afloat")))
    out = minus_sector_median(out, "alpha_30", "alpha_34").withColumn("alpha_34", F.when(F.col("sector").isNotNull(), F.col("alpha_34")))
    return out.withColumn("alpha_35", null).select(*given, *(f"alpha_{k}" for k in (33, 34, 35, 59, 60, 66)))
