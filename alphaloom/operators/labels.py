"""Forward returns and relevance grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import log_ratio
from ..functions.ranks import pct_rank
from ..functions.windows import lead

HORIZONS = (1, 5, 21)


def add_labels(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Close-to-close, tradable (from the next open) and VWAP forward log returns."""
    c, out = F.col("close"), {}
    for h in horizons:
        out[f"fwd_cc_{h}d"] = log_ratio(lead("close", h), c)
        out[f"fwd_tradable_{h}d"] = log_ratio(lead("close", h), lead("open", 1))
        out[f"fwd_vwap_{h}d"] = log_ratio(lead("close", 1), lead("daily_vwap", 1)) if h == 1 else log_ratio(lead("daily_vwap", h), lead("daily_vwap", 1))
    return bars.withColumns(out)


def market_forward(market: DataFrame, h: int, price: str = "level") -> DataFrame:
    """date, market_fwd: one short series."""
    w = Window.orderBy("date")
    return market.select("date", log_ratio(F.lead(price, h).over(w), F.col(price)).alias("market_fwd"))


def add_excess(labelled: DataFrame, market: DataFrame, h: int = 5) -> DataFrame:
    """Forward return over the market's; the market has one row a date, so its size is bounded by the calendar."""
    return labelled.join(market_forward(market, h), "date", "left").withColumn(f"fwd_excess_{h}d", F.col(f"fwd_cc_{h}d") - F.col("market_fwd")).drop("market_fwd")


def relevance_grade(df: DataFrame, target: str, by: str = "date", grades: int = 31) -> DataFrame:
    """Integer grade 0 to `grades` from the within-date percent rank."""
    rank = pct_rank(F.col(target), [by])
    return df.withColumn("grade", F.greatest(F.lit(0), F.least(F.lit(grades), F.floor(rank * grades).cast("int"))))
