"""Daily bars from an unbounded stream of ticks, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import div


def stream_bars(ticks: DataFrame, bucket: str = "1 day", late: str = "2 days") -> DataFrame:
    """ticker, date, OHLCV and VWAP per bucket of (ticker, ts, price, qty); state is dropped once the watermark passes."""
    out = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", bucket)).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("_pv")
    )
    return out.select("ticker", F.col("window.start").cast("date").alias("date"), "open", "high", "low", "close", "volume", div(F.col("_pv"), F.col("volume")).alias("daily_vwap"))
