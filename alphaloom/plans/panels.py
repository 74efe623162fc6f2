"""Panels derived from the test tables, which carry no prices: suppliers are tickers, line items are ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.signals import add_signals, name
from ..operators.asof import asof_backward
from ..operators.bars import last_of_bucket, ticks_to_bars
from ..operators.labels import add_labels
from ..sources.tables import market_returns

#: Signals of the small evaluation panel.
ALPHAS = (27, 39, 42, 47, 54, 64)
NAMES = [name(k) for k in ALPHAS]


def table(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def bars(spark: SparkSession, d: str, by_ticker: bool = False) -> DataFrame:
    """Daily bars; `by_ticker` deals the ticks by ticker first: one exchange and one sort then serve bars and windows, and a second use of the bars."""
    rows = table(spark, d, "lineitem").filter("l_quantity > 0 AND l_extendedprice > 0")
    ticks = rows.select(
        F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
    )
    return ticks_to_bars(ticks.repartition("ticker") if by_ticker else ticks, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "qty"])


def market(daily: DataFrame) -> DataFrame:
    return market_returns(daily.groupBy("date").agg(F.avg("close").alias("level")))


def gics(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("ticker"), F.col("s_name").alias("company_name"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"))


def float_shares(daily: DataFrame) -> DataFrame:
    """Quarter-end snapshots of cumulative volume."""
    end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))
    sums = daily.groupBy("ticker", end.alias("date")).agg(F.sum("volume").alias("_v"))
    return sums.select("ticker", "date", F.sum("_v").over(Window.partitionBy("ticker").orderBy("date")).alias("float_shares"))


def signals(spark: SparkSession, d: str, ids: list[int], variant: str = "B", add=add_signals, by_ticker: bool = False) -> DataFrame:
    daily = whole = bars(spark, d, by_ticker)
    if 60 in ids:  # one row a date: bounded by the calendar
        daily = daily.join(F.broadcast(market(whole).select("date", "market_return")), "date", "left")
    if 66 in ids:
        daily = asof_backward(daily, float_shares(whole), "float_shares")
    return add(daily, ids, variant)


def month_panel(spark: SparkSession, d: str, ids=ALPHAS, horizons=(5,)) -> DataFrame:
    """The last row of each ticker and month (as `date`), with sector, signals and forward returns."""
    rows = add_labels(add_signals(bars(spark, d), list(ids)), horizons)
    last = last_of_bucket(rows, F.trunc("date", "month")).withColumn("date", F.col("bucket")).drop("bucket")
    return last.join(gics(spark, d).select("ticker", "sector"), "ticker", "left")
