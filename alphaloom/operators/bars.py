"""Bars: aggregation, deduplication, standardisation and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clean, div

OHLCV = ("open", "high", "low", "close", "volume")


def ticks_to_bars(ticks: DataFrame, order: list[str], by: tuple[str, ...] = ("ticker", "date")) -> DataFrame:
    """Daily open, high, low, close, volume and VWAP from ticks (price, qty), ordered by `order` within a day."""
    key = F.struct(*order)
    seen = F.col("price").isNotNull()
    return ticks.groupBy(*by).agg(
        F.min_by(F.when(seen, F.col("price")), F.when(seen, key)).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by(F.when(seen, F.col("price")), F.when(seen, key)).alias("close"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("volume"),
        div(F.sum(F.col("price") * F.col("qty")), F.sum("qty")).alias("daily_vwap"),
    )


def minutes_to_daily(minutes: DataFrame, first: int = 570, last: int = 960, strict_end: bool = True) -> DataFrame:
    """Minute OHLCV (ticker, ts) to daily bars within the session; strict_end drops seconds after the last minute."""
    t = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    inside = t.between(first * 60, last * 60 if strict_end else last * 60 + 59)
    open_, close = F.col("open"), F.col("close")
    return minutes.filter(inside).groupBy("ticker", F.to_date("ts").alias("date")).agg(
        F.min_by(open_, F.when(open_.isNotNull(), F.col("ts"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by(close, F.when(close.isNotNull(), F.col("ts"))).alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume"),
        div(F.sum(close * F.col("volume")), F.sum("volume")).alias("daily_vwap"),
    )


def duplicate_report(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per duplicated key: rows, distinct contents, and whether they conflict."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.struct(*values)).alias("n_versions")).filter("n_rows > 1").withColumn("conflict", F.col("n_versions") > 1)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def standardise_daily(df: DataFrame) -> DataFrame:
    """Canonical columns: aliases, coerced numbers, VWAP falling back to close."""
    first = lambda *names: next((F.col(n) for n in names if n in df.columns), F.lit(None))
    number = lambda c: clean(c.try_cast("double"))
    cols = {n: number(first(n, f"daily_{n}")) for n in OHLCV}
    out = df.select(F.upper(F.trim("ticker")).alias("ticker"), F.col("date").cast("date").alias("date"), *(c.alias(n) for n, c in cols.items()), number(first("daily_vwap", "vwap")).alias("daily_vwap"))
    return out.withColumn("daily_vwap", F.coalesce("daily_vwap", "close"))


def bar_rules(eps: float = 1e-6) -> dict[str, Column]:
    """A row breaks a rule where its column is true."""
    o, h, lo, c, v = (F.col(n) for n in OHLCV)
    return {
        "missing": F.coalesce(*(F.when(F.col(n).isNull(), True) for n in OHLCV), F.lit(False)),
        "high_logic": F.coalesce(h + eps < F.greatest(o, c, lo), F.lit(False)),
        "low_logic": F.coalesce(lo - eps > F.least(o, c, h), F.lit(False)),
        "price": F.coalesce(F.least(o, h, lo, c) <= 0, F.lit(False)),
        "volume": F.coalesce(v < 0, F.lit(False)),
    }


def validate_bars(bars: DataFrame, min_rows: int = 300, eps: float = 1e-6) -> DataFrame:
    """Per ticker: rows, broken rules, duplicate dates and whether it passes."""
    rules = bar_rules(eps)
    out = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), (F.count("date") - F.count_distinct("date")).alias("duplicates"), *(F.count_if(c).alias(k) for k, c in rules.items()))
    bad = sum((F.col(k) for k in rules), F.col("duplicates"))
    return out.withColumn("passed", (bad == 0) & (F.col("n_rows") >= min_rows))


def last_of_bucket(df: DataFrame, bucket: Column, by: str = "ticker") -> DataFrame:
    """The latest row per (by, bucket), with the bucket as `bucket`."""
    w = Window.partitionBy(by, "bucket").orderBy(F.desc("date"))
    return df.withColumn("bucket", bucket).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
