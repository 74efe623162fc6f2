"""Portfolio simulation as relations: holdings depend only on the last valid rebalance, so nothing recurses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import div


def rebalance_dates(df: DataFrame, bucket: str = "week") -> DataFrame:
    """The last date of each bucket."""
    return df.select("date").distinct().groupBy(F.date_trunc(bucket, "date").alias("_b")).agg(F.max("date").alias("date")).select("date")


def picks(scores: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """rebalance, ticker, side, score: top and bottom n names of each rebalance date that has at least 2n."""
    rows = scores.filter(F.col("score").isNotNull()).join(days, "date", "left_semi")
    w = Window.partitionBy("date")
    up, down = w.orderBy(F.desc("score"), "ticker"), w.orderBy("score", "ticker")
    ranked = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_up": F.row_number().over(up), "_down": F.row_number().over(down)}).filter(F.col("_n") >= 2 * n)
    side = F.when(F.col("_up") <= n, "long").when(F.col("_down") <= n, "short")
    return ranked.select(F.col("date").alias("rebalance"), "ticker", side.alias("side"), "score").filter("side IS NOT NULL")


def simulate(scores: DataFrame, returns: DataFrame, n: int = 10, bucket: str = "week", cost: float = 0.001, weighted: bool = False, scale: DataFrame | None = None) -> DataFrame:
    """date, long_ret, short_ret, ls_ret: held from each date's last valid rebalance; cost on every calendar rebalance.

    `scale` (date, regime_scale; one row a date) multiplies the long and the long-short return by its latest value at or before
    the date, and is added; then, as in the version that knows regimes, cost is borne by the long-short return alone.
    """
    days = rebalance_dates(returns, bucket)
    chosen = picks(scores, days, n)
    valid = chosen.select("rebalance").distinct()
    calendar = returns.select("date").distinct()
    w = Window.orderBy("date", F.desc("_v")).rowsBetween(Window.unboundedPreceding, 0)
    marks = calendar.withColumn("_v", F.lit(0)).withColumn("_r", F.lit(None).cast(valid.schema["rebalance"].dataType)).union(valid.select("rebalance", F.lit(1), "rebalance"))
    held = marks.withColumn("rebalance", F.last("_r", ignorenulls=True).over(w)).filter("_v = 0 AND rebalance IS NOT NULL").select("date", "rebalance")  # one row a date
    weight = F.abs("score") / F.nullif(F.sum(F.abs("score")).over(Window.partitionBy("rebalance", "side")), F.lit(0.0))
    book = held.join(chosen.withColumn("w", weight), "rebalance").join(returns.filter("ret IS NOT NULL"), ["date", "ticker"])
    leg = (lambda s: F.sum(F.when(F.col("side") == s, F.col("w") * F.col("ret")))) if weighted else (lambda s: F.avg(F.when(F.col("side") == s, F.col("ret"))))
    daily = book.groupBy("date").agg(leg("long").alias("long_ret"), leg("short").alias("short_ret"))
    daily = daily.join(days.withColumn("_c", F.lit(2 * cost)), "date", "left")
    charge = F.coalesce("_c", F.lit(0.0))
    if scale is not None:
        of = Window.orderBy("date", "_v").rowsBetween(Window.unboundedPreceding, 0)  # one row a date on both sides
        known = scale.select("date", F.lit(0).alias("_v"), "regime_scale").union(calendar.select("date", F.lit(1), F.lit(None).cast("double")))
        known = known.withColumn("regime_scale", F.coalesce(F.last("regime_scale", ignorenulls=True).over(of), F.lit(1.0))).filter("_v = 1").select("date", "regime_scale")
        k = F.col("regime_scale")
        return daily.join(known, "date").select("date", (F.col("long_ret") * k).alias("long_ret"), "short_ret", ((F.col("long_ret") - F.col("short_ret") - charge) * k).alias("ls_ret"), "regime_scale")
    return daily.select("date", (F.col("long_ret") - charge).alias("long_ret"), "short_ret", (F.col("long_ret") - F.col("short_ret") - charge).alias("ls_ret"))


def regime_scale(market: DataFrame, rows: int = 20, floor: float = -0.03, scale: float = 0.5) -> DataFrame:
    """date, regime_scale from the market's return over the last rows."""
    past = F.col("level") / F.lag("level", rows).over(Window.orderBy("date")) - 1
    return market.select("date", F.when(past < floor, scale).otherwise(1.0).alias("regime_scale"))


def curve(returns: DataFrame, x: str) -> DataFrame:
    """date, cum, drawdown of a daily return series."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = returns.select("date", F.product(1 + F.col(x)).over(upto).alias("cum"))
    return out.withColumn("drawdown", F.col("cum") / F.max("cum").over(upto) - 1)


def performance(returns: DataFrame, x: str, year: int = 252) -> DataFrame:
    """Annual return, volatility, Sharpe ratio, maximum drawdown and hit rate of a daily series."""
    own = returns.filter(F.col(x).isNotNull())
    low = curve(own, x).agg(F.min("drawdown").alias("max_drawdown"))
    out = own.agg(F.product(1 + F.col(x)).alias("growth"), F.stddev_samp(x).alias("sd"), F.count(x).alias("n"), F.avg((F.col(x) > 0).cast("double")).alias("hit_rate"))
    out = out.select("n", (F.pow("growth", F.lit(float(year)) / F.col("n")) - 1).alias("annual_return"), (F.col("sd") * year**0.5).alias("annual_vol"), "hit_rate")
    return out.withColumn("sharpe", div(F.col("annual_return"), F.col("annual_vol"))).crossJoin(low)  # one row each


def annual_returns(returns: DataFrame, x: str) -> DataFrame:
    return returns.groupBy(F.year("date").alias("year")).agg((F.product(1 + F.col(x)) - 1).alias("annual_return"))


def decile_book(df: DataFrame, score: str, target: str, share: float = 0.1, tie: str = "ticker") -> DataFrame:
    """date, long_ret, short_ret, ls_ret of floor(share) tails by sort."""
    w = Window.partitionBy("date")
    rows = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull()).withColumns(
        {"_n": F.count(F.lit(1)).over(w), "_u": F.row_number().over(w.orderBy(F.desc(score), tie)), "_d": F.row_number().over(w.orderBy(score, F.desc(tie)))}
    )
    k = F.floor(F.col("_n") * share)
    mean = lambda c: F.avg(F.when(F.col(c) <= k, F.col(target)))
    return rows.groupBy("date").agg(mean("_u").alias("long_ret"), mean("_d").alias("short_ret")).filter("long_ret IS NOT NULL").withColumn("ls_ret", F.col("long_ret") - F.col("short_ret"))
