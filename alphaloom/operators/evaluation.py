"""Statistical evaluation of signals on the long panel (date, ticker, alpha, value, target).

Signals are unpivoted to rows once, so every statistic is one or two aggregations keyed by (date, alpha).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import div
from ..functions.ranks import average_rank, pct_rank

DAY = ["alpha", "date"]


def unpivot(panel: DataFrame, alphas: list[str], target: str, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """Complete pairs only: (keys, target, alpha, value)."""
    rows = panel.select(*keys, F.col(target).alias("target"), *alphas).unpivot([*keys, "target"], list(alphas), "alpha", "value")
    return rows.filter(F.col("value").isNotNull() & F.col("target").isNotNull())


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate, NULL where one side is constant."""
    return div(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def daily_rank_ic(pairs: DataFrame, least: int = 50) -> DataFrame:
    """Spearman correlation of value and target by (alpha, date), of at least `least` pairs."""
    ranked = pairs.withColumns({"rv": average_rank(F.col("value"), DAY), "rt": average_rank(F.col("target"), DAY)})
    out = ranked.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("rv"), F.col("rt")).alias("ic"))
    return out.filter((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(daily: DataFrame) -> DataFrame:
    mean, sd, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    out = daily.groupBy("alpha").agg(mean.alias("mean_ic"), sd.alias("std_ic"), n.alias("n_days"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"))
    return out.withColumn("icir", div(F.col("mean_ic"), F.col("std_ic"))).withColumn("t_stat", F.col("icir") * F.sqrt("n_days"))


def daily_ols(pairs: DataFrame, least: int = 50) -> DataFrame:
    """Univariate OLS of target on value by (alpha, date) with standard errors."""
    y, x = F.col("target"), F.col("value")
    s = pairs.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")
    ).filter((F.col("n") >= least) & (F.col("sxx") > 0))
    beta = F.col("sxy") / F.col("sxx")
    rss = F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0))
    s = s.withColumn("beta", beta).withColumn("intercept", F.col("my") - F.col("beta") * F.col("mx")).withColumn("residual_se", F.sqrt(div(rss, F.col("n") - 2.0)))
    s = s.withColumn("se", div(F.col("residual_se"), F.sqrt("sxx"))).withColumn("t", div(F.col("beta"), F.col("se")))
    s = s.withColumn("r2", 1 - div(rss, F.col("syy"))).withColumn("adj_r2", 1 - (1 - F.col("r2")) * (F.col("n") - 1) / F.nullif(F.col("n") - 2, F.lit(0)))
    return s.select(*DAY, "n", "intercept", "beta", "se", "t", "r2", "adj_r2", "residual_se")


def newey_west(series: DataFrame, x: str, lags: int, by: str | list[str] = "alpha") -> DataFrame:
    """Mean, plain t and Bartlett-weighted t of a series by date; the plain t where the long-run variance is not positive."""
    by = [by] if isinstance(by, str) else by
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("date")
    centred = series.filter(F.col(x).isNotNull()).withColumn("_c", F.col(x) - F.avg(x).over(group))
    centred = centred.withColumns({f"_g{k}": F.col("_c") * F.lag("_c", k).over(order) for k in range(1, lags + 1)})
    n = F.count(x)
    gamma = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / n
    variance = F.sum(F.col("_c") * F.col("_c")) / n
    for k in range(1, lags + 1):
        variance = variance + 2 * (1 - k / (lags + 1)) * gamma(F.col(f"_g{k}"))
    out = centred.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), variance.alias("lrv"))
    plain = div(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return out.select(*by, "n", "mean", plain.alias("t_plain"), F.when(F.col("lrv") > 0, div(F.col("mean"), F.sqrt(F.col("lrv") / F.col("n")))).otherwise(plain).alias("t_nw"))


def daily_statistics(panel: DataFrame, alphas: list[str], target: str, binary: tuple[str, ...] = (), least: int = 20, edge: float = 0.1) -> DataFrame:
    """alpha, date, n_rows, n, beta, ic, spread: all three statistics of a day from one exchange by (alpha, date).

    Each is NULL below `least` complete pairs, or where one side is constant. Signals of `binary` have the spread of group 1
    over group 0, the others that of the tails.
    """
    rows = panel.select("date", F.col(target).alias("target"), *alphas).unpivot(["date", "target"], list(alphas), "alpha", "value")
    both = F.col("value").isNotNull() & F.col("target").isNotNull()
    rows = rows.select(*DAY, F.when(both, F.col("value")).alias("value"), F.when(both, F.col("target")).alias("target"))
    y, x = F.col("target"), F.col("value")
    ranked = rows.withColumns({"_rv": average_rank(x, DAY), "_rt": average_rank(y, DAY), "_p": pct_rank(x, DAY)})
    tail = lambda c: F.avg(F.when(c, y))
    out = ranked.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(x).alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_sxy(y, x).alias("_sxy"), safe_corr(F.col("_rv"), F.col("_rt")).alias("ic"),
        (tail(F.col("_p") >= 1 - edge) - tail(F.col("_p") <= edge)).alias("_tails"), (tail(x == 1.0) - tail(x == 0.0)).alias("_groups"),
    )
    enough = F.col("n") >= least
    spread = F.when(F.col("alpha").isin(list(binary)), F.col("_groups")).otherwise(F.col("_tails")) if binary else F.col("_tails")
    return out.select(*DAY, "n_rows", "n", F.when(enough & (F.col("_sxx") > 0), F.col("_sxy") / F.col("_sxx")).alias("beta"), F.when(enough, F.col("ic")).alias("ic"), F.when(enough, spread).alias("spread"))


def fama_macbeth(pairs: DataFrame, lags: int = 5, least: int = 20) -> DataFrame:
    return newey_west(daily_ols(pairs, least), "beta", lags)


def decile_spread(pairs: DataFrame, least: int = 20, edge: float = 0.1) -> DataFrame:
    """Mean target of the top tail less that of the bottom tail by (alpha, date); tails by average percent rank."""
    ranked = pairs.withColumn("p", pct_rank(F.col("value"), DAY))
    top, bottom = F.avg(F.when(F.col("p") >= 1 - edge, F.col("target"))), F.avg(F.when(F.col("p") <= edge, F.col("target")))
    out = ranked.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), top.alias("top"), bottom.alias("bottom")).filter(F.col("n") >= least)
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def binary_spread(pairs: DataFrame, least: int = 20) -> DataFrame:
    """For 0/1 signals: mean target of group 1 less that of group 0."""
    one, zero = (F.avg(F.when(F.col("value") == v, F.col("target"))) for v in (1.0, 0.0))
    return pairs.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), (one - zero).alias("spread")).filter((F.col("n") >= least) & F.col("spread").isNotNull())


def ndcg(df: DataFrame, prediction: str, grade: str = "grade", on: str = "date", tie: str = "ticker", least: int = 50) -> DataFrame:
    """NDCG by date with the grade itself as gain."""
    rank = lambda c: F.row_number().over(Window.partitionBy(on).orderBy(F.desc(c), tie))
    gain = lambda r: F.sum(F.col(grade) / F.log2(F.col(r) + 1.0))
    out = df.withColumns({"_p": rank(prediction), "_i": rank(grade)}).groupBy(on).agg(F.count(F.lit(1)).alias("n"), gain("_p").alias("dcg"), gain("_i").alias("ideal"))
    return out.filter(F.col("n") >= least).select(on, "n", div(F.col("dcg"), F.col("ideal")).alias("ndcg"))


def prediction_metrics(df: DataFrame, least: int = 50, edge: float = 0.1) -> DataFrame:
    """Per date of (date, ticker, prediction, target): tails, spread, rank IC and Pearson IC, from one exchange by date."""
    p, t, on = F.col("prediction"), F.col("target"), ["date"]
    ranked = df.withColumns({"_rv": average_rank(p, on), "_rt": average_rank(t, on), "_p": pct_rank(p, on)})
    tail = lambda c: F.avg(F.when(c, t))
    out = ranked.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), tail(F.col("_p") >= 1 - edge).alias("top"), tail(F.col("_p") <= edge).alias("bottom"),
        safe_corr(F.col("_rv"), F.col("_rt")).alias("rank_ic"), safe_corr(p, t).alias("pearson_ic"),
    ).filter(F.col("n") >= least)
    return out.select("date", "n", "top", "bottom", (F.col("top") - F.col("bottom")).alias("spread"), "rank_ic", "pearson_ic")


def r_squared(df: DataFrame) -> DataFrame:
    """Pooled R2 of prediction against target."""
    p, t = F.col("prediction"), F.col("target")
    return df.filter(p.isNotNull() & t.isNotNull()).agg((1 - div(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t))).alias("r2"))
