"""From daily statistics to a verdict on each signal: p-values, betas by split, controls, classes, groups and scores.

Panels are aggregated on the executors; from there on a table has one row a signal (and target or variant).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.nulls import div
from .evaluation import DAY
from .selection import correlated_components, linear_score

ZERO = 1e-12

# ---------------------------------------------------------------- p-values


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 500) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, steps + 1):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + term * d), guard(1 + term / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's t; NaN where t is missing or df is not positive. Exact far out in the tail, too."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & (df > 0)
    v, s = np.where(ok, df, 1.0), np.where(ok, t, 0.0) ** 2
    x = v / (v + s)
    a, b = v / 2, np.full_like(v, 0.5)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log(s / (v + s)))
    near = x < (a + 1) / (a + b + 2)  # which of the two fractions converges
    lo = front * _beta_fraction(a, b, np.where(near, x, 0.0)) / a
    hi = 1 - front * _beta_fraction(b, a, np.where(near, 0.0, s / (v + s))) / b
    return np.where(ok, np.where(s == 0, 1.0, np.where(near, lo, hi)), np.nan)


@F.pandas_udf(DoubleType())
def _p(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(two_sided_p(t.to_numpy(float), df.to_numpy(float)))
    return p.astype(object).where(p.notna(), None)


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic, for summary tables: NULL without t or without degrees of freedom."""
    return _p(t.cast("double"), df.cast("double"))


def with_p(daily: DataFrame) -> DataFrame:
    """Adds p to daily univariate regressions."""
    return daily.withColumn("p", p_value(F.col("t"), F.col("n") - 2))


# ---------------------------------------------------------------- regressions over time


def beta_summary(daily: DataFrame, splits: DataFrame) -> DataFrame:
    """One row a signal: mean beta, t and p over all dates and by split, sign agreement, daily averages.

    `daily` comes from `with_p`, `splits` has one row a date: bounded by the calendar, so it is broadcast.
    """
    beta, parts = F.col("beta"), ("train", "val", "test")
    aggs = [
        F.count(F.lit(1)).alias("n_days"), F.stddev_samp(beta).alias("std_beta"), F.avg("se").alias("mean_std_error"), F.avg("t").alias("mean_daily_t"),
        F.median("t").alias("median_daily_t"), F.avg("p").alias("mean_daily_p"), F.avg(F.coalesce(F.col("p") < 0.05, F.lit(False)).cast("double")).alias("significant_days_ratio"),
        F.avg((beta > 0).cast("double")).alias("positive_beta_ratio"), F.avg((beta < 0).cast("double")).alias("negative_beta_ratio"), F.avg("r2").alias("avg_r2"), F.avg("adj_r2").alias("avg_adj_r2"),
    ]
    for part in ("", *parts):
        x, pre = (beta, "") if not part else (F.when(F.col("split") == part, beta), f"{part}_")
        aggs += [F.avg(x).alias(f"{pre}beta_mean"), div(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))).alias(f"{pre}beta_t"), F.count(x).alias(f"_{pre}n")]
    out = daily.join(F.broadcast(splits), "date", "left").groupBy("alpha").agg(*aggs)
    for pre in ("", *(f"{part}_" for part in parts)):
        out = out.withColumn(f"{pre}beta_p", p_value(F.col(f"{pre}beta_t"), F.col(f"_{pre}n") - 1)).drop(f"_{pre}n")
    sign = {part: F.signum(f"{part}_beta_mean") for part in parts}
    held = (sign["val"] == sign["test"]) & (sign["val"] != 0)
    return out.withColumn("same_direction_val_test", F.coalesce(held, F.lit(False))).withColumn("same_direction_all", F.coalesce(held & (sign["train"] == sign["val"]), F.lit(False)))


def daily_ols_controls(panel: DataFrame, alphas: list[str], target: str, controls: list[str], least: int = 20) -> DataFrame:
    """alpha, date, n, beta, r2 of target on a signal and the controls by date, with intercept.

    A signal is no control of itself. Rows are complete cases of that regression; a date needs max(least, controls + 3).
    One aggregation yields the covariances of a date; controls are swept out of them one by one, and one without variance
    left (constant or a mix of the others) is passed over. beta is NULL where the controls explain the signal wholly.
    """
    keep = panel.select("date", F.col(target).alias("y"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(controls)), *alphas)
    held = [f"_c{i}" for i in range(len(controls))]
    rows = keep.unpivot(["date", "y", *held], list(alphas), "alpha", "x").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    rows = rows.withColumns({h: F.when(F.col("alpha") == c, 0.0).otherwise(F.col(h)) for h, c in zip(held, controls)}) if held else rows
    rows = rows.dropna(subset=held) if held else rows
    names = [*held, "x", "y"]
    cells = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    out = rows.groupBy(*DAY).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in cells))
    own = F.lit(len(controls)) - F.col("alpha").isin(list(controls)).cast("int") if controls else F.lit(0)
    out = out.filter(F.col("n") >= F.greatest(F.lit(least), own + 3)).withColumns({f"0{a}": F.col(f"{a}|{a}") for a in names})
    for k, c in enumerate([*held, "x"]):
        used = F.col(f"{c}|{c}") > ZERO * F.col(f"0{c}")
        if c == "x":
            out = out.withColumn("beta", F.when(used, div(F.col("x|y"), F.col("x|x"))))
        rest = names[k + 1 :]
        swept = {
            f"{a}|{b}": F.when(used, F.col(f"{a}|{b}") - F.col(f"{c}|{a}") * div(F.col(f"{c}|{b}"), F.col(f"{c}|{c}"))).otherwise(F.col(f"{a}|{b}"))
            for i, a in enumerate(rest) for b in rest[i:]
        }
        out = out.withColumns(swept)
    return out.select(*DAY, "n", "beta", F.when(F.col("0y") > 0, 1 - F.greatest(F.col("y|y"), F.lit(0.0)) / F.nullif(F.col("0y"), F.lit(0.0))).alias("r2"))


# ---------------------------------------------------------------- classes of single signals


def direction_of(x: Column) -> Column:
    return F.when(x.isNull() | (F.abs(x) <= ZERO), "Neutral").when(x > 0, "Positive").otherwise("Reverse")


def evidence_class(table: DataFrame) -> DataFrame:
    """Adds ic_direction, beta_direction, final_direction, alpha_class and aligned_action.

    Reads missing_ratio, ic_n_days, mean_ic, ic_t, ic_p, n_days, beta_mean, beta_t, beta_p, val_beta_mean, test_beta_mean and
    same_direction_all. A statistic that is NULL supports nothing; a signal missing in more than half of its rows is invalid.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    col = F.col
    beta_t2, ic_t2 = yes(F.abs("beta_t") >= 2), yes(F.abs("ic_t") >= 2)
    beta_05, beta_10 = yes(col("beta_p") <= 0.05), yes(col("beta_p") <= 0.10)
    beta_ok, ic_ok = beta_05 | beta_t2, ic_t2 | yes(col("ic_p") <= 0.05)
    signed = lambda d: col(d).isin("Positive", "Reverse")
    out = table.withColumns({"ic_direction": direction_of(col("mean_ic")), "beta_direction": direction_of(col("beta_mean"))})
    conflict = signed("ic_direction") & signed("beta_direction") & (col("ic_direction") != col("beta_direction"))
    leaning = (
        F.when(signed("ic_direction") & (col("ic_direction") == col("beta_direction")), col("ic_direction"))
        .when(signed("beta_direction") & beta_ok & ~conflict, col("beta_direction")).when(signed("ic_direction") & ic_ok & ~conflict, col("ic_direction"))
    )
    out = out.withColumn("_leaning", leaning)
    later = [direction_of(col(c)) for c in ("val_beta_mean", "test_beta_mean")]
    holds = (later[0].isin("Positive", "Reverse") | later[1].isin("Positive", "Reverse")) & later[0].isin(col("_leaning"), "Neutral") & later[1].isin(col("_leaning"), "Neutral")
    lean, stable = col("_leaning").isNotNull(), yes(col("same_direction_all"))
    invalid = yes(col("missing_ratio") > 0.5) | col("missing_ratio").isNull() | (F.coalesce(col("ic_n_days"), F.lit(0)) == 0) | (F.coalesce(col("n_days"), F.lit(0)) == 0) | col("beta_p").isNull()
    kind = (
        F.when(invalid, "Missing / Invalid").when(conflict & (beta_ok | ic_ok), "Needs Review").when(~beta_ok & ~ic_ok, "Weak")
        .when(lean & beta_05 & beta_t2 & stable, F.concat(F.lit("Core "), col("_leaning"))).when(beta_ok & ~stable, "Unstable")
        .when(lean & (beta_10 | ic_t2) & holds, F.concat(F.lit("Potential "), col("_leaning"))).when(lean & (beta_10 | ic_ok), "Needs Review").otherwise("Weak")
    )
    out = out.withColumn("alpha_class", kind)
    final = F.when(invalid, "Missing / Invalid").when(col("alpha_class") == "Weak", "Weak").when(conflict & (col("alpha_class") == "Needs Review"), "Needs Review").otherwise(F.coalesce("_leaning", F.lit("Needs Review")))
    action = F.when(col("alpha_class").isin("Core Positive", "Potential Positive"), "keep_as_is").when(col("alpha_class").isin("Core Reverse", "Potential Reverse"), "multiply_by_minus_one").otherwise("exclude")
    return out.withColumn("final_direction", final).withColumn("aligned_action", action).drop("_leaning")


#: Words that speak for a signal's name in the keeper order: fixed values.
CLEAR_TERMS = ("momentum", "return", "volatility", "volume", "liquidity", "trend", "range", "drawdown", "macd", "rsi")


def redundancy(classed: DataFrame, pairs: DataFrame, limit: float = 0.85) -> DataFrame:
    """Adds redundancy_group_id and redundancy_decision: of candidates linked by |correlation| >= limit, one stays.

    The table has one row a signal; it and the graph of its candidates are held on the driver. The keeper has the stronger class, then smaller
    beta_p, larger |beta_t|, |ic_t| and avg_r2, less missing, the clearer name and at last the first name.
    """
    col, alpha = F.col, F.col("alpha")
    rows = classed.collect()  # one row a signal; read once, so that the panel behind it is not computed again
    out = classed.sparkSession.createDataFrame(rows, classed.schema).withColumn("_candidate", col("aligned_action") != "exclude")
    names = sorted(r["alpha"] for r in rows if r["aligned_action"] != "exclude")
    known = set(names)
    edges = [(r["a"], r["b"], r["corr"]) for r in pairs.filter(F.abs("corr") >= limit).select("a", "b", "corr").collect()]
    heads = correlated_components(names, [e for e in edges if e[0] in known and e[1] in known], limit)
    sizes = pd.Series(heads, dtype=object).value_counts()
    ids = {h: f"RG{k:02d}" for k, h in enumerate(sorted(h for h in sizes.index if sizes[h] > 1), 1)}
    member = classed.sparkSession.createDataFrame([(a, ids[h]) for a, h in heads.items() if h in ids], "alpha string, redundancy_group_id string")
    clarity = sum((F.contains(alpha, F.lit(t)).cast("int") for t in CLEAR_TERMS), F.lit(0)) - F.contains(alpha, F.lit("reversal")).cast("int")
    level = F.when(col("alpha_class").startswith("Core"), 3).when(col("alpha_class").startswith("Potential"), 2).otherwise(1)
    order = [level.desc(), col("beta_p").asc_nulls_last(), F.abs("beta_t").desc_nulls_last(), F.abs("ic_t").desc_nulls_last(), col("avg_r2").desc_nulls_last(), col("missing_ratio").asc_nulls_last(), clarity.desc(), alpha]
    out = out.join(F.broadcast(member), "alpha", "left").withColumn("_k", F.row_number().over(Window.partitionBy("redundancy_group_id").orderBy(*order)))
    decision = F.when(~col("_candidate"), "not_candidate").when(col("redundancy_group_id").isNull() | (col("_k") == 1), "keep").otherwise("drop_redundant")
    return out.withColumn("redundancy_decision", decision).drop("_candidate", "_k")


def recommendation(kind: Column, decision: Column) -> Column:
    kept = decision == "keep"
    return (
        F.when(decision == "drop_redundant", "Drop").when(kind.isin("Core Positive", "Core Reverse") & kept, "Strong Keep").when(kind.isin("Potential Positive", "Potential Reverse") & kept, "Optional Keep")
        .when(kind.isin("Needs Review", "Unstable"), "Review").otherwise("Drop")
    )


# ---------------------------------------------------------------- many methods together


def best_linear(results: DataFrame, left: str, right: str) -> DataFrame:
    """One row an alpha of (alpha, target, variant, beta_t, ic_t, spread_t, mean_ic, coverage).

    The row with the largest linear score (then coverage, then target and variant) stays, with the share of variants whose
    mean IC has the same sign for the targets `left` and `right`, zeros left out; 0 without any such variant.
    """
    scored = results.withColumn("linear_score", linear_score(F.col("beta_t"), F.col("ic_t"), F.col("spread_t")))
    best = Window.partitionBy("alpha").orderBy(F.desc("linear_score"), F.col("coverage").desc_nulls_last(), "target", "variant")
    top = scored.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")
    one = lambda t: F.max(F.when(F.col("target") == t, F.col("mean_ic")))
    sides = results.groupBy("alpha", "variant").agg(one(left).alias("l"), one(right).alias("r")).filter("l <> 0 AND r <> 0")
    agree = sides.groupBy("alpha").agg(F.avg((F.signum("l") == F.signum("r")).cast("double")).alias("horizon_consistency"))
    return top.join(agree, "alpha", "left").fillna(0.0, ["horizon_consistency"])


def method_groups(table: DataFrame) -> DataFrame:
    """Adds ranker_strong, ranker_moderate and method_group.

    Reads linear_score, regularized (chosen by lasso or elastic net), average_rank, best_rank, best_gain, horizon_consistency:
    one row a signal, so the upper quartile of gain is one small aggregate.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    quartile = table.agg(F.percentile("best_gain", 0.75).alias("_q"))
    out = table.crossJoin(F.broadcast(quartile))  # one row on the right
    out = out.withColumn("ranker_strong", yes(F.col("average_rank") <= 20) | yes(F.col("best_rank") <= 5) | yes(F.col("best_gain") >= F.col("_q")))
    out = out.withColumn("ranker_moderate", yes(F.col("average_rank") <= 30) | yes(F.col("best_rank") <= 15)).drop("_q")
    score = F.coalesce("linear_score", F.lit(0.0))
    strong, moderate, chosen, ranker = score >= 0.55, score >= 0.40, yes(F.col("regularized")), F.col("ranker_strong")
    return out.withColumn(
        "method_group",
        F.when(strong & chosen & ranker, "core_alpha").when(ranker & ~strong & ~chosen, "nonlinear_alpha").when(strong & ~chosen & ~ranker, "linear_only_alpha")
        .when(strong & ~chosen & ranker, "redundant_alpha").when(chosen | moderate | F.col("ranker_moderate") | yes(F.col("horizon_consistency") >= 0.5), "watchlist_alpha").otherwise("rejected_alpha"),
    )


def lasso_support(chosen: Column, lasso_count: Column, net_count: Column) -> Column:
    times = F.coalesce(lasso_count, F.lit(0)) + F.coalesce(net_count, F.lit(0))
    return 0.75 * F.coalesce(chosen, F.lit(False)).cast("double") + 0.25 * F.least(times / 4.0, F.lit(1.0))


def ranker_support(gain: Column, largest_gain: Column, average_rank: Column, best_rank: Column) -> Column:
    """Gain against the largest, and ranks against 50; NULL where a part is missing."""
    of50 = lambda r: F.when(r.isNotNull(), F.greatest(50 - r, F.lit(0.0)) / 50.0)
    share = F.when(largest_gain.isNull() | (largest_gain == 0), 0.0).otherwise(div(gain, largest_gain))
    s = 0.40 * share + 0.35 * of50(average_rank) + 0.25 * of50(best_rank)
    return F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


def ic_support(selected: Column, survived: Column, t: Column) -> Column:
    return F.when(selected, 1.0).when(survived, 0.70).when(t.isNotNull(), 0.40 * F.least(F.abs(t) / 2.0, F.lit(1.0)))


#: Ablation support by signal id: fixed values.
ABLATION_SUPPORT = {32: 0.65, 54: 0.75, 55: 0.80, 65: 0.75, 68: 0.55}
#: Signal ids of the final groups: fixed values.
CORE_IDS = (32, 53, 54, 55, 56, 58, 59, 60, 65, 66)
INTERACTION_IDS = (30, 34, 57, 61, 62, 63, 68, 73)


def final_score(linear: Column, lasso: Column, ranker: Column, ic: Column, ablation: Column) -> Column:
    """Weighted support of five methods; a missing one counts as none."""
    part = lambda w, c: w * F.coalesce(c, F.lit(0.0))
    return part(0.25, linear) + part(0.15, lasso) + part(0.25, ranker) + part(0.25, ic) + part(0.10, ablation)


def final_candidates(table: DataFrame) -> DataFrame:
    """Adds ablation_support, final_score and final_group.

    Reads alpha_id, linear_support, lasso_support, ranker_support, ic_support, selected_by_ic, selected_by_ranker,
    selected_by_linear and redundancy_status: one row a signal. A flag that is NULL is false.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    i = F.col("alpha_id")
    ablation = F.coalesce(*(F.when(i == k, v) for k, v in ABLATION_SUPPORT.items()), F.lit(0.0))
    out = table.withColumn("ablation_support", ablation)
    out = out.withColumn("final_score", final_score(*(F.col(f"{c}_support") for c in ("linear", "lasso", "ranker", "ic", "ablation"))))
    wanted = yes("selected_by_ranker") | F.coalesce(F.col("ranker_support") >= 0.35, F.lit(False)) | yes("selected_by_linear")
    watched = yes("selected_by_ranker") | yes("selected_by_linear") | F.coalesce(F.col("ic_support") >= 0.45, F.lit(False))
    redundant = F.coalesce(F.col("redundancy_status") == "dropped_redundant", F.lit(False)) & i.isin(31, 52)
    group = (
        F.when((i.isin(*CORE_IDS) & yes("selected_by_ic")) | (i == 55), "final_core_candidates").when((i == 68) | (i.isin(*INTERACTION_IDS) & wanted), "final_interaction_candidates")
        .when(redundant | watched, "final_watchlist_candidates").otherwise("final_excluded_for_now")
    )
    return out.withColumn("final_group", group)


def ablation_deltas(results: DataFrame, metrics: list[str], baseline: str = "baseline_current") -> DataFrame:
    """Adds `<metric>_delta` against the baseline experiment of the same variant and objective; NULL without one."""
    keys = ["variant", "objective"]
    base = results.filter(F.col("experiment") == baseline).groupBy(*keys).agg(*(F.max(m).alias(f"_{m}") for m in metrics))
    out = results.join(F.broadcast(base), keys, "left")  # one row a variant and objective
    return out.withColumns({f"{m}_delta": F.col(m) - F.col(f"_{m}") for m in metrics}).drop(*(f"_{m}" for m in metrics))
