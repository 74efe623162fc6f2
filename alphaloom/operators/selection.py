"""Signal selection: filters, redundancy, scores and classes. Tables here have one row a signal or pair of signals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank
from .evaluation import safe_corr


def significant(summary: DataFrame, t: str = "t_stat", least: float = 2.0) -> DataFrame:
    return summary.filter(F.abs(t) >= least)


def pair_correlation(panel: DataFrame, alphas: list[str], keys: list[str], rank: bool = False, least: int = 50, buckets: int = 32) -> DataFrame:
    """a, b, n, corr over rows where both have values; ranks are taken within each pair, after its missing rows are gone.

    A row yields its pairs where it is, without a join. Plain correlations are partial aggregates. Ranks are taken in buckets
    of each signal's values, cut at its approximate quantiles, and moved by the sizes of the buckets below; so a pair is
    ranked by many tasks. Equal values lie in one bucket.
    """
    names = sorted(alphas)
    value = lambda a: F.struct(F.lit(a).alias("k"), F.col(a).cast("double").alias("v"), (F.col(f"_b_{a}") if rank else F.lit(0)).alias("b"))
    rows = panel.select(*names)
    if rank:
        cuts = [k / buckets for k in range(1, buckets)]
        edges = rows.agg(*(F.percentile_approx(a, cuts, 1000).alias(a) for a in names)).first()  # `buckets` values a signal
        place = lambda a: sum(((F.col(a) > float(e)).cast("int") for e in sorted(set(edges[a] or []))), F.lit(0))
        rows = rows.withColumns({f"_b_{a}": place(a) for a in names})
    pairs = F.array(*(F.struct(value(a).alias("l"), value(b).alias("r")) for i, a in enumerate(names) for b in names[i + 1 :])) if len(names) > 1 else F.array().cast("array<struct<l:struct<k:string,v:double,b:int>,r:struct<k:string,v:double,b:int>>>")
    rows = rows.select(F.explode(pairs).alias("p")).filter("p.l.v IS NOT NULL AND p.r.v IS NOT NULL")
    rows = rows.select(F.col("p.l.k").alias("a"), F.col("p.r.k").alias("b"), F.col("p.l.v").alias("x"), F.col("p.r.v").alias("y"), F.col("p.l.b").alias("bx"), F.col("p.r.b").alias("by"))
    if rank:  # one small aggregate gives the sizes of both signals' buckets
        cells = rows.groupBy("a", "b", "bx", "by").agg(F.count(F.lit(1)).alias("_n"))
        sizes = {}
        for bucket in ("bx", "by"):
            below = Window.partitionBy("a", "b").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
            own = cells.groupBy("a", "b", bucket).agg(F.sum("_n").alias("_n"))
            sizes[bucket] = own.select("a", "b", bucket, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"))
        for c, bucket in (("x", "bx"), ("y", "by")):
            own = ["a", "b", bucket]
            rows = rows.withColumn(c, average_rank(F.col(c), own)).join(sizes[bucket], own).withColumn(c, F.col(c) + F.col("_below")).drop("_below")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), safe_corr(F.col("x"), F.col("y")).alias("corr")).filter(F.col("n") >= least)


def greedy_clusters(strength: list[tuple[str, float]], corr: dict[tuple[str, str], float], limit: float = 0.8) -> list[tuple[str, str, int]]:
    """(alpha, head, cluster): the strongest free signal heads a cluster of the free ones that correlate with it."""
    free = [a for a, _ in sorted(strength, key=lambda s: (-abs(s[1]), s[0]))]
    out, n = [], 0
    while free:
        head = free[0]
        own = [a for a in free if a == head or abs(corr.get((min(a, head), max(a, head)), 0.0)) >= limit]
        n += 1
        out += [(a, head, n) for a in own]
        free = [a for a in free if a not in own]
    return out


def redundancy_clusters(summary: DataFrame, pairs: DataFrame, limit: float = 0.8) -> DataFrame:
    """Greedy clusters of at most some dozens of signals, on the driver."""
    strength = [(r["alpha"], r["icir"] or 0.0) for r in summary.select("alpha", "icir").collect()]
    corr = {(r["a"], r["b"]): r["corr"] for r in pairs.filter(F.abs("corr") >= limit).collect()}  # linked pairs of signals only
    rows = greedy_clusters(strength, corr, limit)
    return summary.sparkSession.createDataFrame(rows, "alpha string, head string, cluster int").withColumn("is_head", F.col("alpha") == F.col("head"))


def correlated_components(names: list[str], pairs: list[tuple[str, str, float]], limit: float = 0.85) -> dict[str, str]:
    """Connected components of the graph of correlated signals; each is named by its first."""
    root = {a: a for a in names}

    def find(a: str) -> str:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b, c in pairs:
        if abs(c) >= limit:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {a: find(a) for a in names}


def ordered_drop(names: list[str], corr: dict[tuple[str, str], float], limit: float = 0.85) -> list[str]:
    """Keep signals in order, dropping each that correlates with a kept one."""
    kept: list[str] = []
    for a in names:
        if all(abs(corr.get((min(a, k), max(a, k)), 0.0)) <= limit for k in kept):
            kept.append(a)
    return kept


def linear_score(beta_t: Column, ic_t: Column, spread_t: Column) -> Column:
    """0.40, 0.35 and 0.25 of the three t statistics, each full at 3."""
    part = lambda t: F.when(t.isNull(), 0.0).otherwise(F.least(F.abs(t) / 3, F.lit(1.0)))
    return 0.40 * part(beta_t) + 0.35 * part(ic_t) + 0.25 * part(spread_t)


def sign_agreement(table: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Share of rows whose two measures agree in sign, zeros left out."""
    same = F.when((F.col(a) != 0) & (F.col(b) != 0), (F.signum(a) == F.signum(b)).cast("double"))
    return table.groupBy(*by).agg(F.avg(same).alias("agreement"), F.count(same).alias("n"))


# ---------------------------------------------------------------- regularised regression


def imputed(panel: DataFrame, features: list[str], fold: str, train: int = 0) -> DataFrame:
    """Missing features are replaced by their approximate median over the dates of the first fold, which every fit trains on."""
    medians = panel.filter(F.col(fold) <= train).agg(*(F.percentile_approx(f, 0.5, 10_000).alias(f) for f in features)).first()  # one value a feature
    return panel.fillna({f: float(medians[f]) for f in features if medians[f] is not None})


def gram(panel: DataFrame, features: list[str], target: str, fold: str) -> dict[int, tuple[float, np.ndarray]]:
    """Cross products of (1, features, target) by fold, summed on the executors: rows of complete data only."""
    names = ["_one", *features, target]
    rows = panel.withColumn("_one", F.lit(1.0)).dropna(subset=[*features, target])
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.groupBy(fold).agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i, j in pairs)).collect()  # one row a fold
    out = {}
    for r in got:
        g = np.zeros((len(names), len(names)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"s_{i}_{j}"]
        out[r[fold]] = (g[0, 0], g)
    return out


def elastic_net(g: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray | None = None, sweeps: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent on standardised features, from cross products of (1, features, target).

    Minimises |y - Xb|^2 / 2n + alpha * l1_ratio * |b|_1 + alpha * (1 - l1_ratio) / 2 * |b|^2 with population-scaled features.
    """
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.diag(cov)[:-1])
    sd[sd == 0] = 1.0
    q, c = cov[:-1, :-1] / np.outer(sd, sd), cov[:-1, -1] / sd
    b = np.zeros(len(sd)) if start is None else start.copy()
    for _ in range(sweeps):
        old = b.copy()
        for k in range(len(b)):
            if q[k, k] == 0:
                continue
            rho = c[k] - q[k] @ b + q[k, k] * b[k]
            b[k] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / (q[k, k] + alpha * (1 - l1_ratio))
        if np.abs(b - old).max() < tol:
            break
    return b


def elastic_net_cv(folds: dict[int, tuple[float, np.ndarray]], alphas: np.ndarray, l1_ratios: tuple[float, ...]) -> tuple[float, float, np.ndarray]:
    """Penalty and mix with the least mean squared error over expanding folds, and the coefficients on all rows."""
    order = sorted(folds)
    total = sum(folds[k][1] for k in order)
    best = (math.inf, 0.0, 0.0)
    for ratio in l1_ratios:
        for a in sorted(alphas, reverse=True):
            errors = []
            for k in range(1, len(order)):
                train, test = sum(folds[f][1] for f in order[:k]), folds[order[k]][1]
                b = elastic_net(train, a, ratio)
                n, m = train[0, 0], train[0, 1:] / train[0, 0]
                sd = np.sqrt(np.diag(train[1:, 1:])[:-1] / n - m[:-1] ** 2)
                w = b / np.where(sd == 0, 1, sd)
                v = np.concatenate([[-(m[-1] - m[:-1] @ w)], -w, [1.0]])
                errors.append(v @ test @ v / test[0, 0])
            score = float(np.mean(errors)) if errors else math.inf
            if score < best[0] - 1e-15:
                best = (score, a, ratio)
    return best[1], best[2], elastic_net(total, best[1], best[2] or l1_ratios[0])
