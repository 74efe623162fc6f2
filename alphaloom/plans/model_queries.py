"""Registered queries on enrichment, horizons and the rank trainer, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cross_section, enrichment, evaluation, horizons, labels, ranker, splits
from ..operators.bars import last_of_bucket
from . import panels as P
from . import sql as S
from .evidence_queries import _BETAS, _betas, _pairs
from .queries import _SUMMARY, _with_factors, query, r

# ---------------------------------------------------------------- enrichment

_MOVES = f"""{S.BARS}, mv AS (SELECT b.ticker, b.date, sector, industry, volume, ln(close / lag(close) OVER w) AS r, ln(close / lag(close, 63) OVER w) AS r63, ln(close / lag(close, 126) OVER w) AS r126, m.market_return AS m
  FROM bars b JOIN gics USING (ticker) LEFT JOIN market m ON m.date = b.date WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date)),
sx AS (SELECT sector, date, avg(r) AS sr FROM mv GROUP BY 1, 2)"""


def _moves(spark, d, ids=(26, 30)) -> DataFrame:
    rows = P.signals(spark, d, list(ids))
    return rows.join(P.gics(spark, d).select("ticker", "sector"), "ticker")


def _sector_returns(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sector", "date").agg(F.avg("alpha_26").alias("index_return"))


@query("alpha_enriched", f"""WITH {_MOVES}, e AS (SELECT *, count(r126) OVER v AS n, median(r126) OVER v AS med, CASE WHEN count(CASE WHEN r IS NOT NULL THEN m END) OVER f >= 252 THEN covar_samp(r, m) OVER f / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) OVER f, 0) END AS beta
  FROM mv WINDOW v AS (PARTITION BY date, sector), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT e.ticker, e.date, round(CASE WHEN n >= 5 THEN r126 - med END, 8) AS alpha_34, CAST(NULL AS DOUBLE) AS alpha_35, round(beta, 8) AS alpha_60, round(volume / nullif(float_shares, 0), 8) AS alpha_66 FROM e ASOF LEFT JOIN floats s ON e.ticker = s.ticker AND e.date >= s.date""")
def alpha_enriched(spark, d):
    daily = P.bars(spark, d)
    out = enrichment.enrich(_moves(spark, d), market=P.market(daily), snapshots=P.float_shares(daily))
    return out.select("ticker", "date", *(f"alpha_{k}" for k in (34, 35, 60, 66)))


@query("alpha_enriched_residual")
def alpha_enriched_residual(spark, d):
    """Residual momentum and volatility of the enrichment, from complete windows."""
    rows = _with_factors(spark, d)
    return enrichment.residual_signals(rows, "excess", ["mkt", "smb", "hml", "mom"]).select("ticker", "date", "alpha_33", "alpha_59")


@query("alpha_builder_residual")
def alpha_builder_residual(spark, d):
    """The batch builder's form: the raw return on the market and every factor, 232 rows, not annualised."""
    rows = _with_factors(spark, d)
    return enrichment.residual_signals(rows, "alpha_26", ["mkt", "smb", "hml", "mom", "rf"], 232, annual=False).select("ticker", "date", "alpha_33", "alpha_59")


@query("alpha_34_builder", f"""WITH {_MOVES} SELECT mv.ticker, mv.date, round(r63 - CASE WHEN count(sr) OVER f >= 63 THEN sum(sr) OVER f END, 8) AS alpha_34
FROM mv LEFT JOIN sx USING (sector, date) WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def alpha_34_builder(spark, d):
    rows = _moves(spark, d, (26, 29))
    out = enrichment.group_return_sum(rows.join(_sector_returns(rows), ["sector", "date"], "left"), "index_return", "_sum")
    return out.select("ticker", "date", (F.col("alpha_29") - F.col("_sum")).alias("alpha_34"))


@query("alpha_34_sector_index", f"""WITH {_MOVES}, i AS (SELECT sector, date, CASE WHEN count(sr) OVER f >= 126 THEN sum(sr) OVER f END AS im FROM sx WINDOW f AS (PARTITION BY sector ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW))
SELECT ticker, mv.date, round(r126 - im, 8) AS alpha_34 FROM mv LEFT JOIN i USING (sector, date)""")
def alpha_34_sector_index(spark, d):
    rows = _moves(spark, d)
    return enrichment.minus_index_momentum(rows, _sector_returns(rows), "alpha_30").select("ticker", "date", "alpha_34")


# ---------------------------------------------------------------- horizons

_LAGS = {"5": 5, "21": 21}
_DATES = 60


def _nw(tag: str, rel: str, x: str, lags: int) -> str:
    """CTE `{tag}`: alpha, n, mean and Newey-West t of x by alpha."""
    gaps = ", ".join(f"c * lag(c, {k}) OVER o AS g{k}" for k in range(1, lags + 1))
    tail = " + ".join(f"2 * (1 - {k} / {lags + 1}.0) * coalesce(sum(g{k}), 0) / count(*)" for k in range(1, lags + 1))
    return f"""{tag}g AS (SELECT *, {gaps} FROM (SELECT alpha, date, {x} AS x, {x} - avg({x}) OVER (PARTITION BY alpha) AS c FROM {rel} WHERE {x} IS NOT NULL) WINDOW o AS (PARTITION BY alpha ORDER BY date)),
{tag} AS (SELECT alpha, n, mean, CASE WHEN lrv > 0 THEN mean / sqrt(lrv / n) ELSE mean / nullif(sd / sqrt(n), 0) END AS t FROM (SELECT alpha, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, sum(c * c) / count(*) + {tail} AS lrv FROM {tag}g GROUP BY 1))"""


def _one_target(h: str) -> str:
    names = ", ".join(P.NAMES)
    return f"""u{h} AS (SELECT date, ticker, t{h} AS target, alpha, value FROM (UNPIVOT (SELECT date, ticker, t{h}, {names} FROM pp) ON {names} INTO NAME alpha VALUE value) WHERE value IS NOT NULL AND t{h} IS NOT NULL),
o{h} AS (SELECT alpha, date, count(*) AS n, regr_sxy(target, value) / regr_sxx(target, value) AS beta FROM u{h} GROUP BY 1, 2 HAVING count(*) >= 50 AND regr_sxx(target, value) > 0),
i{h} AS (SELECT alpha, date, CASE WHEN stddev_samp(rv) > 0 AND stddev_samp(rt) > 0 THEN corr(rv, rt) END AS ic FROM (SELECT *, {S.avg_rank("value", "alpha, date")} AS rv, {S.avg_rank("target", "alpha, date")} AS rt FROM u{h}) GROUP BY 1, 2 HAVING count(*) >= 50),
d{h} AS (SELECT alpha, date, avg(target) FILTER (pr >= 0.9) - avg(target) FILTER (pr <= 0.1) AS spread FROM (SELECT *, {S.pct_rank("value", "alpha, date")} AS pr FROM u{h}) GROUP BY 1, 2 HAVING count(*) >= 50),
{_nw(f"nb{h}", f"o{h}", "beta", _LAGS[h])}, {_nw(f"ni{h}", f"i{h}", "ic", _LAGS[h])}, {_nw(f"nd{h}", f"d{h}", "spread", _LAGS[h])},
c{h} AS (SELECT 'fwd_cc_{h}d' AS target, alpha, n_obs, nb{h}.n AS n_dates, nb{h}.mean AS beta_mean, nb{h}.t AS beta_t, ni{h}.mean AS ic_mean, ni{h}.t AS ic_t, nd{h}.mean AS spread_mean, nd{h}.t AS spread_t,
  n_obs / (SELECT count(*) FROM pp) AS coverage, CASE WHEN nb{h}.n < {_DATES} THEN 'low_valid_dates;' ELSE '' END AS warning_flags
  FROM (SELECT alpha, sum(n) AS n_obs FROM o{h} GROUP BY 1) LEFT JOIN nb{h} USING (alpha) LEFT JOIN ni{h} USING (alpha) LEFT JOIN nd{h} USING (alpha))"""


_HORIZON = f"""{S.BARS}, {S.SIGNALS}, hh AS (SELECT ticker, date AS day, date_trunc('month', date)::DATE AS date, {", ".join(f"{S.ALPHA[k]} AS alpha_{k}" for k in P.ALPHAS)},
  ln(lead(close, 5) OVER w / close) AS t5, ln(lead(close, 21) OVER w / close) AS t21 FROM s3 {S.WINDOWS}),
pp AS (SELECT * FROM hh QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY day DESC) = 1), {_one_target("5")}, {_one_target("21")},
st AS (SELECT alpha, sign(a.beta_mean) = sign(b.beta_mean) AND coalesce(sign(a.ic_mean), 0) = coalesce(sign(b.ic_mean), 0) AND sign(a.beta_mean) <> 0 AS stable FROM c5 a JOIN c21 b USING (alpha)),
al AS (SELECT c.*, coalesce(stable, false) AS stable FROM (SELECT * FROM c5 UNION ALL SELECT * FROM c21) c LEFT JOIN st USING (alpha))"""
_HCOLS = "coverage, beta_mean, beta_t, ic_mean, ic_t, spread_mean, spread_t"


def _stability(spark, d) -> DataFrame:
    panel = P.month_panel(spark, d, horizons=(5, 21))
    both = [horizons.combined_summary(panel, P.NAMES, f"fwd_cc_{h}d", lags, least=50, least_dates=_DATES) for h, lags in _LAGS.items()]
    return horizons.add_stability(*both)


@query("horizon_stability", f"WITH {_HORIZON} SELECT target, alpha, n_obs::BIGINT AS n_obs, n_dates, warning_flags, stable, {r(_HCOLS, 6)} FROM al", 6)
def horizon_stability(spark, d):
    return _stability(spark, d)


@query("top_stable", f"WITH {_HORIZON} SELECT target, alpha, n_dates, {r('beta_t, ic_t, spread_t', 6)} FROM al WHERE stable AND n_dates >= {_DATES} ORDER BY abs(al.beta_t) DESC, abs(al.ic_t) DESC, abs(al.spread_t) DESC, alpha, target LIMIT 50", 6)
def top_stable(spark, d):
    return horizons.top_stable(_stability(spark, d), _DATES).select("target", "alpha", "n_dates", "beta_t", "ic_t", "spread_t")


@query("direction_agreement", f"""WITH {S.MONTH}, {S.IC}, {_SUMMARY}, {S.OLS}, {_BETAS} SELECT alpha, round(mean_ic, 6) AS mean_ic, round(beta_mean, 6) AS beta_mean, sign(mean_ic) = sign(beta_mean) AS agrees, round(coalesce(abs(t_stat), 0) + coalesce(abs(beta_t), 0), 6) AS combined_abs_t
FROM s JOIN bs USING (alpha) WHERE mean_ic <> 0 AND beta_mean <> 0""", 6)
def direction_agreement(spark, d):
    return horizons.direction_agreement(evaluation.ic_summary(evaluation.daily_rank_ic(_pairs(spark, d))), _betas(spark, d))


@query("cv_scores", f"WITH {S.MONTH}, {S.IC} SELECT alpha, round(avg(ic), 6) AS ic, round(avg(ic) / (stddev_pop(ic) + 1e-8), 6) AS icir, round(avg(ic) / (stddev_pop(ic) + 1e-8) * sqrt(252), 6) AS sharpe FROM ic GROUP BY 1 HAVING count(*) > 1", 6)
def cv_scores(spark, d):
    daily = evaluation.daily_rank_ic(_pairs(spark, d))
    return daily.groupBy("alpha").agg(*(horizons.cv_score(F.col("ic"), m).alias(m) for m in ("ic", "icir", "sharpe")), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


# ---------------------------------------------------------------- rank trainer

#: The signals of the small panel and those that the standard experiments name.
_ABLATED = sorted({*P.ALPHAS, *(k for e in ranker.EXPERIMENTS for k in (*e.force, *e.exclude))})


def _ablation_months(spark, d) -> DataFrame:
    """The rows of `month_panel` with the signals of the ablation, of which 34 needs a day's other tickers."""
    rows = P.signals(spark, d, sorted({*_ABLATED, 30} - {34})).join(P.gics(spark, d).select("ticker", "sector"), "ticker", "left")
    rows = cross_section.minus_sector_median(labels.add_labels(rows, (5,)), "alpha_30", "alpha_34")
    return last_of_bucket(rows, F.trunc("date", "month")).withColumn("date", F.col("bucket")).drop("bucket")


def _split_panel(months: DataFrame, names: list[str] = P.NAMES) -> DataFrame:
    panel = cross_section.transform(months, names, "B").select("date", "ticker", "fwd_cc_5d", *(f"{a}_rank" for a in names))  # no z-scores, no ranks by sector
    return ranker.cut(panel.join(F.broadcast(splits.date_split(panel)), "date"))  # the splits have one row a date


def _grid(objective: str, high: bool = False, rounds: int = 200) -> list[ranker.Params]:
    """The covering grid: all its trials, as many of the rounds as early stopping leaves."""
    return ranker.trials(objective, rounds, high)


@query("ranker_importance", digits=6)
def ranker_importance(spark, d):
    """Gains and ranks over two objectives."""
    panel, names, objectives = _split_panel(P.month_panel(spark, d)), [f"{a}_rank" for a in P.NAMES], ("pairwise", "ndcg")
    best = ranker.train_grids(panel, [(names, _grid(o)) for o in objectives], "fwd_cc_5d")
    parts = [ranker.importance(spark, model).withColumn("objective", F.lit(o)) for o, (model, _) in zip(objectives, best)]
    return horizons.importance_summary(reduce(DataFrame.unionByName, parts), "objective")


@query("ranker_diagnostics", digits=6)
def ranker_diagnostics(spark, d):
    """Daily diagnostics of a trained ranker on the val and test dates."""
    panel = _split_panel(P.month_panel(spark, d))
    model, _ = ranker.train_best(panel, [f"{a}_rank" for a in P.NAMES], "fwd_cc_5d", _grid("ndcg"))
    rows = ranker.predict(panel.filter("split <> 'train' AND fwd_cc_5d IS NOT NULL"), model, ["date", "ticker", "split", "fwd_cc_5d"]).withColumnRenamed("fwd_cc_5d", "target")
    return evaluation.prediction_metrics(rows).join(F.broadcast(splits.date_split(panel.select("date"))), "date")


@query("ranker_ablation", digits=6)
def ranker_ablation(spark, d):
    """The standard experiments with and without signals, against the baseline; all signals of the panel are usable and selected."""
    from ..operators.evidence import ablation_deltas

    columns = {k: f"alpha_{k}_rank" for k in _ABLATED}
    panel = _split_panel(_ablation_months(spark, d), [f"alpha_{k}" for k in _ABLATED])
    got = ranker.run_ablation(panel, columns, set(columns), set(columns), "fwd_cc_5d", tuple(_grid("pairwise", high, 500) for high in (False, True)))
    return ablation_deltas(got, ["val_rank_ic", "test_rank_ic"])
