"""Registered queries on the evidence about signals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, evidence, quality_checks, selection, splits
from . import panels as P
from . import sql as S
from .queries import _NW, _SUMMARY, query, r


def p_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom: a finite sum, another way than the operator's."""
    a = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({a}) * list_sum(list_transform(range(0, ({df}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos({a})))))"
    odd = f"2 / pi() * ({a} + sin({a}) * cos({a}) * coalesce(list_sum(list_transform(range(0, (({df}) - 1) // 2), lambda k: exp(0.5 * ln(pi()) + lgamma(k + 1) - ln(2) - lgamma(k + 1.5) + 2 * k * ln(cos({a}))))), 0))"
    return f"CASE WHEN {t} IS NOT NULL AND ({df}) > 0 THEN 1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END END"


_PARTS = ("", "train_", "val_", "test_")
_OLSP = f"olsp AS (SELECT *, {p_sql('t', 'n - 2')} AS p FROM ols)"
_BETAS = f"""{_OLSP}, dk AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM p)),
sp AS (SELECT date, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM dk),
bg AS (SELECT alpha, count(*) AS n_days, stddev_samp(beta) AS std_beta, avg(se) AS mean_std_error, avg(t) AS mean_daily_t, median(t) AS median_daily_t, avg(p) AS mean_daily_p, avg(coalesce(p < 0.05, false)::INT) AS significant_days_ratio,
avg((beta > 0)::INT) AS positive_beta_ratio, avg((beta < 0)::INT) AS negative_beta_ratio, avg(r2) AS avg_r2, avg(adj_r2) AS avg_adj_r2, """ + ", ".join(
    f"avg(beta) {f} AS {x}beta_mean, avg(beta) {f} / nullif(stddev_samp(beta) {f} / sqrt(count(beta) {f}), 0) AS {x}beta_t, count(beta) {f} AS {x}nb" for x in _PARTS for f in (f"FILTER (split = '{x[:-1]}')" if x else "",)
) + """ FROM olsp LEFT JOIN sp USING (date) GROUP BY 1),
bs AS (SELECT *, """ + ", ".join(f"{p_sql(f'{x}beta_t', f'{x}nb - 1')} AS {x}beta_p" for x in _PARTS) + """, coalesce(sign(val_beta_mean) = sign(test_beta_mean) AND sign(val_beta_mean) <> 0, false) AS same_direction_val_test,
coalesce(sign(val_beta_mean) = sign(test_beta_mean) AND sign(val_beta_mean) <> 0 AND sign(train_beta_mean) = sign(val_beta_mean), false) AS same_direction_all FROM bg)"""


def _pairs(spark, d):
    return evaluation.unpivot(P.month_panel(spark, d), P.NAMES, "fwd_cc_5d")


def _betas(spark, d) -> DataFrame:
    return evidence.beta_summary(evidence.with_p(evaluation.daily_ols(_pairs(spark, d))), splits.date_split(P.month_panel(spark, d)))


@query("ols_daily_p", f"WITH {S.MONTH}, {S.OLS}, {_OLSP} SELECT alpha, date, n, {r('beta, se, t, p', 6)} FROM olsp", 6)
def ols_daily_p(spark, d):
    return evidence.with_p(evaluation.daily_ols(_pairs(spark, d))).select("alpha", "date", "n", "beta", "se", "t", "p")


_BETA_COLS = "std_beta, mean_std_error, mean_daily_t, median_daily_t, mean_daily_p, significant_days_ratio, positive_beta_ratio, negative_beta_ratio, avg_r2, avg_adj_r2, " + ", ".join(f"{x}beta_{y}" for x in _PARTS for y in ("mean", "t", "p"))


@query("beta_summary", f"WITH {S.MONTH}, {S.OLS}, {_BETAS} SELECT alpha, n_days, {r(_BETA_COLS, 6)}, same_direction_val_test, same_direction_all FROM bs", 6)
def beta_summary(spark, d):
    return _betas(spark, d)


_TESTED, _CONTROLS = ("alpha_27", "alpha_39", "alpha_42", "alpha_64"), ("alpha_47", "alpha_54")


def _det(rows: list[list[str]]) -> str:
    (a, b, c), (e, f, g), (h, i, j) = rows
    return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {c} * ({e} * {i} - {f} * {h}))"


_A = [["xx", "xc", "xd"], ["xc", "cc", "cd"], ["xd", "cd", "dd"]]
_RHS = ["xy", "cy", "dy"]
_CRAMER = [f"{_det([[_RHS[i] if k == j else _A[i][k] for k in range(3)] for i in range(3)])} / {_det(_A)}" for j in range(3)]
_COVS = ", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in ("xx", "xc", "xd", "cc", "cd", "dd", "xy", "cy", "dy", "yy"))
_PARTIAL = f"""q AS (SELECT alpha, date, value AS x, pairs.target AS y, alpha_47 AS c, alpha_54 AS d FROM pairs JOIN p USING (date, ticker) WHERE alpha IN {_TESTED} AND alpha_47 IS NOT NULL AND alpha_54 IS NOT NULL),
z AS (SELECT alpha, date, count(*) AS n, {_COVS} FROM q GROUP BY 1, 2 HAVING count(*) >= 20),
ols AS (SELECT alpha, date, n, {_CRAMER[0]} AS beta, (({_CRAMER[0]}) * xy + ({_CRAMER[1]}) * cy + ({_CRAMER[2]}) * dy) / nullif(yy, 0) AS r2 FROM z)"""


def _partial(spark, d):
    return evidence.daily_ols_controls(P.month_panel(spark, d), list(_TESTED), "fwd_cc_5d", list(_CONTROLS))


@query("ols_controls_daily", f"WITH {S.MONTH}, {_PARTIAL} SELECT alpha, date, n, round(beta, 6) AS beta, round(r2, 6) AS r2 FROM ols", 6)
def ols_controls_daily(spark, d):
    return _partial(spark, d)


@query("fama_macbeth_controls", f"WITH {S.MONTH}, {_PARTIAL}, {_NW} SELECT alpha, n, round(mean, 6) AS mean, round(mean / (sd / sqrt(n)), 6) AS t_plain, round(CASE WHEN lrv > 0 THEN mean / sqrt(lrv / n) ELSE mean / (sd / sqrt(n)) END, 6) AS t_nw FROM v", 6)
def fama_macbeth_controls(spark, d):
    return evaluation.newey_west(_partial(spark, d), "beta", 5)


_EVIDENCE = f"""{S.IC}, {_SUMMARY}, {S.OLS}, {_BETAS}, ms AS ({" UNION ALL ".join(f"SELECT '{a}' AS alpha, avg(({a} IS NULL)::INT) AS missing_ratio FROM p" for a in P.NAMES)}),
e0 AS (SELECT alpha, missing_ratio, s.n_days AS ic_n_days, mean_ic, t_stat AS ic_t, {p_sql("t_stat", "s.n_days - 1")} AS ic_p, bs.* EXCLUDE (alpha),
CASE WHEN mean_ic IS NULL OR abs(mean_ic) <= 1e-12 THEN 'Neutral' WHEN mean_ic > 0 THEN 'Positive' ELSE 'Reverse' END AS ic_direction,
CASE WHEN beta_mean IS NULL OR abs(beta_mean) <= 1e-12 THEN 'Neutral' WHEN beta_mean > 0 THEN 'Positive' ELSE 'Reverse' END AS beta_direction FROM ms LEFT JOIN s USING (alpha) LEFT JOIN bs USING (alpha)),
e1 AS (SELECT *, coalesce(abs(beta_t) >= 2, false) AS bt, coalesce(abs(ic_t) >= 2, false) AS it, coalesce(beta_p <= 0.05, false) AS b5, coalesce(beta_p <= 0.1, false) AS b10, coalesce(ic_p <= 0.05, false) AS i5,
ic_direction <> beta_direction AND ic_direction <> 'Neutral' AND beta_direction <> 'Neutral' AS clash FROM e0),
e2 AS (SELECT *, CASE WHEN ic_direction = beta_direction AND ic_direction <> 'Neutral' THEN ic_direction WHEN beta_direction <> 'Neutral' AND (b5 OR bt) AND NOT clash THEN beta_direction
WHEN ic_direction <> 'Neutral' AND (i5 OR it) AND NOT clash THEN ic_direction END AS lean FROM e1),
e3 AS (SELECT *, CASE WHEN lean = 'Positive' THEN 1 WHEN lean = 'Reverse' THEN -1 END AS want, list_filter([val_beta_mean, test_beta_mean], lambda v: abs(v) > 1e-12) AS later FROM e2),
e4 AS (SELECT *, CASE WHEN missing_ratio > 0.5 OR coalesce(ic_n_days, 0) = 0 OR coalesce(n_days, 0) = 0 OR beta_p IS NULL THEN 'Missing / Invalid' WHEN clash AND (b5 OR bt OR i5 OR it) THEN 'Needs Review' WHEN NOT (b5 OR bt OR i5 OR it) THEN 'Weak'
WHEN lean IS NOT NULL AND b5 AND bt AND same_direction_all THEN 'Core ' || lean WHEN (b5 OR bt) AND NOT same_direction_all THEN 'Unstable'
WHEN lean IS NOT NULL AND (b10 OR it) AND len(later) > 0 AND len(list_filter(later, lambda v: sign(v) <> want)) = 0 THEN 'Potential ' || lean WHEN lean IS NOT NULL AND (b10 OR i5 OR it) THEN 'Needs Review' ELSE 'Weak' END AS alpha_class FROM e3),
ev AS (SELECT *, CASE WHEN alpha_class IN ('Missing / Invalid', 'Weak') THEN alpha_class WHEN clash AND alpha_class = 'Needs Review' THEN alpha_class ELSE coalesce(lean, 'Needs Review') END AS final_direction,
CASE WHEN alpha_class IN ('Core Positive', 'Potential Positive') THEN 'keep_as_is' WHEN alpha_class IN ('Core Reverse', 'Potential Reverse') THEN 'multiply_by_minus_one' ELSE 'exclude' END AS aligned_action,
0.40 * CASE WHEN beta_t IS NULL THEN 0 ELSE least(abs(beta_t) / 3, 1) END + 0.35 * CASE WHEN ic_t IS NULL THEN 0 ELSE least(abs(ic_t) / 3, 1) END AS linear_score FROM e4)"""


def _classed(spark, d) -> DataFrame:
    panel = P.month_panel(spark, d)
    ic = evaluation.ic_summary(evaluation.daily_rank_ic(_pairs(spark, d))).select("alpha", F.col("n_days").alias("ic_n_days"), "mean_ic", F.col("t_stat").alias("ic_t"))
    missing = quality_checks.missing_rates(panel, P.NAMES).select(F.col("column").alias("alpha"), F.col("missing_rate").alias("missing_ratio"))
    table = missing.join(ic.withColumn("ic_p", evidence.p_value(F.col("ic_t"), F.col("ic_n_days") - 1)), "alpha", "left").join(_betas(spark, d), "alpha", "left")
    return evidence.evidence_class(table).withColumn("linear_score", selection.linear_score(F.col("beta_t"), F.col("ic_t"), F.lit(None).cast("double")))


_CLASS_COLS = ("alpha", "ic_direction", "beta_direction", "final_direction", "alpha_class", "aligned_action")


@query("classify", f"WITH {S.MONTH}, {_EVIDENCE} SELECT {', '.join(_CLASS_COLS)}, {r('ic_t, ic_p, beta_t, beta_p, linear_score', 6)} FROM ev", 6)
def classify(spark, d):
    return _classed(spark, d).select(*_CLASS_COLS, "ic_t", "ic_p", "beta_t", "beta_p", "linear_score")


@query("redundancy_report", digits=6)
def redundancy_report(spark, d):
    """Classes, redundancy groups, keepers and recommendations."""
    pairs = selection.pair_correlation(P.month_panel(spark, d), P.NAMES, ["date", "ticker"])
    out = evidence.redundancy(_classed(spark, d), pairs)
    return out.select("alpha", "alpha_class", "redundancy_group_id", "redundancy_decision", evidence.recommendation(F.col("alpha_class"), F.col("redundancy_decision")).alias("recommendation"))


_METHODS = """mt AS (SELECT alpha, split_part(alpha, '_', 2)::INT AS alpha_id, linear_score, abs(ic_t) >= 2 AS regularized, rank() OVER (ORDER BY abs(beta_t) DESC NULLS LAST, alpha) * 8.0 AS average_rank, rank() OVER (ORDER BY abs(ic_t) DESC NULLS LAST, alpha) * 4.0 AS best_rank,
avg_r2 AS best_gain, CASE WHEN same_direction_val_test THEN 1.0 ELSE 0.0 END AS horizon_consistency, ic_t FROM ev),
mg AS (SELECT *, coalesce(average_rank <= 20 OR best_rank <= 5 OR best_gain >= quantile_cont(best_gain, 0.75) OVER (), false) AS ranker_strong, coalesce(average_rank <= 30 OR best_rank <= 15, false) AS ranker_moderate FROM mt)"""


def _methods(spark, d) -> DataFrame:
    """Evidence of the month panel; R2 and places by t statistics stand where a trained ranker's gains and ranks would."""
    place = lambda c: F.row_number().over(Window.orderBy(F.abs(c).desc_nulls_last(), "alpha"))  # noqa: E731  # one row a signal
    return _classed(spark, d).select(
        "alpha", F.element_at(F.split("alpha", "_"), 2).cast("int").alias("alpha_id"), "linear_score", (F.abs("ic_t") >= 2).alias("regularized"), (place("beta_t") * 8.0).alias("average_rank"), (place("ic_t") * 4.0).alias("best_rank"),
        F.col("avg_r2").alias("best_gain"), F.when(F.col("same_direction_val_test"), 1.0).otherwise(0.0).alias("horizon_consistency"), "ic_t",
    )


@query("method_groups", f"""WITH {S.MONTH}, {_EVIDENCE}, {_METHODS} SELECT alpha, ranker_strong, ranker_moderate, CASE WHEN linear_score >= 0.55 AND coalesce(regularized, false) AND ranker_strong THEN 'core_alpha'
WHEN ranker_strong AND linear_score < 0.55 AND NOT coalesce(regularized, false) THEN 'nonlinear_alpha' WHEN linear_score >= 0.55 AND NOT coalesce(regularized, false) AND NOT ranker_strong THEN 'linear_only_alpha'
WHEN linear_score >= 0.55 AND NOT coalesce(regularized, false) THEN 'redundant_alpha' WHEN coalesce(regularized, false) OR linear_score >= 0.4 OR ranker_moderate OR horizon_consistency >= 0.5 THEN 'watchlist_alpha' ELSE 'rejected_alpha' END AS method_group FROM mg""")
def method_groups(spark, d):
    return evidence.method_groups(_methods(spark, d)).select("alpha", "ranker_strong", "ranker_moderate", "method_group")


@query("final_candidates", f"""WITH {S.MONTH}, {_EVIDENCE}, {_METHODS}, fs AS (SELECT alpha, alpha_id, linear_score AS linear, 0.75 * coalesce(regularized, false)::INT + 0.25 * least(coalesce(regularized, false)::INT * 2 / 4.0, 1) AS lasso,
least(greatest(0.40 * CASE WHEN coalesce(max(best_gain) OVER (), 0) = 0 THEN 0 ELSE best_gain / max(best_gain) OVER () END + 0.35 * greatest(50 - average_rank, 0) / 50 + 0.25 * greatest(50 - best_rank, 0) / 50, 0), 1) AS ranker,
CASE WHEN abs(ic_t) >= 3 THEN 1.0 WHEN abs(ic_t) >= 2 THEN 0.7 WHEN ic_t IS NOT NULL THEN 0.4 * least(abs(ic_t) / 2, 1) END AS ic, coalesce(abs(ic_t) >= 3, false) AS by_ic, best_rank <= 10 OR average_rank <= 20 AS by_ranker, linear_score >= 0.55 AS by_linear FROM mt)
SELECT alpha, round(0.25 * linear + 0.15 * lasso + 0.25 * coalesce(ranker, 0) + 0.25 * coalesce(ic, 0) + CASE WHEN alpha_id = 54 THEN 0.075 ELSE 0 END, 6) AS final_score,
CASE WHEN alpha_id = 54 AND by_ic THEN 'final_core_candidates' WHEN by_ranker OR by_linear OR coalesce(ic >= 0.45, false) THEN 'final_watchlist_candidates' ELSE 'final_excluded_for_now' END AS final_group FROM fs""", 6)
def final_candidates(spark, d):
    m = _methods(spark, d)
    times = F.coalesce(F.col("regularized"), F.lit(False)).cast("int")
    largest = F.max("best_gain").over(Window.partitionBy())  # one row a signal
    chosen, survived = F.coalesce(F.abs("ic_t") >= 3, F.lit(False)), F.coalesce(F.abs("ic_t") >= 2, F.lit(False))
    table = m.select(
        "alpha", "alpha_id", F.col("linear_score").alias("linear_support"), evidence.lasso_support(F.col("regularized"), times, times).alias("lasso_support"),
        evidence.ranker_support(F.col("best_gain"), largest, F.col("average_rank"), F.col("best_rank")).alias("ranker_support"), evidence.ic_support(chosen, survived, F.col("ic_t")).alias("ic_support"),
        chosen.alias("selected_by_ic"), ((F.col("best_rank") <= 10) | (F.col("average_rank") <= 20)).alias("selected_by_ranker"), (F.col("linear_score") >= 0.55).alias("selected_by_linear"), F.lit("").alias("redundancy_status"),
    )
    return evidence.final_candidates(table).select("alpha", "final_score", "final_group")
