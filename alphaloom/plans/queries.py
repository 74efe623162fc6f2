"""Registered queries over the test tables, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import pct_rank, unit_rank
from ..functions.rolling_ols import add_residual
from ..functions.signals import add_signals
from ..functions.windows import by_ticker
from ..operators import bars as B
from ..operators import cross_section, evaluation, labels, portfolio, quality_checks, ranker, selection, splits
from ..operators.asof import asof_backward
from ..sources import tables
from . import panels as P
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def query(name: str, oracle: str | None = None, digits: int = 8):
    """Registers a query; doubles are rounded on both sides, as sums differ in their last bits."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def r(cols: str, digits: int = 8) -> str:
    return ", ".join(f"round({c.strip()}, {digits}) AS {c.strip()}" for c in cols.split(","))


# ---------------------------------------------------------------- flagship, bars, validation


@query("momentum_top10", f"""WITH {S.MONTH}, k AS (SELECT date, ticker, alpha_27, {S.pct_rank("alpha_27", "date")} AS cs_rank, count(alpha_27) OVER (PARTITION BY date) AS n FROM p)
SELECT date, ticker, {r("alpha_27, cs_rank")} FROM k WHERE n >= 5 AND alpha_27 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY cs_rank DESC, ticker) <= 10""")
def momentum_top10(spark, d):
    """Which tickers rank highest on 5-day momentum each month."""
    ranked = P.month_panel(spark, d, (27,)).select("date", "ticker", "alpha_27", pct_rank(F.col("alpha_27"), ["date"]).alias("cs_rank"), F.count("alpha_27").over(Window.partitionBy("date")).alias("n"))
    top = Window.partitionBy("date").orderBy(F.desc("cs_rank"), "ticker")
    return ranked.filter("n >= 5 AND alpha_27 IS NOT NULL").withColumn("_k", F.row_number().over(top)).filter("_k <= 10").select("date", "ticker", "alpha_27", "cs_rank")


@query("bars_daily", f"WITH {S.BARS} SELECT ticker, date, {r('open, high, low, close, volume, daily_vwap')} FROM bars")
def bars_daily(spark, d):
    return P.bars(spark, d)


_MINUTES = "SELECT event_type AS ticker, ts, value AS px, (props::JSON ->> '$.k')::DOUBLE AS qty FROM events WHERE value > 0"


@query("minute_to_daily", f"""WITH e AS ({_MINUTES}) SELECT ticker, ts::DATE AS date, round(first(px ORDER BY ts), 8) AS open, round(max(px), 8) AS high, round(min(px), 8) AS low,
round(last(px ORDER BY ts), 8) AS close, round(coalesce(sum(qty), 0), 8) AS volume, round(sum(px * qty) / nullif(sum(qty), 0), 8) AS daily_vwap FROM e
WHERE hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) BETWEEN 34200 AND 57600 GROUP BY 1, 2""")
def minute_to_daily(spark, d):
    px = F.col("value")
    rows = P.table(spark, d, "events").filter("value > 0").select(F.col("event_type").alias("ticker"), "ts", *(px.alias(c) for c in ("open", "high", "low", "close")), F.get_json_object("props", "$.k").try_cast("double").alias("volume"))
    return B.minutes_to_daily(rows)


@query("dedup_conflicts", """SELECT l_orderkey, l_linenumber, count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey, l_quantity)) AS n_versions,
count(DISTINCT (l_partkey, l_suppkey, l_quantity)) > 1 AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def dedup_conflicts(spark, d):
    return B.duplicate_report(P.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("validate_ohlcv", f"""WITH {S.BARS} SELECT ticker, count(*) AS n_rows, count(date) - count(DISTINCT date) AS duplicates, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS missing,
count(*) FILTER (high + 1e-6 < greatest(open, close, low)) AS high_logic, count(*) FILTER (low - 1e-6 > least(open, close, high)) AS low_logic, count(*) FILTER (least(open, high, low, close) <= 0) AS price,
count(*) FILTER (volume < 0) AS volume, count(*) >= 300 AS passed FROM bars GROUP BY 1""")
def validate_ohlcv(spark, d):
    return B.validate_bars(P.bars(spark, d))


@query("table_summary", f"WITH {S.BARS} SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_dates, count(DISTINCT ticker) AS n_tickers, count(*) - count(DISTINCT (date, ticker)) AS n_duplicates FROM bars")
def table_summary(spark, d):
    return tables.table_summary(P.bars(spark, d), ["date", "ticker"])


@query("universe", "SELECT replace(upper(trim(s_name)), '#', '.') AS ticker, '' AS company_name, r_name AS sector, n_name AS industry, '' AS sub_industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def universe(spark, d):
    return tables.universe(P.gics(spark, d).select(F.regexp_replace("company_name", "#", ".").alias("ticker"), "sector", "industry"))


@query("sector_counts", f"WITH {S.BARS} SELECT sector, count(*) AS n_tickers FROM gics GROUP BY 1")
def sector_counts(spark, d):
    return P.gics(spark, d).groupBy("sector").agg(F.count(F.lit(1)).alias("n_tickers"))


@query("factors_long", """SELECT o_orderdate::DATE AS date, lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '_', 'g')) AS factor, round(sum(o_totalprice), 4) AS ret FROM orders GROUP BY 1, 2""", 4)
def factors_long(spark, d):
    """Wide factor table melted to rows."""
    o = P.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "_")).alias("factor"), "o_totalprice")
    names = sorted(x["factor"] for x in o.select("factor").distinct().collect())  # a handful of factor names
    wide = o.groupBy("date").pivot("factor", names).agg(F.sum("o_totalprice"))
    return tables.wide_to_long(wide, "date", "factor", "ret").filter("ret IS NOT NULL")


# ---------------------------------------------------------------- signals


def _alpha(k: int) -> None:
    @query(f"alpha_{k}", S.alpha_query(k), S.DIGITS.get(k, 8))
    def one(spark, d):
        return P.signals(spark, d, [k]).select("ticker", "date", f"alpha_{k}")


for _k in sorted({*S.ALPHA, 63}):
    _alpha(_k)


@query("alpha_34_sector_median", f"""WITH {S.BARS}, m AS (SELECT ticker, date, ln(close / lag(close, 126) OVER (PARTITION BY ticker ORDER BY date)) AS m FROM bars),
x AS (SELECT ticker, date, m, count(m) OVER v AS n, median(m) OVER v AS med FROM m JOIN gics USING (ticker) WINDOW v AS (PARTITION BY date, sector))
SELECT ticker, date, round(CASE WHEN n >= 5 THEN m - med END, 8) AS alpha_34 FROM x""")
def alpha_34(spark, d):
    rows = P.signals(spark, d, [30]).join(P.gics(spark, d).select("ticker", "sector"), "ticker")
    return cross_section.minus_sector_median(rows, "alpha_30", "alpha_34").select("ticker", "date", "alpha_34")


@query("alpha_35_group_return", f"""WITH {S.BARS}, x AS (SELECT ticker, date, industry, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS r FROM bars JOIN gics USING (ticker)),
g AS (SELECT industry, date, avg(r) AS g FROM x GROUP BY 1, 2)
SELECT ticker, date, round(CASE WHEN count(g) OVER f >= 63 THEN sum(g) OVER f END, 8) AS alpha_35 FROM x JOIN g USING (industry, date) WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""")
def alpha_35(spark, d):
    """63-row sum of the industry's return."""
    from ..functions.windows import rolling

    rows = P.signals(spark, d, [26]).join(P.gics(spark, d).select("ticker", "industry"), "ticker")
    group = rows.groupBy("industry", "date").agg(F.avg("alpha_26").alias("group_return"))
    return rows.join(group, ["industry", "date"], "left").select("ticker", "date", rolling(F.sum, F.col("group_return"), 63).alias("alpha_35"))


def _with_factors(spark, d) -> DataFrame:
    rows = P.signals(spark, d, [26])
    o = P.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.substring("o_orderpriority", 1, 1).alias("p"), "o_totalprice")
    wide = o.groupBy("date").pivot("p", ["1", "2", "3", "4", "5"]).agg(F.avg("o_totalprice"))
    f = wide.select("date", *(((F.col(str(k)) - F.col("5")) / 1e6).alias(n) for k, n in ((1, "smb"), (2, "hml"), (3, "mom"), (4, "rf"))))
    rows = rows.join(f, "date", "left").join(P.market(P.bars(spark, d)).select("date", F.col("market_return").alias("mkt")), "date", "left")
    return rows.withColumn("excess", F.col("alpha_26") - F.col("rf"))


@query("alpha_33_59_residual")
def alpha_33_59(spark, d):
    """Residual momentum (sum of residuals, lagged 21, over 231 rows of at least 200) and residual volatility."""
    from ..functions.windows import rolling

    rows = add_residual(_with_factors(spark, d), "excess", ["mkt", "smb", "hml", "mom"]).withColumn("_lagged", F.lag("residual", 21).over(by_ticker()))
    return rows.select("ticker", "date", rolling(F.sum, F.col("_lagged"), 231, 200).alias("alpha_33"), rolling(F.stddev_samp, F.col("residual"), 63, 55).alias("alpha_59"))


_OLD = (56, 57, 58, 65, 70, 72)


@query("alpha_a_variants", f"""WITH {S.BARS}, {S.SIGNALS}, o AS (SELECT *, sum(coalesce(sign(delta), 0) * volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS obv FROM s3)
SELECT ticker, date, round(sqrt(252) * ({S.ALPHA[56]}), 8) AS alpha_56, round(sqrt(252) * sd63, 8) AS alpha_57, round(sqrt(252) * ({S.full("stddev_samp", "least(r, 0)", 63, "r")}), 8) AS alpha_58, round(dollars, 8) AS alpha_65,
round(obv - lag(obv, 20) OVER w, 8) AS alpha_70, round(CASE WHEN down14 = 0 THEN 100 WHEN up14 = 0 THEN 0 ELSE greatest(0, least(100, 100 - 100 / (1 + up14 / nullif(down14, 0)))) END, 8) AS alpha_72 FROM o {S.WINDOWS}""")
def alpha_a_variants(spark, d):
    """The older generation's definitions where they differ."""
    return P.signals(spark, d, list(_OLD), "A").select("ticker", "date", *(f"alpha_{k}" for k in _OLD))


@query("asof_float_stale", f"""WITH {S.BARS}, z AS (SELECT ticker, max(date) AS last FROM floats WHERE year(date) < 2001 GROUP BY 1)
SELECT b.ticker, b.date, round(CASE WHEN b.date <= z.last THEN f.float_shares END, 8) AS float_shares FROM bars b ASOF LEFT JOIN (SELECT * FROM floats WHERE year(date) < 2001) f ON b.ticker = f.ticker AND b.date >= f.date LEFT JOIN z ON z.ticker = b.ticker""")
def asof_float_stale(spark, d):
    daily = P.bars(spark, d)
    snaps = P.float_shares(daily).filter(F.year("date") < 2001)
    return asof_backward(daily.select("ticker", "date"), snaps, "float_shares", stale_after_last=True)


# ---------------------------------------------------------------- cross-section and labels

_WIN = """w AS (SELECT *, CASE WHEN n >= 50 THEN greatest(lo, least(hi, alpha_27)) END AS win FROM (SELECT *, count(alpha_27) OVER v AS n, count(alpha_27) OVER s AS ns,
quantile_cont(alpha_27, 0.01) OVER v AS lo, quantile_cont(alpha_27, 0.99) OVER v AS hi FROM p WINDOW v AS (PARTITION BY date), s AS (PARTITION BY date, sector)) WHERE alpha_27 IS NOT NULL)"""


def _cs(spark, d, variant):
    return cross_section.transform(P.month_panel(spark, d, (27,)), ["alpha_27"], variant).filter("alpha_27 IS NOT NULL")


@query("cs_a", f"""WITH {S.MONTH}, {_WIN} SELECT date, ticker, round(win, 8) AS alpha_27_cs_winsorized, round((win - avg(win) OVER v) / nullif(stddev_samp(win) OVER v, 0), 8) AS alpha_27_cs_zscore,
round(CASE WHEN n >= 50 THEN {S.pct_rank("alpha_27", "date")} END, 8) AS alpha_27_cs_rank, round(CASE WHEN ns >= 5 THEN alpha_27 - avg(alpha_27) OVER s END, 8) AS alpha_27_sector_neutral_value,
round(CASE WHEN ns >= 5 THEN {S.pct_rank("alpha_27", "date, sector")} END, 8) AS alpha_27_sector_neutral_rank FROM w WINDOW v AS (PARTITION BY date), s AS (PARTITION BY date, sector)""")
def cs_a(spark, d):
    return _cs(spark, d, "A").select("date", "ticker", *(f"alpha_27_{c}" for c in ("cs_winsorized", "cs_zscore", "cs_rank", "sector_neutral_value", "sector_neutral_rank")))


@query("cs_b", f"""WITH {S.MONTH}, {_WIN} SELECT date, ticker, round((win - avg(win) OVER v) / nullif(stddev_samp(win) OVER v, 0), 8) AS alpha_27_z, round({S.unit_rank("win", "date")}, 8) AS alpha_27_rank,
round(CASE WHEN ns >= 5 THEN {S.unit_rank("win", "date, sector")} END, 8) AS alpha_27_sector_neutral_rank FROM w WINDOW v AS (PARTITION BY date)""")
def cs_b(spark, d):
    return _cs(spark, d, "B").select("date", "ticker", *(f"alpha_27_{c}" for c in ("z", "rank", "sector_neutral_rank")))


@query("cs_t", f"""WITH {S.MONTH}, {_WIN} SELECT date, ticker, round((win - avg(win) OVER v) / nullif(stddev_pop(win) OVER v, 0), 8) AS alpha_27_z, round({S.pct_rank("win", "date")}, 8) AS alpha_27_rank FROM w WINDOW v AS (PARTITION BY date)""")
def cs_t(spark, d):
    return _cs(spark, d, "T").select("date", "ticker", "alpha_27_z", "alpha_27_rank")


_LABELS = [f"fwd_{k}_{h}d" for h in labels.HORIZONS for k in ("cc", "tradable", "vwap")]
_LABEL_SQL = ", ".join(
    f"round(ln(lead(close, {h}) OVER w / close), 8) AS fwd_cc_{h}d, round(ln(lead(close, {h}) OVER w / lead(open, 1) OVER w), 8) AS fwd_tradable_{h}d, round(ln(lead({'close' if h == 1 else 'daily_vwap'}, {h}) OVER w / lead(daily_vwap, 1) OVER w), 8) AS fwd_vwap_{h}d"
    for h in labels.HORIZONS
)


@query("labels", f"WITH {S.BARS} SELECT ticker, date, {_LABEL_SQL} FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)")
def all_labels(spark, d):
    return labels.add_labels(P.bars(spark, d)).select("ticker", "date", *_LABELS)


@query("label_excess_5d", f"""WITH {S.BARS}, m AS (SELECT date, ln(lead(level, 5) OVER (ORDER BY date) / level) AS m FROM market)
SELECT ticker, date, round(ln(lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close) - m, 8) AS fwd_excess_5d FROM bars LEFT JOIN m USING (date)""")
def label_excess(spark, d):
    daily = P.bars(spark, d)
    return labels.add_excess(labels.add_labels(daily, (5,)), P.market(daily)).select("ticker", "date", "fwd_excess_5d")


@query("relevance_grade", f"WITH {S.MONTH} SELECT date, ticker, greatest(0, least(31, floor({S.pct_rank('target', 'date')} * 31)))::INT AS grade FROM p WHERE target IS NOT NULL")
def relevance_grade(spark, d):
    return labels.relevance_grade(P.month_panel(spark, d).filter("fwd_cc_5d IS NOT NULL"), "fwd_cc_5d").select("date", "ticker", "grade")


# ---------------------------------------------------------------- evaluation


def _pairs(spark, d):
    return evaluation.unpivot(P.month_panel(spark, d), P.NAMES, "fwd_cc_5d")


@query("rank_ic_daily", f"WITH {S.MONTH}, {S.IC} SELECT alpha, date, n, round(ic, 8) AS ic FROM ic")
def rank_ic_daily(spark, d):
    return evaluation.daily_rank_ic(_pairs(spark, d))


_SUMMARY = "s AS (SELECT alpha, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, count(ic) AS n_days, avg((ic > 0)::DOUBLE) AS positive_ratio, avg(ic) / stddev_samp(ic) AS icir, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t_stat FROM ic GROUP BY 1)"


@query("rank_ic_summary", f"WITH {S.MONTH}, {S.IC}, {_SUMMARY} SELECT alpha, n_days, {r('mean_ic, std_ic, positive_ratio, icir, t_stat')} FROM s")
def rank_ic_summary(spark, d):
    return evaluation.ic_summary(evaluation.daily_rank_ic(_pairs(spark, d)))


@query("significance_filter", f"WITH {S.MONTH}, {S.IC}, {_SUMMARY} SELECT alpha, n_days, {r('mean_ic, std_ic, positive_ratio, icir, t_stat')} FROM s WHERE abs(t_stat) >= 2")
def significance_filter(spark, d):
    return selection.significant(evaluation.ic_summary(evaluation.daily_rank_ic(_pairs(spark, d))))


@query("ols_daily", f"WITH {S.MONTH}, {S.OLS} SELECT alpha, date, n, {r('intercept, beta, se, t, r2, adj_r2, residual_se', 6)} FROM ols", 6)
def ols_daily(spark, d):
    return evaluation.daily_ols(_pairs(spark, d))


_NW = """c AS (SELECT *, beta - avg(beta) OVER (PARTITION BY alpha) AS c FROM ols), g AS (SELECT *, {lags} FROM c WINDOW o AS (PARTITION BY alpha ORDER BY date)),
v AS (SELECT alpha, count(*) AS n, avg(beta) AS mean, stddev_samp(beta) AS sd, sum(c * c) / count(*) + {sums} AS lrv FROM g GROUP BY 1)""".format(
    lags=", ".join(f"c * lag(c, {k}) OVER o AS g{k}" for k in range(1, 6)), sums=" + ".join(f"2 * (1 - {k} / 6.0) * sum(g{k}) / count(*)" for k in range(1, 6))
)


@query("fama_macbeth", f"WITH {S.MONTH}, {S.OLS}, {_NW} SELECT alpha, n, round(mean, 6) AS mean, round(mean / (sd / sqrt(n)), 6) AS t_plain, round(CASE WHEN lrv > 0 THEN mean / sqrt(lrv / n) ELSE mean / (sd / sqrt(n)) END, 6) AS t_nw FROM v", 6)
def fama_macbeth(spark, d):
    return evaluation.fama_macbeth(_pairs(spark, d), least=50)


_TAILS = f"t AS (SELECT *, {S.pct_rank('value', 'alpha, date')} AS pr FROM pairs)"


@query("decile_spread", f"""WITH {S.MONTH}, {_TAILS} SELECT alpha, date, count(*) AS n, round(avg(target) FILTER (pr >= 0.9), 8) AS top, round(avg(target) FILTER (pr <= 0.1), 8) AS bottom,
round(avg(target) FILTER (pr >= 0.9) - avg(target) FILTER (pr <= 0.1), 8) AS spread FROM t GROUP BY 1, 2 HAVING count(*) >= 20""")
def decile_spread(spark, d):
    return evaluation.decile_spread(_pairs(spark, d))


@query("binary_spread", f"""WITH {S.MONTH}, q AS (SELECT date, target, (alpha_27 > 0) AS up FROM p WHERE alpha_27 IS NOT NULL AND target IS NOT NULL)
SELECT 'up_5d' AS alpha, date, count(*) AS n, round(avg(target) FILTER (up) - avg(target) FILTER (NOT up), 8) AS spread FROM q GROUP BY date HAVING count(*) >= 20 AND avg(target) FILTER (up) - avg(target) FILTER (NOT up) IS NOT NULL""")
def binary_spread(spark, d):
    rows = P.month_panel(spark, d, (27,)).withColumn("up_5d", (F.col("alpha_27") > 0).cast("double"))
    return evaluation.binary_spread(evaluation.unpivot(rows, ["up_5d"], "fwd_cc_5d"))


@query("ndcg", f"""WITH {S.MONTH}, q AS (SELECT date, ticker, alpha_47, greatest(0, least(31, floor({S.pct_rank("target", "date")} * 31)))::INT AS grade FROM p WHERE target IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY alpha_47 DESC NULLS LAST, ticker) AS a, row_number() OVER (PARTITION BY date ORDER BY grade DESC, ticker) AS b FROM q WHERE alpha_47 IS NOT NULL)
SELECT date, count(*) AS n, round(sum(grade / log2(a + 1)) / nullif(sum(grade / log2(b + 1)), 0), 8) AS ndcg FROM k GROUP BY 1 HAVING count(*) >= 50""")
def ndcg(spark, d):
    graded = labels.relevance_grade(P.month_panel(spark, d, (47,)).filter("fwd_cc_5d IS NOT NULL"), "fwd_cc_5d")
    return evaluation.ndcg(graded.filter("alpha_47 IS NOT NULL"), "alpha_47")


def _predictions(spark, d):
    rows = P.month_panel(spark, d, (47,)).filter("alpha_47 IS NOT NULL AND fwd_cc_5d IS NOT NULL")
    return rows.select("date", "ticker", unit_rank(F.col("alpha_47"), ["date"]).alias("prediction"), F.col("fwd_cc_5d").alias("target"))


_PRED = f"q AS (SELECT date, ticker, {S.unit_rank('alpha_47', 'date')} AS prediction, target FROM p WHERE alpha_47 IS NOT NULL AND target IS NOT NULL)"


@query("pred_metrics", f"""WITH {S.MONTH}, {_PRED}, k AS (SELECT *, {S.avg_rank("prediction", "date")} AS rp, {S.avg_rank("target", "date")} AS rt, {S.pct_rank("prediction", "date")} AS pr FROM q)
SELECT date, count(*) AS n, round(avg(target) FILTER (pr >= 0.9), 8) AS top, round(avg(target) FILTER (pr <= 0.1), 8) AS bottom, round(avg(target) FILTER (pr >= 0.9) - avg(target) FILTER (pr <= 0.1), 8) AS spread,
round(corr(rp, rt), 8) AS rank_ic, round(corr(prediction, target), 8) AS pearson_ic FROM k GROUP BY 1 HAVING count(*) >= 50""")
def pred_metrics(spark, d):
    return evaluation.prediction_metrics(_predictions(spark, d))


@query("pred_r2", f"WITH {S.MONTH}, {_PRED} SELECT round(1 - sum((target - prediction) * (target - prediction)) / (var_pop(target) * count(*)), 8) AS r2 FROM q")
def pred_r2(spark, d):
    return evaluation.r_squared(_predictions(spark, d))


# ---------------------------------------------------------------- selection and splits

_PAIRS_SQL = "x AS (SELECT a.alpha AS a, b.alpha AS b, a.value AS x, b.value AS y FROM u a JOIN u b ON a.date = b.date AND a.ticker = b.ticker AND a.alpha < b.alpha)"
_LONG = "u AS (SELECT date, ticker, alpha, value FROM (UNPIVOT (SELECT date, ticker, {n} FROM p) ON {n} INTO NAME alpha VALUE value) WHERE value IS NOT NULL)".format(n=", ".join(P.NAMES))


@query("pair_corr", f"WITH {S.MONTH}, {_LONG}, {_PAIRS_SQL} SELECT a, b, count(*) AS n, round(corr(x, y), 8) AS corr FROM x GROUP BY 1, 2 HAVING count(*) >= 50")
def pair_corr(spark, d):
    return selection.pair_correlation(P.month_panel(spark, d), P.NAMES, ["date", "ticker"])


@query("pair_rank_corr", f"WITH {S.MONTH}, {_LONG}, {_PAIRS_SQL}, k AS (SELECT a, b, {S.avg_rank('x', 'a, b')} AS rx, {S.avg_rank('y', 'a, b')} AS ry FROM x) SELECT a, b, count(*) AS n, round(corr(rx, ry), 8) AS corr FROM k GROUP BY 1, 2 HAVING count(*) >= 50")
def pair_rank_corr(spark, d):
    panel = ranker.cut(P.month_panel(spark, d).select("date", "ticker", *P.NAMES))  # read for edges, sizes and ranks
    return selection.pair_correlation(panel, P.NAMES, ["date", "ticker"], rank=True)


@query("redundancy_clusters")
def redundancy_clusters(spark, d):
    panel = P.month_panel(spark, d)
    summary = evaluation.ic_summary(evaluation.daily_rank_ic(evaluation.unpivot(panel, P.NAMES, "fwd_cc_5d")))
    return selection.redundancy_clusters(summary, selection.pair_correlation(panel, P.NAMES, ["date", "ticker"], rank=True))


@query("date_split", f"WITH {S.BARS}, q AS (SELECT DISTINCT date FROM bars), k AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM q) SELECT date, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM k")
def date_split(spark, d):
    return splits.date_split(P.bars(spark, d))


@query("expanding_folds", f"""WITH {S.BARS}, q AS (SELECT DISTINCT date FROM bars), k AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS n FROM q), z AS (SELECT *, n // 6 AS s, n % 6 AS e FROM k)
SELECT date, CASE WHEN k < e * (s + 1) THEN k // (s + 1) ELSE e + (k - e * (s + 1)) // greatest(s, 1) END::INT AS fold FROM z""")
def expanding_folds(spark, d):
    return splits.expanding_folds(P.bars(spark, d), 5)


@query("walk_forward_folds", f"""WITH {S.BARS}, z AS (SELECT date_trunc('month', min(date))::DATE AS a, date_trunc('month', max(date))::DATE AS b FROM bars),
k AS (SELECT unnest(generate_series(a, b, INTERVAL 3 MONTH))::DATE AS train_from, b FROM z) SELECT (row_number() OVER (ORDER BY train_from) - 1)::INT AS fold, train_from, (train_from + INTERVAL 12 MONTH)::DATE AS train_to, (train_from + INTERVAL 15 MONTH)::DATE AS val_to
FROM k WHERE train_from + INTERVAL 15 MONTH <= b + INTERVAL 1 MONTH""")
def walk_forward_folds(spark, d):
    return splits.walk_forward(P.bars(spark, d))


@query("date_stride", f"WITH {S.BARS}, k AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM bars)) SELECT ticker, date, round(close, 8) AS close FROM bars SEMI JOIN (SELECT date FROM k WHERE k % 3 = 0) USING (date)")
def date_stride(spark, d):
    return splits.stride(P.bars(spark, d), 3).select("ticker", "date", "close")


@query("usable_features", f"WITH {S.MONTH} SELECT alpha AS feature, count(*) AS n_rows, count(DISTINCT date) AS n_dates, count(*) >= 1000 AND count(DISTINCT date) >= 50 AS usable FROM pairs GROUP BY 1")
def usable_features(spark, d):
    return splits.usable_features(P.month_panel(spark, d), P.NAMES, "fwd_cc_5d")


@query("elastic_net")
def elastic_net(spark, d):
    """Elastic net by coordinate descent on cross products that the executors sum."""
    panel = cross_section.transform(P.month_panel(spark, d), P.NAMES, "B", least=5)
    folds = splits.expanding_folds(panel, 3)
    names = [f"{a}_z" for a in P.NAMES]
    rows = selection.imputed(panel.join(F.broadcast(folds), "date"), names, "fold")
    alpha, ratio, beta = selection.elastic_net_cv(selection.gram(rows, names, "fwd_cc_5d", "fold"), np.logspace(-6, -2, 50), (0.2, 0.5, 0.8, 0.95))
    return spark.createDataFrame([(n, float(b), abs(float(b)) > 1e-12, float(alpha), ratio) for n, b in zip(names, beta)], "feature string, coef double, selected boolean, alpha double, l1_ratio double")


# ---------------------------------------------------------------- portfolios

_SIM_BASE = f"""WITH {S.BARS}, x AS (SELECT ticker, date, close / lag(close, 5) OVER w AS f, ln(lead(close, 5) OVER w / close) AS ret FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
sc AS (SELECT ticker, date, ln(f) AS score FROM x), days AS (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM bars) GROUP BY date_trunc('month', date)),
k AS (SELECT date AS rebalance, ticker, score, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS u, row_number() OVER (PARTITION BY date ORDER BY score, ticker) AS v
  FROM sc SEMI JOIN days USING (date) WHERE score IS NOT NULL),
c AS (SELECT rebalance, ticker, score, CASE WHEN u <= 3 THEN 'long' ELSE 'short' END AS side FROM k WHERE n >= 6 AND (u <= 3 OR v <= 3)),
wt AS (SELECT *, abs(score) / sum(abs(score)) OVER (PARTITION BY rebalance, side) AS w FROM c),
held AS (SELECT q.date, z.rebalance FROM (SELECT DISTINCT date FROM bars) q ASOF JOIN (SELECT DISTINCT rebalance FROM c) z ON q.date >= z.rebalance),
bk AS (SELECT held.date, side, w, ret FROM held JOIN wt USING (rebalance) JOIN x ON x.date = held.date AND x.ticker = wt.ticker WHERE ret IS NOT NULL),
ct AS (SELECT date, 0.002 AS c FROM days)"""


def _sim_sql(weighted: bool) -> str:
    leg = (lambda s: f"sum(w * ret) FILTER (side = '{s}')") if weighted else (lambda s: f"avg(ret) FILTER (side = '{s}')")
    return f"""{_SIM_BASE}, o AS (SELECT date, {leg("long")} AS l, {leg("short")} AS s FROM bk GROUP BY 1)
SELECT date, round(l - coalesce(c, 0), 8) AS long_ret, round(s, 8) AS short_ret, round(l - s - coalesce(c, 0), 8) AS ls_ret FROM o LEFT JOIN ct USING (date)"""


def _sim(spark, d, weighted=False):
    rows = labels.add_labels(P.signals(spark, d, [27]), (5,))
    return portfolio.simulate(rows.select("date", "ticker", F.col("alpha_27").alias("score")), rows.select("date", "ticker", F.col("fwd_cc_5d").alias("ret")), n=3, bucket="month", weighted=weighted)


QUERIES["simulate_equal"], ORACLE["simulate_equal"] = lambda s, d: rounded(_sim(s, d)), _sim_sql(False)
QUERIES["simulate_weighted"], ORACLE["simulate_weighted"] = lambda s, d: rounded(_sim(s, d, True)), _sim_sql(True)

_MKT = f"WITH {S.BARS}, q AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS x FROM market), z AS (SELECT date, x, exp(sum(ln(1 + x)) OVER (ORDER BY date)) AS cum FROM q WHERE x IS NOT NULL)"


def _market_series(spark, d):
    m = P.market(P.bars(spark, d))
    return m.select("date", "level", (F.exp("market_return") - 1).alias("x")).filter("x IS NOT NULL")


@query("drawdown", f"{_MKT} SELECT date, round(cum, 6) AS cum, round(cum / max(cum) OVER (ORDER BY date) - 1, 6) AS drawdown FROM z", 6)
def drawdown(spark, d):
    return portfolio.curve(_market_series(spark, d), "x")


@query("perf_metrics", f"""{_MKT}, e AS (SELECT cum / max(cum) OVER (ORDER BY date) - 1 AS dd FROM z), g AS (SELECT count(*) AS n, exp(sum(ln(1 + x)) * 252.0 / count(*)) - 1 AS a, stddev_samp(x) * sqrt(252) AS v, avg((x > 0)::DOUBLE) AS h FROM z)
SELECT n, round(a, 6) AS annual_return, round(v, 6) AS annual_vol, round(h, 6) AS hit_rate, round(a / v, 6) AS sharpe, round((SELECT min(dd) FROM e), 6) AS max_drawdown FROM g""", 6)
def perf_metrics(spark, d):
    return portfolio.performance(_market_series(spark, d), "x")


@query("annual_returns", f"{_MKT} SELECT year(date)::INT AS year, round(exp(sum(ln(1 + x))) - 1, 6) AS annual_return FROM z GROUP BY 1", 6)
def annual_returns(spark, d):
    return portfolio.annual_returns(_market_series(spark, d), "x")


@query("regime_scale", f"WITH {S.BARS} SELECT date, CASE WHEN level / lag(level, 20) OVER (ORDER BY date) - 1 < -0.03 THEN 0.5 ELSE 1.0 END::DOUBLE AS regime_scale FROM market")
def regime_scale(spark, d):
    return portfolio.regime_scale(P.market(P.bars(spark, d)))


@query("equal_weight_benchmark", f"WITH {S.MONTH} SELECT date, round(avg(target), 8) AS ret FROM p GROUP BY 1")
def equal_weight(spark, d):
    return P.month_panel(spark, d, (27,)).groupBy("date").agg(F.avg("fwd_cc_5d").alias("ret"))


@query("decile_book", f"""WITH {S.MONTH}, k AS (SELECT date, target, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY alpha_47 DESC, ticker) AS u, row_number() OVER (PARTITION BY date ORDER BY alpha_47, ticker DESC) AS v
FROM p WHERE alpha_47 IS NOT NULL AND target IS NOT NULL), o AS (SELECT date, avg(target) FILTER (u <= floor(n * 0.1)) AS l, avg(target) FILTER (v <= floor(n * 0.1)) AS s FROM k GROUP BY 1)
SELECT date, round(l, 8) AS long_ret, round(s, 8) AS short_ret, round(l - s, 8) AS ls_ret FROM o WHERE l IS NOT NULL""")
def decile_book(spark, d):
    return portfolio.decile_book(P.month_panel(spark, d, (47,)), "alpha_47", "fwd_cc_5d")


# ---------------------------------------------------------------- checks, sets, top-k


@query("missing_summary", f"WITH {S.MONTH} SELECT 'alpha_' || k AS \"column\", m AS missing_rate, m >= 1 AS all_missing, m > 0.5 AS mostly_missing FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS k, round(avg((alpha_{k} IS NULL)::DOUBLE), 8) AS m FROM p" for k in P.ALPHAS) + ")")
def missing_summary(spark, d):
    return quality_checks.missing_rates(P.month_panel(spark, d), P.NAMES)


@query("signal_stats", f"WITH {S.MONTH}, u AS (SELECT date, alpha, value FROM p UNPIVOT INCLUDE NULLS (value FOR alpha IN ({', '.join(P.NAMES)}))) SELECT alpha, count(*) FILTER (value IS NULL) AS n_missing, min(date) FILTER (value IS NOT NULL) AS first_date, max(date) FILTER (value IS NOT NULL) AS last_date, round(min(value), 8) AS low, round(max(value), 8) AS high, round(avg(value), 8) AS mean FROM u GROUP BY 1")
def signal_stats(spark, d):
    return quality_checks.signal_stats(P.month_panel(spark, d), P.NAMES)


@query("coverage_worst10", f"WITH {S.MONTH} SELECT ticker, round(avg(({' + '.join(f'(alpha_{k} IS NOT NULL)::DOUBLE' for k in P.ALPHAS)}) / 6), 8) AS coverage FROM p GROUP BY 1 ORDER BY avg(({' + '.join(f'(alpha_{k} IS NOT NULL)::DOUBLE' for k in P.ALPHAS)}) / 6), ticker LIMIT 10")
def coverage_worst10(spark, d):
    return quality_checks.coverage_worst(P.month_panel(spark, d), P.NAMES)


@query("thin_groups", f"""WITH {S.MONTH}, u AS (SELECT date, sector, alpha, value FROM p UNPIVOT INCLUDE NULLS (value FOR alpha IN ({", ".join(P.NAMES)}))),
s AS (SELECT alpha, date, sector, count(value) AS n FROM u GROUP BY 1, 2, 3), z AS (SELECT alpha, date, sum(n) AS t, count(*) FILTER (n < 5) AS thin FROM s GROUP BY 1, 2)
SELECT alpha, count(*) FILTER (t < 50) AS thin_dates, sum(thin)::BIGINT AS thin_sectors FROM z GROUP BY 1""")
def thin_groups(spark, d):
    return quality_checks.thin_groups(P.month_panel(spark, d), P.NAMES)


@query("qa_date_gaps", f"WITH {S.BARS}, k AS (SELECT date, date - lag(date) OVER (ORDER BY date) AS gap FROM (SELECT DISTINCT date FROM bars)) SELECT date, gap::INT AS gap FROM k WHERE gap > 5")
def qa_date_gaps(spark, d):
    return quality_checks.date_gaps(P.bars(spark, d))


def _check_sql(name: str, count: str) -> str:
    return f"""SELECT '{name}' AS "check", CASE WHEN {count} = 0 THEN 'PASS' ELSE 'FAIL' END AS status, ({count})::VARCHAR AS detail FROM c"""


_REPORT_SQL = f"""WITH {S.MONTH}, {_WIN}, z AS (SELECT date, ticker, (win - avg(win) OVER v) / nullif(stddev_samp(win) OVER v, 0) AS zs, {S.unit_rank("win", "date")} AS rk FROM w WINDOW v AS (PARTITION BY date)),
c AS (SELECT count(*) - count(DISTINCT (date, ticker)) AS dup, count(*) FILTER (rk < 0 OR rk > 1) AS outside, count(*) FILTER (NOT isfinite(rk)) AS wild_rank, count(*) FILTER (NOT isfinite(zs)) AS wild_z FROM z)
{_check_sql("unique_keys", "dup")} UNION ALL SELECT 'required_columns', 'PASS', '' UNION ALL {_check_sql("range_alpha_27_rank", "outside")} UNION ALL {_check_sql("finite_alpha_27_rank", "wild_rank")} UNION ALL {_check_sql("finite_alpha_27_z", "wild_z")}"""


@query("qa_panel_report", _REPORT_SQL)
def qa_panel_report(spark, d):
    rows = cross_section.transform(P.month_panel(spark, d, (27,)), ["alpha_27"], "B")
    return quality_checks.panel_report(rows, ["date", "ticker"], ["alpha_27_rank"], ["alpha_27_z"], ["date", "ticker", "sector"])


_CUT, _LOOK = "1998-06-30", (27, 47, 50, 61)
_SIGNALS_OF = "SELECT ticker, date, {a} FROM s3 {w}".format(a=", ".join(f"{S.ALPHA[k]} AS alpha_{k}" for k in _LOOK), w=S.WINDOWS)
_SHORT_BARS = S.BARS.replace("WHERE l_quantity > 0", f"WHERE l_shipdate::DATE <= DATE '{_CUT}' AND l_quantity > 0")
_LOOK_SQL = f"""WITH whole AS (WITH {S.BARS}, {S.SIGNALS} SELECT * FROM ({_SIGNALS_OF}) WHERE date <= DATE '{_CUT}'), upto AS (WITH {_SHORT_BARS}, {S.SIGNALS} {_SIGNALS_OF}),
c AS (SELECT {", ".join(f"count(*) FILTER (NOT coalesce(abs(a.alpha_{k} - b.alpha_{k}) <= 1e-8, a.alpha_{k} IS NULL AND b.alpha_{k} IS NULL)) AS n_{k}" for k in _LOOK)} FROM whole a FULL JOIN upto b USING (ticker, date))
""" + " UNION ALL ".join(_check_sql(f"no_lookahead_alpha_{k}", f"n_{k}") for k in _LOOK)


@query("qa_no_lookahead", _LOOK_SQL)
def qa_no_lookahead(spark, d):
    ids = list(_LOOK)
    return quality_checks.same_on_truncation(lambda b: add_signals(b, ids), P.bars(spark, d), _CUT, [f"alpha_{k}" for k in ids])


def _ids(spark, d, t, c):
    return P.table(spark, d, t).select(F.col(c).cast("long").alias("id"))


@query("set_union", "SELECT s_nationkey::BIGINT AS id FROM supplier UNION SELECT c_nationkey FROM customer")
def set_union(spark, d):
    return _ids(spark, d, "supplier", "s_nationkey").union(_ids(spark, d, "customer", "c_nationkey")).distinct()


@query("set_intersect", "SELECT s_suppkey AS id FROM supplier INTERSECT SELECT p_partkey FROM part")
def set_intersect(spark, d):
    return _ids(spark, d, "supplier", "s_suppkey").intersect(_ids(spark, d, "part", "p_partkey"))


@query("set_except", "SELECT p_partkey AS id FROM part EXCEPT SELECT s_suppkey FROM supplier")
def set_except(spark, d):
    return _ids(spark, d, "part", "p_partkey").subtract(_ids(spark, d, "supplier", "s_suppkey"))


@query("top_abs_ic", f"WITH {S.MONTH}, {S.IC} SELECT alpha, date, n, round(ic, 8) AS ic FROM ic ORDER BY abs(ic) DESC NULLS LAST, alpha, date LIMIT 20")
def top_abs_ic(spark, d):
    return evaluation.daily_rank_ic(_pairs(spark, d)).orderBy(F.abs("ic").desc_nulls_last(), "alpha", "date").limit(20)


@query("best_month_per_alpha", f"WITH {S.MONTH}, {S.IC} SELECT alpha, date, round(ic, 8) AS ic FROM ic QUALIFY row_number() OVER (PARTITION BY alpha ORDER BY ic DESC, date) = 1")
def best_month(spark, d):
    w = Window.partitionBy("alpha").orderBy(F.desc("ic"), "date")
    return evaluation.daily_rank_ic(_pairs(spark, d)).withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("alpha", "date", "ic")
