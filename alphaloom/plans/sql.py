"""The same relations as SQL text, for the oracle."""

from __future__ import annotations

BARS = """
bars AS (SELECT l_suppkey AS ticker, l_shipdate::DATE AS date,
  first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS close, sum(l_quantity) AS volume,
  sum(px * l_quantity) / sum(l_quantity) AS daily_vwap
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0) GROUP BY 1, 2),
levels AS (SELECT date, avg(close) AS level FROM bars GROUP BY 1),
market AS (SELECT date, level, ln(level / lag(level) OVER (ORDER BY date)) AS market_return FROM levels),
gics AS (SELECT s_suppkey AS ticker, s_name AS company_name, r_name AS sector, n_name AS industry FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
quarters AS (SELECT ticker, last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS date, sum(volume) AS v FROM bars GROUP BY 1, 2),
floats AS (SELECT ticker, date, sum(v) OVER (PARTITION BY ticker ORDER BY date) AS float_shares FROM quarters)
"""

_FRAMES = (5, 14, 20, 21, 60, 63, 252)


def full(agg: str, x: str, n: int, of: str | None = None) -> str:
    return f"CASE WHEN count({of or x}) OVER f{n} >= {n} THEN {agg}({x}) OVER f{n} END"


def back(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER w"


WINDOWS = "WINDOW w AS (PARTITION BY ticker ORDER BY date), " + ", ".join(f"f{n} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in _FRAMES)


def _ema(span: int) -> str:
    a = 2.0 / (span + 1)
    return f"pow({1 - a!r}, step) * sum(CASE WHEN step = 0 THEN close ELSE {a!r} * close END * pow({1 - a!r}, -step)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"


SIGNALS = f"""
s0 AS (SELECT b.*, m.market_return, f.float_shares FROM bars b LEFT JOIN market m USING (date)
  ASOF LEFT JOIN floats f ON b.ticker = f.ticker AND b.date >= f.date),
s1 AS (SELECT *, lag(close) OVER w AS prev, ln(close / lag(close) OVER w) AS r, row_number() OVER w - 1 AS step, (high + low + close) / 3 AS typical,
  close * volume AS dollars, coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume AS flow FROM s0 {WINDOWS}),
s2 AS (SELECT *, close - prev AS delta, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, lag(typical) OVER w AS typical_prev, typical * volume AS money,
  {full("avg", "close", 20)} AS ma20, {full("avg", "close", 60)} AS ma60, {full("stddev_samp", "close", 20)} AS sd20, {full("avg", "volume", 20)} AS adv20,
  {full("stddev_samp", "r", 63)} AS sd63 FROM s1 {WINDOWS}),
s3 AS (SELECT *, {full("avg", "greatest(delta, 0)", 14, "delta")} AS gain, {full("avg", "-least(delta, 0)", 14, "delta")} AS loss,
  {full("sum", "coalesce(sign(delta), 0) * volume", 20)} AS obv20, volume / nullif(adv20, 0) AS vratio,
  {full("sum", "CASE WHEN typical > typical_prev THEN money ELSE 0 END", 14)} AS up14, {full("sum", "CASE WHEN typical < typical_prev THEN money ELSE 0 END", 14)} AS down14
  FROM s2 {WINDOWS})
"""

_MOM = {26: 1, 27: 5, 28: 21, 29: 63, 30: 126, 31: 252}
ALPHA: dict[int, str] = {k: f"ln(close / {back('close', n)})" for k, n in _MOM.items()} | {
    32: f"ln({back('close', 21)} / {back('close', 252)})",
    36: f"close / ({full('max', 'close', 252)}) - 1",
    37: f"(close > ({full('max', 'prev', 20)}))::DOUBLE",
    38: f"(close < ({full('min', 'prev', 20)}))::DOUBLE",
    39: "-r", 40: f"-ln(close / {back('close', 5)})", 41: f"-ln(close / {back('close', 21)})",
    42: "ln(open / prev)", 43: "ln(close / open)", 44: "-ln(open / prev)", 45: "-(open - prev) / prev", 46: "-(close - daily_vwap) / nullif(daily_vwap, 0)",
    47: "close / ma20 - 1", 48: "ma20 / ma60 - 1", 49: f"ma20 / {back('ma20', 5)} - 1",
    50: "CASE WHEN loss IS NOT NULL THEN 50 - CASE WHEN gain = 0 AND loss = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / nullif(loss, 0)) END END",
    51: f"({_ema(12)} - {_ema(26)}) / close",
    52: "(close - ma20) / nullif(sd20, 0)", 53: "-(close - ma20) / nullif(sd20, 0)", 54: "(high - low) / close",
    55: full("avg", "tr", 14), 56: full("stddev_samp", "r", 21), 57: "sd63",
    58: f"sqrt(252) * ({full('stddev_samp', 'CASE WHEN r < 0 THEN r ELSE 0 END', 63)})",
    60: "CASE WHEN count(CASE WHEN r IS NOT NULL THEN market_return END) OVER f252 >= 252 THEN covar_samp(r, market_return) OVER f252 / nullif(var_samp(market_return) OVER f252, 0) END",
    61: full("skewness", "r", 63), 62: full("kurtosis", "r", 63),
    64: "vratio - 1", 65: "ln(dollars)", 66: "volume / nullif(float_shares, 0)",
    67: full("avg", "abs(r) / dollars", 21), 68: f"({full('avg', 'dollars', 5)}) / ({full('avg', 'dollars', 60)}) - 1",
    69: "CASE WHEN count(CASE WHEN r IS NOT NULL THEN volume END) OVER f20 >= 20 AND stddev_samp(r) OVER f20 > 0 AND stddev_samp(volume) OVER f20 > 0 THEN covar_samp(r, volume) OVER f20 / (stddev_samp(r) OVER f20 * stddev_samp(volume) OVER f20) END",
    70: f"obv20 - {back('obv20', 1)}",
    71: "CASE WHEN count(flow) OVER f20 >= 20 THEN regr_slope(flow, step) OVER f20 END",
    72: "100 - 100 / (1 + up14 / nullif(down14, 0))",
    73: f"({full('sum', 'flow', 20)}) / nullif({full('sum', 'volume', 20)}, 0)",
    74: f"ln(close / {back('close', 21)}) * (vratio - ({full('avg', 'vratio', 252)})) / nullif({full('stddev_samp', 'vratio', 252)}, 0)",
    75: f"ln(close / {back('close', 126)}) / nullif(sd63, 0)",
}


#: Decimals of signals in price units: rounding both sides to fewer.
DIGITS = {55: 5}


def alpha_query(k: int) -> str:
    if k == 63:
        return f"""WITH {BARS}, l AS (SELECT ticker, date, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS c FROM bars)
SELECT ticker, date, round(CASE WHEN len(c) >= 63 THEN list_min(list_transform(c, lambda x, i: x / list_max(c[1:i]) - 1)) END, 8) AS alpha_63 FROM l"""
    return f"WITH {BARS}, {SIGNALS} SELECT ticker, date, round({ALPHA[k]}, {DIGITS.get(k, 8)}) AS alpha_{k} FROM s3 {WINDOWS}"


_SMALL = (27, 39, 42, 47, 54, 64)
MONTH = f"""{BARS}, {SIGNALS},
a AS (SELECT ticker, date AS day, date_trunc('month', date)::DATE AS date, close, {", ".join(f"{ALPHA[k]} AS alpha_{k}" for k in _SMALL)},
  ln(lead(close, 5) OVER w / close) AS target FROM s3 {WINDOWS}),
p AS (SELECT a.*, sector FROM a LEFT JOIN gics USING (ticker) QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY day DESC) = 1),
pairs AS (SELECT * FROM (UNPIVOT (SELECT date, ticker, target, {", ".join(f"alpha_{k}" for k in _SMALL)} FROM p) ON {", ".join(f"alpha_{k}" for k in _SMALL)} INTO NAME alpha VALUE value)
  WHERE value IS NOT NULL AND target IS NOT NULL)
"""


def avg_rank(x: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def unit_rank(x: str, by: str) -> str:
    n = f"count({x}) OVER (PARTITION BY {by})"
    return f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN {n} = 1 THEN 0.5 ELSE ({avg_rank(x, by)} - 1) / ({n} - 1) END END"


def pct_rank(x: str, by: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN {avg_rank(x, by)} / count({x}) OVER (PARTITION BY {by}) END"


IC = f"""ic AS (SELECT alpha, date, count(*) AS n, corr(rv, rt) AS ic FROM (SELECT *, {avg_rank("value", "alpha, date")} AS rv, {avg_rank("target", "alpha, date")} AS rt FROM pairs)
  GROUP BY 1, 2 HAVING count(*) >= 50 AND stddev_samp(rv) > 0 AND stddev_samp(rt) > 0)"""
OLS = """ols AS (SELECT alpha, date, n, my - beta * mx AS intercept, beta, sqrt(rss / (n - 2)) / sqrt(sxx) AS se, beta / nullif(sqrt(rss / (n - 2)) / sqrt(sxx), 0) AS t,
  1 - rss / syy AS r2, 1 - (rss / syy) * (n - 1) / (n - 2) AS adj_r2, sqrt(rss / (n - 2)) AS residual_se
  FROM (SELECT *, sxy / sxx AS beta, greatest(syy - sxy / sxx * sxy, 0) AS rss FROM (SELECT alpha, date, count(*) AS n, avg(value) AS mx, avg(target) AS my,
    regr_sxx(target, value) AS sxx, regr_sxy(target, value) AS sxy, regr_syy(target, value) AS syy FROM pairs GROUP BY 1, 2) WHERE n >= 50 AND sxx > 0))"""
