"""The signal library: per-ticker price and volume signals by number, built in batches over one sort.

`add_signals` takes daily bars (ticker, date, open, high, low, close, volume, daily_vwap and, where signals need them,
market_return and float_shares) and adds the signals asked for with what they build on, in a few projections, so that one
exchange by ticker serves all. `variant` A gives the older definitions where generations differ. `add_presence` says where
signals have values, for checks that need no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nulls import div, log_ratio
from .windows import by_ticker, corr, drawdown, kurt, lag, rolling, skew, slope

YEAR = 252.0
C = F.col
MOMENTUM = {26: 1, 27: 5, 28: 21, 29: 63, 30: 126, 31: 252}
#: Rows of one block of the exponential averages: weights older than a block are below 1e-30.
EMA_BLOCK = 1000


def _ema(df: DataFrame, x: str, span: int, out: str) -> DataFrame:
    """Recursive exponential average without recursion: sums of rescaled terms within blocks, and what the block before ends with."""
    a = 2.0 / (span + 1)
    block = F.floor(C("step") / EMA_BLOCK)
    k = C("step") - block * EMA_BLOCK
    term = F.when(C("step") == 0, C(x)).otherwise(C(x) * a) * F.pow(F.lit(1 - a), -k.cast("double"))
    own = Window.partitionBy("ticker", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_block", block).withColumn("_k", k).withColumn("_term", term)
    df = df.withColumn("_own", F.pow(F.lit(1 - a), C("_k").cast("double")) * F.sum("_term").over(own))
    end = F.max(F.when(C("_k") == 0, lag("_own"))).over(Window.partitionBy("ticker", "_block"))
    df = df.withColumn("_end", end)
    return df.withColumn(out, C("_own") + F.coalesce(F.pow(F.lit(1 - a), (C("_k") + 1).cast("double")) * C("_end"), F.lit(0.0))).drop("_block", "_k", "_term", "_own", "_end")


def base_columns(bars: DataFrame) -> DataFrame:
    """What several signals share."""
    spread, prev = C("high") - C("low"), C("prev")
    typical = (C("high") + C("low") + C("close")) / 3.0
    return bars.withColumns({"prev": lag("close"), "r": log_ratio(C("close"), lag("close")), "step": F.row_number().over(by_ticker()) - 1, "typical": typical, "typical_prev": lag(typical)}).withColumns({
        "delta": C("close") - prev,
        "dollars": C("close") * C("volume"),
        "flow": F.coalesce(div((C("close") - C("low")) - (C("high") - C("close")), spread), F.lit(0.0)) * C("volume"),
        "money": C("typical") * C("volume"),
        "tr": F.greatest(spread, F.abs(C("high") - prev), F.abs(C("low") - prev)),
        "ma20": rolling(F.avg, C("close"), 20),
        "ma60": rolling(F.avg, C("close"), 60),
        "sd20": rolling(F.stddev_samp, C("close"), 20),
        "adv20": rolling(F.avg, C("volume"), 20),
        "sd63": rolling(F.stddev_samp, C("r"), 63),
    })


def _second(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "gain": rolling(F.avg, F.greatest(C("delta"), F.lit(0.0)), 14, of=C("delta")),
        "loss": rolling(F.avg, -F.least(C("delta"), F.lit(0.0)), 14, of=C("delta")),
        "obv20": rolling(F.sum, F.coalesce(F.signum("delta"), F.lit(0.0)) * C("volume"), 20),
        "up14": rolling(F.sum, F.when(C("typical") > C("typical_prev"), C("money")).otherwise(0.0), 14),
        "down14": rolling(F.sum, F.when(C("typical") < C("typical_prev"), C("money")).otherwise(0.0), 14),
        "vratio": div(C("volume"), C("adv20")),
    })


def signal_columns(variant: str = "B") -> dict[int, Column]:
    """Signals by number over base_columns, all but those that need other rows of the date (34) or regressions (33, 59)."""
    a = variant == "A"
    mean, sd, total = F.avg, F.stddev_samp, F.sum
    high20, low20 = rolling(F.max, C("prev"), 20), rolling(F.min, C("prev"), 20)
    annual = YEAR**0.5 if a else 1.0
    down = F.least(C("r"), F.lit(0.0)) if a else F.when(C("r") < 0, C("r")).otherwise(0.0)
    down = F.when(C("r").isNotNull(), down) if a else down
    rsi = F.when((C("gain") == 0) & (C("loss") == 0), 50.0).when(C("loss") == 0, 100.0).otherwise(100 - 100 / (1 + div(C("gain"), C("loss"))))
    mfi = 100 - 100 / (1 + div(C("up14"), C("down14")))
    if a:
        mfi = F.when(C("down14") == 0, 100.0).when(C("up14") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mfi)))
    market = F.when(C("r").isNotNull(), C("market_return"))
    frame = by_ticker().rowsBetween(-251, 0)
    out = {k: log_ratio(C("close"), lag("close", n)) for k, n in MOMENTUM.items()} | {
        32: log_ratio(lag("close", 21), lag("close", 252)),
        36: C("close") / rolling(F.max, C("close"), 252) - 1,
        37: F.when(high20.isNotNull(), (C("close") > high20).cast("double")),
        38: F.when(low20.isNotNull(), (C("close") < low20).cast("double")),
        39: -C("r"), 40: -log_ratio(C("close"), lag("close", 5)), 41: -log_ratio(C("close"), lag("close", 21)),
        42: log_ratio(C("open"), C("prev")), 43: log_ratio(C("close"), C("open")), 44: -log_ratio(C("open"), C("prev")),
        45: -div(C("open") - C("prev"), C("prev")), 46: -div(C("close") - C("daily_vwap"), C("daily_vwap")),
        47: C("close") / C("ma20") - 1, 48: C("ma20") / C("ma60") - 1, 49: C("ma20") / lag("ma20", 5) - 1,
        50: F.when(C("loss").isNotNull(), 50 - rsi),
        52: div(C("close") - C("ma20"), C("sd20")), 53: -div(C("close") - C("ma20"), C("sd20")),
        54: div(C("high") - C("low"), C("close")), 55: rolling(mean, C("tr"), 14),
        56: annual * rolling(sd, C("r"), 21), 57: annual * C("sd63"), 58: YEAR**0.5 * rolling(sd, down, 63),
        60: F.when(F.count(market).over(frame) >= 252, div(F.covar_samp(C("r"), market).over(frame), F.var_samp(market).over(frame))),
        61: skew(C("r"), 63), 62: kurt(C("r"), 63), 63: drawdown(C("close"), 63),
        64: C("vratio") - 1, 65: C("dollars") if a else F.when(C("dollars") > 0, F.ln("dollars")),
        66: div(C("volume"), C("float_shares")),
        67: rolling(mean, div(F.abs("r"), C("dollars")), 21), 68: div(rolling(mean, C("dollars"), 5), rolling(mean, C("dollars"), 60)) - 1,
        69: corr(C("r"), C("volume"), 20), 71: slope(C("flow"), 20, C("step").cast("double")), 72: mfi,
        70: C("obv") - lag("obv", 20) if a else C("obv20") - lag("obv20"),
        73: div(rolling(total, C("flow"), 20), rolling(total, C("volume"), 20)),
        74: log_ratio(C("close"), lag("close", 21)) * div(C("vratio") - rolling(mean, C("vratio"), 252), rolling(sd, C("vratio"), 252)),
        75: div(log_ratio(C("close"), lag("close", 126)), C("sd63")),
    }
    return out


def name(k: int) -> str:
    return f"alpha_{k}"


def add_signals(bars: DataFrame, ids: list[int], variant: str = "B") -> DataFrame:
    """The bars with `alpha_<id>` for each id."""
    for extra in ("market_return", "float_shares"):
        if extra not in bars.columns:
            bars = bars.withColumn(extra, F.lit(None).cast("double"))
    df = _second(base_columns(bars))
    if variant == "A":
            df = df.withColumn("obv", F.sum(F.coalesce(F.signum("delta"), F.lit(0.0)) * C("volume")).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    if 51 in ids:
        df = _ema(_ema(df, "close", 12, "ema12"), "close", 26, "ema26")
    known = signal_columns(variant)
    own = {name(k): known[k] for k in ids if k in known}
    if 51 in ids:
        own[name(51)] = div(C("ema12") - C("ema26"), C("close"))
    return df.withColumns(own).select(*bars.columns, *(name(k) for k in ids))


def _full(x: str, n: int) -> Column:
    """The last n rows all have x."""
    return C("step") - F.coalesce(C(f"_no_{x}"), F.lit(-1)) >= n


def _varied(x: str, n: int) -> Column:
    """The last n rows all have x, and not one value of it: then and only then their deviation is not 0."""
    return _full(x, n) & (C("step") - C(f"_new_{x}") <= n - 2)


def presence_columns(variant: str = "B") -> dict[int, Column]:
    """Where signals of long frames have a value, over the last rows without and the last rows with another value of what they build on."""
    ratio = lambda n: log_ratio(C("close"), lag("close", n)).isNotNull()
    out = {
        36: _full("close", 252), 37: _full("prev", 20) & C("close").isNotNull(), 38: _full("prev", 20) & C("close").isNotNull(),
        47: _full("close", 20), 48: _full("close", 60), 49: _full("close", 25), 50: _full("delta", 14), 51: C("close") != 0,
        52: _varied("close", 20), 53: _varied("close", 20), 55: _full("tr", 14), 56: _full("r", 21), 57: _full("r", 63), 58: C("step") >= 62,
        60: _varied("market", 252), 61: _varied("r", 63), 62: _varied("r", 63), 67: _full("illiquid", 21), 68: _full("dollars", 60) & (C("step") - C("_some_dollars") < 60),
        69: _varied("r", 20) & _varied("volume", 20), 70: _full("volume", 21), 71: _full("volume", 20), 73: C("adv20") != 0,
        74: ratio(21) & _varied("vratio", 252), 75: ratio(126) & _varied("r", 63),
    }
    return out | {58: _full("r", 63), 70: signal_columns("A")[70].isNotNull()} if variant == "A" else out


def add_presence(bars: DataFrame, ids: list[int], variant: str = "B") -> DataFrame:
    """The bars with `alpha_<id>` for each id: TRUE where `add_signals` gives a value, else NULL.

    Long frames are not gone through again for each row: a frame is full where its rows lie after the last one without a value. Volumes are not negative.
    """
    for extra in ("market_return", "float_shares"):
        if extra not in bars.columns:
            bars = bars.withColumn(extra, F.lit(None).cast("double"))
    df = _second(base_columns(bars))
    upto = by_ticker().rowsBetween(Window.unboundedPreceding, 0)
    if variant == "A":
        df = df.withColumn("obv", F.sum(F.coalesce(F.signum("delta"), F.lit(0.0)) * C("volume")).over(upto))
    df = df.withColumns({"market": F.when(C("r").isNotNull(), C("market_return")), "illiquid": div(F.abs("r"), C("dollars"))})
    df = df.withColumns({f"_last_{x}": lag(x) for x in ("close", "r", "volume", "vratio", "market")})
    seen = {f"_no_{x}": F.max(F.when(C(x).isNull(), C("step"))).over(upto) for x in ("close", "prev", "delta", "tr", "r", "volume", "vratio", "dollars", "market", "illiquid")}
    seen |= {f"_new_{x}": F.max(F.when(C(x) != C(f"_last_{x}"), C("step"))).over(upto) for x in ("close", "r", "volume", "vratio", "market")}
    seen["_some_dollars"] = F.max(F.when(C("dollars") != 0, C("step"))).over(upto)
    known, long = signal_columns(variant), presence_columns(variant)
    return df.withColumns(seen).withColumns({name(k): F.when(long[k] if k in long else known[k].isNotNull(), True) for k in ids}).select(*bars.columns, *(name(k) for k in ids))
