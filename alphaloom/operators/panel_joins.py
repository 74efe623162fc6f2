"""Panels met with prices, metadata and calendars: cleaning, consolidation, matched joins, alignment and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import clean, log_ratio
from .bars import OHLCV, bar_rules

KEYS = ["date", "ticker"]
META = ("company_name", "sector", "industry", "sub_industry")
#: The order of the final groups of candidates: fixed values.
GROUP_ORDER = ("final_core_candidates", "final_interaction_candidates", "final_watchlist_candidates", "final_excluded_for_now")


# ---------------------------------------------------------------- prices


def clean_prices(prices: DataFrame) -> DataFrame:
    """Rows with date, ticker and a positive close; an adjusted close, where there is one, is positive too."""
    ok = F.col("date").isNotNull() & (F.trim(F.col("ticker").cast("string")) != "") & (F.col("close") > 0)
    if "adjusted_close" in prices.columns:
        ok &= F.col("adjusted_close").isNull() | (F.col("adjusted_close") > 0)
    return prices.filter(ok)


def consolidate(prices: DataFrame, order: list[str]) -> DataFrame:
    """One row a ticker and date: first open, highest high, lowest low, last close and adjusted close by `order`, summed volume."""
    key = F.struct(*order)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(c)
    how = {"open": first, "high": lambda c: F.max(c).alias(c), "low": lambda c: F.min(c).alias(c), "close": last, "volume": lambda c: F.sum(c).alias(c), "adjusted_close": last}
    return prices.groupBy("ticker", "date").agg(*(f(c) for c, f in how.items() if c in prices.columns))


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Adds ret_fwd_{h}d: ln(P[+h] / P), P the adjusted close if the table has any, else the close; NULL unless both are positive."""
    price = F.col("close")
    if "adjusted_close" in prices.columns and not prices.filter("adjusted_close IS NOT NULL").isEmpty():
        price = F.col("adjusted_close")
    w = Window.partitionBy("ticker").orderBy("date")
    return prices.withColumns({f"ret_fwd_{h}d": log_ratio(F.lead(price, h).over(w), price) for h in horizons})


def with_prices(panel: DataFrame, prices: DataFrame, columns: list[str]) -> DataFrame:
    """The panel with the price columns of its (date, ticker) and `matched`; price keys are unique."""
    own = prices.select(*KEYS, *columns, F.lit(True).alias("matched"))
    return panel.join(own, KEYS, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def unmatched(panel: DataFrame, prices: DataFrame) -> DataFrame:
    """Panel rows without a price row, kept aside as they are."""
    return panel.join(prices.select(*KEYS), KEYS, "left_anti")


def most_unmatched(rows: DataFrame, n: int = 20) -> DataFrame:
    """The n tickers with the most unmatched rows: a top-k report."""
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("unmatched_rows")).orderBy(F.desc("unmatched_rows"), "ticker").limit(n)


def last_rows(panel: DataFrame, h: int) -> DataFrame:
    """The last h rows of each ticker, whose forward return of h rows cannot be known."""
    w = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return panel.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= h).drop("_k")


def validate_minutes(minutes: DataFrame) -> DataFrame:
    """Per ticker: minutes that break a rule, times that repeat or go back in file order (`seq`, where given), and whether it passes.

    Values may hold NaN and infinities, as they come from a file.
    """
    numbers = [F.col(c) for c in OHLCV]
    inf = F.coalesce(F.greatest(*((F.abs(c) == float("inf")).cast("int") for c in numbers)), F.lit(0)) == 1
    rows = minutes.withColumn("_inf", inf).withColumns({c: clean(F.col(c)) for c in OHLCV})
    rules = {"no_time": F.col("ts").isNull(), "inf": F.col("_inf"), **bar_rules(0.0)}
    back = F.lit(False)
    if "seq" in minutes.columns:
        rows = rows.withColumn("_before", F.max("ts").over(Window.partitionBy("ticker").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
        back = F.coalesce(F.col("ts") < F.col("_before"), F.lit(False))
    out = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), (F.count("ts") - F.count_distinct("ts")).alias("duplicates"), F.count_if(back).alias("unsorted"), *(F.count_if(c).alias(k) for k, c in rules.items()))
    return out.withColumn("passed", sum((F.col(k) for k in rules), F.col("duplicates") + F.col("unsorted")) == 0)


def single_ticker(rows: DataFrame) -> DataFrame:
    """The one ticker of a frame, and whether it is the only one: (ticker, n_tickers, ok)."""
    n = F.count_distinct("ticker")
    return rows.agg(F.min("ticker").alias("ticker"), n.alias("n_tickers"), (n == 1).alias("ok"))


# ---------------------------------------------------------------- metadata


def overwrite_metadata(panel: DataFrame, mapping: DataFrame, columns: tuple[str, ...] = META, patch: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Mapped values in place of the panel's wherever they are not blank; `patch` fills tickers that the mapping lacks.

    The mapping has one row a ticker.
    """
    text = lambda c: F.trim(F.col(c).cast("string"))
    given = lambda c: F.when(~text(c).isin("", "nan", "None"), text(c))
    own = mapping.select("ticker", F.lit(True).alias("_known"), *(given(c).alias(f"_{c}") for c in columns if c in mapping.columns))
    out = panel.join(own, "ticker", "left")
    for c in columns:
        have = F.col(c) if c in panel.columns else F.lit("")
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), have) if f"_{c}" in own.columns else have)
        for ticker, values in (patch or {}).items():
            if c in values:
                out = out.withColumn(c, F.when((F.col("ticker") == ticker) & F.col("_known").isNull(), values[c]).otherwise(F.col(c)))
    return out.drop("_known", *(f"_{c}" for c in columns))


def missing_by_group(panel: DataFrame, column: str, group: str = "sector") -> DataFrame:
    """group, n_rows, missing_rate of a column."""
    return panel.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(column).isNull().cast("double")).alias("missing_rate"))


# ---------------------------------------------------------------- columns


def demeaned(x: str, by: str = "date") -> Column:
    """A column less its mean on the date."""
    return F.col(x) - F.avg(x).over(Window.partitionBy(by))


def aligned(panel: DataFrame, actions: dict[str, str], suffix: str = "_aligned") -> DataFrame:
    """Adds {signal}{suffix} for every signal kept: as it is or times -1 by its action, missing values 0; excluded signals get none."""
    known = {"keep_as_is": 1.0, "multiply_by_minus_one": -1.0, "exclude": None}
    if wrong := {a: v for a, v in actions.items() if v not in known}:
        raise ValueError(f"unknown actions: {wrong}")
    return panel.withColumns({f"{a}{suffix}": F.coalesce(F.col(a) * F.lit(known[v]), F.lit(0.0)) for a, v in actions.items() if known[v]})


def count_true(columns: list[str]) -> Column:
    """How many of the columns are true in a row; NULL counts as false."""
    return sum((F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int") for c in columns), F.lit(0))


def rolling_mean(series: DataFrame, x: str, n: int = 20, on: str = "date", by: list[str] | None = None) -> DataFrame:
    """Adds {x}_rolling{n}: the mean of the last n rows of a series, NULL before there are n. A series has one row a date (and key)."""
    w = Window.partitionBy(*(by or [])).orderBy(on).rowsBetween(1 - n, 0)
    return series.withColumn(f"{x}_rolling{n}", F.when(F.count(x).over(w) >= n, F.avg(x).over(w)))


def to_calendar(calendar: DataFrame, series: DataFrame, x: str, fill: float = 0.0, on: str = "date") -> DataFrame:
    """A series on the dates of a calendar, `fill` where it has none."""
    return calendar.select(on).distinct().join(series.select(on, x), on, "left").withColumn(x, F.coalesce(x, F.lit(fill)))


def benchmark_curve(returns: DataFrame, x: str, on: str = "date") -> DataFrame:
    """date, cum: compounded returns over the first day's value, so every curve begins at 1. One row a date."""
    w = Window.orderBy(on)
    grown = returns.select(on, F.product(1 + F.coalesce(F.col(x), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    return grown.withColumn("cum", F.col("cum") / F.first("cum").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


# ---------------------------------------------------------------- reports


def first_of_each(table: DataFrame, by: str, order: list[Column], n: int = 12) -> DataFrame:
    """The first row of each `by` in an order, and of these the first n: a top-k report."""
    one = table.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_k = 1").drop("_k")
    return one.orderBy(*order).limit(n)


def group_place(group: Column, names: tuple[str, ...] = GROUP_ORDER) -> Column:
    """The place of a group's name in the order that they are read in; 99 for others."""
    place = F.lit(99)
    for k, name in enumerate(names):
        place = F.when(group == name, k).otherwise(place)
    return place


def diagnostics(panel: DataFrame, alphas: list[str], targets: list[str], n_unmatched: DataFrame) -> DataFrame:
    """section, item, value, status: a panel's shape, keys, empty signals, missing prices and unmatched rows, in one scan.

    `n_unmatched` is one row (n). Duplicate keys and unmatched rows fail; empty, mostly empty or partly missing columns warn.
    """
    prices = [c for c in OHLCV if c in panel.columns]
    got = panel.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("date").alias("dates"), (F.count(F.lit(1)) - F.count_distinct(*KEYS)).alias("twice"),
        *(F.count(c).alias(f"n|{c}") for c in dict.fromkeys([*alphas, *targets, *prices])),
    ).crossJoin(n_unmatched.select(F.col("n").alias("unmatched")))
    total = F.col("rows")
    empty = sum(((F.col(f"n|{a}") == 0).cast("int") for a in alphas), F.lit(0))
    thin = sum(((F.col(f"n|{a}") * 2 < total).cast("int") for a in alphas), F.lit(0))
    rate = lambda c: F.when(total > 0, 1 - F.col(f"n|{c}") / total).otherwise(1.0)
    status = lambda bad, word: F.when(bad, word).otherwise("PASS")
    rows = [("panel", k, F.col(c).cast("double"), F.lit("PASS")) for k, c in (("rows", "rows"), ("tickers", "tickers"), ("dates", "dates"))]
    rows += [("panel", "raw_signals", F.lit(float(len(alphas))), F.lit("PASS")), *(("panel", f"valid_{t}", F.col(f"n|{t}").cast("double"), F.lit("PASS")) for t in targets)]
    rows += [("quality", "duplicate_keys", F.col("twice").cast("double"), status(F.col("twice") > 0, "FAIL")), ("quality", "unmatched_rows", F.col("unmatched").cast("double"), status(F.col("unmatched") > 0, "FAIL"))]
    rows += [("quality", "empty_signals", empty.cast("double"), status(empty > 0, "WARNING")), ("quality", "mostly_empty_signals", thin.cast("double"), status(thin > 0, "WARNING"))]
    rows += [("quality", f"missing_ratio_{c}", rate(c), status(rate(c) > 0, "WARNING")) for c in prices]
    made = F.array(*(F.struct(F.lit(s).alias("section"), F.lit(i).alias("item"), v.alias("value"), st.alias("status")) for s, i, v, st in rows))
    return got.select(F.explode(made).alias("r")).select("r.*")
