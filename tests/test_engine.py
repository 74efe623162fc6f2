"""The factor engine against pandas and against SQL, on small tables with missing values and ties."""

import datetime as dt
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from alphaloom.functions.ranks import pct_rank, unit_rank
from alphaloom.functions.rolling_ols import rolling_residual
from alphaloom.functions.signals import add_presence, add_signals
from alphaloom.operators import bars, evaluation, portfolio, quality_checks, selection, splits
from alphaloom.operators.asof import asof_backward
from alphaloom.plans.queries import ORACLE, QUERIES
from alphaloom.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def history():
    rng = np.random.default_rng(0)
    parts = []
    for t in ("A", "B"):
        close = 50 * np.exp(np.cumsum(0.02 * rng.standard_normal(420)))
        p = pd.DataFrame({"ticker": t, "date": pd.bdate_range("2020-01-01", periods=420).date, "open": close * (1 + 0.01 * rng.standard_normal(420)), "close": close, "volume": rng.integers(0, 9, 420) * 100.0})
        p["high"], p["low"] = p[["open", "close"]].max(axis=1) * 1.01, p[["open", "close"]].min(axis=1) * 0.99
        p.loc[10:40, "close"] = p.loc[10, "close"]  # a constant stretch
        p.loc[50, ["high", "low"]] = p.loc[50, "close"]
        p["daily_vwap"] = p["close"]
        p["market_return"] = rng.standard_normal(420) * 0.01
        parts.append(p)
    return pd.concat(parts, ignore_index=True)


def expected(p: pd.DataFrame) -> pd.DataFrame:
    c, v = p["close"], p["volume"]
    r = np.log(c / c.shift(1))
    out = {61: r.rolling(63).skew(), 62: r.rolling(63).kurt(), 51: (c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()) / c}
    sd = c.rolling(20).std()
    out[52] = ((c - c.rolling(20).mean()) / sd.mask(sd < 1e-9))
    out[63] = c.rolling(63).apply(lambda x: (x / np.maximum.accumulate(x) - 1).min(), raw=True)
    out[36] = c / c.rolling(252).max() - 1
    out[60] = r.rolling(252).cov(p["market_return"]) / p["market_return"].rolling(252).var()
    out[64] = v / v.rolling(20).mean() - 1
    out[71] = (((c - p["low"]) - (p["high"] - c)) / (p["high"] - p["low"]).replace(0, np.nan)).fillna(0).mul(v).rolling(20).apply(lambda y: np.polyfit(np.arange(20), y, 1)[0], raw=True)
    tr = pd.concat([p["high"] - p["low"], (p["high"] - c.shift(1)).abs(), (p["low"] - c.shift(1)).abs()], axis=1).max(axis=1)
    out[55] = tr.rolling(14).mean()
    return pd.DataFrame({f"alpha_{k}": x for k, x in out.items()})


@pytest.mark.parametrize("variant", ["A", "B"])
def test_presence_is_where_signals_have_values(spark, variant):
    """Gaps, zeros and constant stretches; the plan goes through no long frame again for each row."""
    rng = np.random.default_rng(4)
    parts = []
    for k in range(6):
        n = 620
        p = pd.DataFrame({"ticker": k, "date": pd.bdate_range("2020-01-01", periods=n).date, "volume": rng.integers(0, 4, n) * 100.0, "market_return": rng.normal(size=n), "float_shares": rng.integers(0, 3, n) * 1000.0})
        for c in ("open", "close", "daily_vwap"):
            p[c] = np.round(50 + 5 * rng.standard_normal(n), 1)
        p["high"], p["low"] = p[["open", "close"]].max(axis=1), p[["open", "close"]].min(axis=1)
        p.loc[30 : 30 + 20 * k, "close"] = 50.0
        p.loc[200 : 200 + 14 * k, "volume"] = 0.0
        p.loc[280 : 480 + 25 * k, "market_return"] = 0.01
        p.loc[300 : 300 + 60 * k, "volume"] = 100.0
        if k % 2:
            for c in ("open", "high", "low", "close", "volume", "market_return"):
                p.loc[rng.choice(np.r_[0:20, 560:n], 3), c] = np.nan
            p.loc[rng.choice(np.arange(560, n), 3), ["open", "close"]] = 0.0
        parts.append(p)
    rows = spark.createDataFrame(pd.concat(parts, ignore_index=True).astype(object).where(lambda x: x.notna(), None).values.tolist(), "ticker long, date date, volume double, market_return double, float_shares double, open double, close double, daily_vwap double, high double, low double")
    ids = sorted({*range(26, 33), *range(36, 59), *range(60, 76)})
    names = [f"alpha_{k}" for k in ids]
    both = [f(rows, ids, variant).select("ticker", "date", *(F.col(c).isNotNull().alias(c) for c in names)).toPandas().sort_values(["ticker", "date"], ignore_index=True) for f in (add_signals, add_presence)]
    wrong = {c: int((both[0][c] != both[1][c]).sum()) for c in names}
    assert not any(wrong.values()), wrong
    late = both[0].groupby("ticker").cumcount() >= 260
    sparse = [c for c in names if not both[0].loc[late, c].all()]  # values missing not only for want of rows
    assert len(sparse) > 20
    checked = quality_checks.missing_rates(add_presence(rows, [k for k in ids if k != 63], variant), [c for c in names if c != "alpha_63"])
    assert "-251, currentrow" not in checked._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_ties_are_broken_by_ticker(spark):
    """Equal counts of values in another order: sums of shares differ in their last bits, counts do not."""
    rows = [(t, k, *((1.0,) * n + (None,) * (6 - n))) for t, ns in ((2, (6, 5, 4, 2, 6, 4, 1)), (1, (1, 4, 6, 2, 4, 5, 6)), (3, (4, 4, 4, 4, 4, 4, 4))) for k, n in enumerate(ns)]
    names = [f"alpha_{k}" for k in range(6)]
    table = spark.createDataFrame(rows, "ticker long, date int, " + ", ".join(f"{c} double" for c in names)).coalesce(1)
    got = quality_checks.coverage_worst(table, names).collect()
    assert [(r["ticker"], r["coverage"]) for r in got] == [(1, 28 / 42), (2, 28 / 42), (3, 28 / 42)]
    assert quality_checks.coverage_worst(table.limit(0), names).count() == 0


def test_signals_equal_pandas(spark, history):
    ids = [36, 51, 52, 55, 60, 61, 62, 63, 64, 71]
    got = add_signals(spark.createDataFrame(history), ids).toPandas().sort_values(["ticker", "date"], ignore_index=True)
    want = pd.concat([expected(g.reset_index(drop=True)) for _, g in history.groupby("ticker")], ignore_index=True)
    for k in ids:
        a, b = got[f"alpha_{k}"].to_numpy(float), want[f"alpha_{k}"].replace([np.inf, -np.inf], np.nan).to_numpy(float)
        assert np.allclose(a, b, atol=1e-6, equal_nan=True), k


def test_long_histories_keep_exponential_averages_finite(spark):
    n = 2500
    p = pd.DataFrame({"ticker": "A", "date": pd.date_range("2000-01-01", periods=n).date, "close": 10 + np.sin(np.arange(n) / 9)})
    for c in ("open", "high", "low", "daily_vwap"):
        p[c] = p["close"]
    p["volume"] = 1.0
    got = add_signals(spark.createDataFrame(p), [51]).orderBy("date").toPandas()["alpha_51"]
    c = p["close"]
    assert np.allclose(got, (c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()) / c, atol=1e-12)


def test_rolling_residual_equals_lstsq():
    rng = np.random.default_rng(1)
    y, x = rng.standard_normal(120), rng.standard_normal((120, 3))
    y[5], x[70, 1] = np.nan, np.nan
    got = rolling_residual(y, x, 40)
    for t in range(120):
        lo = t - 39
        if lo < 0 or not np.isfinite(y[t]) or not np.isfinite(x[t]).all():
            assert math.isnan(got[t])
            continue
        d = np.column_stack([np.ones(40), x[lo : t + 1]])
        ok = np.isfinite(y[lo : t + 1]) & np.isfinite(d).all(1)
        beta = np.linalg.lstsq(d[ok], y[lo : t + 1][ok], rcond=None)[0]
        assert got[t] == pytest.approx(y[t] - d[-1] @ beta, abs=1e-9)


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, x) for x in (3.0, None, 1.0, 3.0, 2.0)] + [(2, 5.0), (3, None)], "g int, x double")
    got = df.select("g", "x", pct_rank(F.col("x"), ["g"]).alias("p"), unit_rank(F.col("x"), ["g"]).alias("u")).toPandas()
    s = got[got.g == 1]
    want = s.x.rank() / s.x.notna().sum()
    assert np.allclose(s.p, want, equal_nan=True) and np.allclose(s.u, (s.x.rank() - 1) / 3, equal_nan=True)
    assert got[got.g == 2].u.item() == 0.5 and got[got.g == 3].u.isna().all()


def test_asof_and_staleness(spark):
    d = lambda k: dt.date(2020, 1, k)
    panel = spark.createDataFrame([("A", d(1)), ("A", d(5)), ("A", d(9)), ("B", d(5))], "ticker string, date date")
    snaps = spark.createDataFrame([("A", d(5), 2.0), ("A", d(3), 1.0)], "ticker string, date date, v double")
    got = {(r["ticker"], r["date"].day): r["v"] for r in asof_backward(panel, snaps, "v").collect()}
    assert got == {("A", 1): None, ("A", 5): 2.0, ("A", 9): 2.0, ("B", 5): None}
    stale = {(r["ticker"], r["date"].day): r["v"] for r in asof_backward(panel, snaps, "v", stale_after_last=True).collect()}
    assert stale["A", 9] is None and stale["A", 5] == 2.0


def test_constant_cross_sections_have_no_ic(spark):
    rows = [(dt.date(2020, 1, 1), str(i), "a", 1.0, float(i)) for i in range(60)] + [(dt.date(2020, 1, 2), str(i), "a", float(i), float(i)) for i in range(60)]
    pairs = spark.createDataFrame(rows, "date date, ticker string, alpha string, value double, target double")
    got = evaluation.daily_rank_ic(pairs).collect()
    assert len(got) == 1 and got[0]["ic"] == pytest.approx(1.0)
    assert evaluation.ic_summary(evaluation.daily_rank_ic(pairs)).first()["t_stat"] is None


def test_newey_west_by_hand(spark):
    x = [1.0, 2.0, 4.0, 3.0, 5.0, 2.5]
    s = spark.createDataFrame([("a", dt.date(2020, 1, k + 1), v) for k, v in enumerate(x)], "alpha string, date date, v double")
    c, n = np.array(x) - np.mean(x), 6
    lrv = c @ c / n + sum(2 * (1 - k / 3) * (c[k:] @ c[:-k]) / n for k in (1, 2))
    assert evaluation.newey_west(s, "v", 2).first()["t_nw"] == pytest.approx(np.mean(x) / math.sqrt(lrv / n))


def test_bars_checks_and_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Ticker Name,Daily-Open\n brk/b us equity,1\n")
    df = tables.read_table(spark, f"{tmp_path}/x.csv")
    assert df.columns == ["ticker_name", "daily_open"]
    assert df.select(tables.ticker(F.col("ticker_name"))).first()[0] == "BRK.B"
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/x.xlsx")
    raw = spark.createDataFrame([("a", "2020-01-01", "1", "x", "1", "2", "3"), ("a", "2020-01-01", "1", "3", "1", "2", "-3")], "ticker string, date string, open string, high string, low string, close string, volume string")
    std = bars.standardise_daily(raw)
    got = bars.validate_bars(std, min_rows=1).first()
    assert (got["missing"], got["duplicates"], got["volume"], got["passed"]) == (1, 1, 1, False)
    report = spark.createDataFrame([("c", "FAIL", "1")], quality_checks.REPORT)
    with pytest.raises(ValueError):
        quality_checks.gated_write(std, report, f"{tmp_path}/out")
    quality_checks.gated_write(std, report, f"{tmp_path}/out.parquet", force=True)
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 2
    lines = spark.createDataFrame([(0, "Cluster 1"), (1, "  alpha_26: icir=-0.5"), (2, "Cluster 2"), (3, " alpha_30: icir=x")], "no int, line string")
    assert [(r["cluster"], r["alpha"], r["icir"]) for r in tables.report_rows(lines).orderBy("no").collect()] == [(1, "alpha_26", -0.5), (2, "alpha_30", None)]
    assert tables.best_date_column(raw.select("ticker", "date", "open")) == "date"


def test_selection_on_the_driver():
    corr = {("a", "b"): 0.9, ("b", "c"): 0.9, ("a", "c"): 0.1}
    assert selection.greedy_clusters([("b", 0.1), ("a", -0.5), ("c", 0.3)], corr) == [("a", "a", 1), ("b", "a", 1), ("c", "c", 2)]
    assert set(selection.correlated_components(["a", "b", "c"], [("a", "b", 0.9), ("b", "c", -0.9)]).values()) == {"a"}
    assert selection.ordered_drop(["a", "b", "c"], corr) == ["a", "c"]


def test_elastic_net_optimality():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 5)) * [1, 2, 3, 1, 1]
    y = x @ [0.5, 0, -0.2, 0, 0.1] + 0.1 * rng.standard_normal(300) + 3
    d = np.column_stack([np.ones(300), x, y])
    b = selection.elastic_net(d.T @ d, 0.05, 0.6)
    z, t = (x - x.mean(0)) / x.std(0), y - y.mean()
    g = z.T @ (t - z @ b) / 300 - 0.05 * 0.4 * b
    assert all(abs(gk - 0.03 * np.sign(bk)) < 1e-7 if bk else abs(gk) <= 0.03 + 1e-7 for gk, bk in zip(g, b))


def test_simulation_carries_the_last_valid_rebalance(spark):
    day = lambda k: dt.date(2020, 1, k)
    scores = spark.createDataFrame([(day(3), "A", 2.0), (day(3), "B", 1.0), (day(10), "A", 1.0)], "date date, ticker string, score double")
    rets = spark.createDataFrame([(day(k), t, 0.1 if t == "A" else -0.1) for k in (3, 6, 10, 13) for t in "AB"], "date date, ticker string, ret double")
    got = {r["date"].day: (r["long_ret"], r["short_ret"], r["ls_ret"]) for r in portfolio.simulate(scores, rets, n=1).collect()}
    assert got[3] == pytest.approx((0.098, -0.1, 0.198)) and got[6] == pytest.approx((0.1, -0.1, 0.2))
    assert got[10] == pytest.approx((0.098, -0.1, 0.198))  # no valid rebalance on the 10th, yet its cost


def test_folds(spark):
    days = spark.createDataFrame([(dt.date(2020, 1, k + 1),) for k in range(11)], "date date")
    fold = [r["fold"] for r in splits.expanding_folds(days, 3).orderBy("date").collect()]
    assert fold == [k for k, b in enumerate(np.array_split(np.arange(11), 4)) for _ in b]


def test_stream_bars(spark, tmp_path):
    from alphaloom.streaming.bars import stream_bars

    t = lambda k, h: dt.datetime(2020, 1, k, h)
    rows = [("A", t(1, 9), 1.0, 2.0), ("A", t(1, 8), 3.0, 1.0), ("A", t(1, 15), 2.0, 1.0), ("A", t(9, 9), 5.0, 1.0)]
    schema = "ticker string, ts timestamp, price double, qty double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("bars_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {r["date"].day: r for r in spark.table("bars_out").collect()}
    assert (got[1]["open"], got[1]["close"], got[1]["volume"], got[1]["daily_vwap"]) == (3.0, 2.0, 4.0, 1.75) and 9 in got


@pytest.mark.parametrize("name", ["momentum_top10", "cs_a", "fama_macbeth", "simulate_weighted", "universe", "signal_stats", "thin_groups", "classify", "beta_summary", "fama_macbeth_controls", "method_groups", "final_candidates", "factors_long", "alpha_55"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want, cols = con.execute(ORACLE[name]).df(), sorted(df.columns)
    assert cols == sorted(want.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    text = lambda rows: sorted(str(tuple(None if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)[:10] for v in row)) for row in rows)
    assert text(got) == text(want[cols].astype(object).itertuples(index=False, name=None))


def test_date_gaps_are_those_of_all_tickers(spark, tmp_path):
    days = [(1, 1), (7, 4), (1, 9), (9, 20)]  # ticker, day: ticker 7 fills the gap of ticker 1, nobody that before ticker 9
    rows = [(t, dt.datetime(2020, 1, day), 10.0, 2.0, k, 1, 1) for k, (t, day) in enumerate(days)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in QUERIES["qa_date_gaps"](spark, str(tmp_path)).collect()] == [(dt.date(2020, 1, 20), 11)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
