"""Panels met with prices and calendars, and statistics that share an exchange, on small tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import bars, evaluation, panel_joins, portfolio, selection, splits
from alphaloom.sources import tables

DAY = dt.date(2020, 1, 1)


def test_prices_are_cleaned_and_consolidated(spark):
    rows = [("A", DAY, 1.0, 3.0, 1.0, 2.0, 5.0, None, 1), ("A", DAY, 2.0, 4.0, 0.5, 3.0, 5.0, 1.5, 2), ("A", DAY, 9.0, 9.0, 9.0, 0.0, 5.0, 1.0, 3), ("A", DAY, 9.0, 9.0, 9.0, 9.0, 5.0, -1.0, 4), (" ", DAY, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 5), ("A", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 6)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, adjusted_close double, line int")
    got = panel_joins.consolidate(panel_joins.clean_prices(df), ["line"]).collect()
    assert [tuple(r) for r in got] == [("A", DAY, 1.0, 4.0, 0.5, 3.0, 10.0, 1.5)]


def test_forward_returns_take_the_adjusted_close_where_there_is_any(spark):
    days = [DAY + dt.timedelta(k) for k in range(3)]
    rows = spark.createDataFrame([("A", d, c, a) for d, c, a in zip(days, (1.0, 2.0, 4.0), (1.0, None, 3.0))], "ticker string, date date, close double, adjusted_close double")
    assert [r["ret_fwd_1d"] for r in panel_joins.forward_returns(rows, (1,)).orderBy("date").collect()] == [None, None, None]
    plain = panel_joins.forward_returns(rows.withColumn("adjusted_close", F.lit(None).cast("double")), (1,)).orderBy("date").collect()
    assert [r["ret_fwd_1d"] for r in plain] == [pytest.approx(np.log(2)), pytest.approx(np.log(2)), None]


def test_minutes_are_validated(spark):
    at = lambda k: dt.datetime(2020, 1, 1, 9, k)
    good = (1.0, 2.0, 0.5, 1.0, 1.0)
    rows = [("ok", at(1), *good, 1), ("ok", at(2), *good, 2), ("twice", at(1), *good, 1), ("twice", at(1), *good, 2), ("back", at(5), *good, 1), ("back", at(2), *good, 2), ("inf", at(1), 1.0, float("inf"), 0.5, 1.0, 1.0, 1),
            ("high", at(1), 1.0, 0.9, 0.5, 1.0, 1.0, 1), ("none", None, *good, 1), ("price", at(1), 0.0, 2.0, 0.0, 1.0, 1.0, 1), ("volume", at(1), 1.0, 2.0, 0.5, 1.0, -1.0, 1)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, open double, high double, low double, close double, volume double, seq int")
    got = {r["ticker"]: r for r in panel_joins.validate_minutes(df).collect()}
    assert {t for t, r in got.items() if r["passed"]} == {"ok"}
    assert got["twice"]["duplicates"] == got["back"]["unsorted"] == got["inf"]["inf"] == got["high"]["high_logic"] == got["none"]["no_time"] == got["price"]["price"] == got["volume"]["volume"] == 1


def test_metadata_and_alignment(spark):
    panel = spark.createDataFrame([("A", "old", 1.0), ("B", "old", None), ("E", "old", 3.0)], "ticker string, sector string, alpha_1 double")
    mapping = spark.createDataFrame([("A", "new"), ("B", " nan ")], "ticker string, sector string")
    got = panel_joins.overwrite_metadata(panel, mapping, ("sector", "industry"), {"E": {"sector": "IT"}, "A": {"sector": "never"}})
    assert {(r["ticker"], r["sector"], r["industry"]) for r in got.collect()} == {("A", "new", ""), ("B", "old", ""), ("E", "IT", "")}
    assert [r[0] for r in panel_joins.aligned(panel, {"alpha_1": "multiply_by_minus_one"}).orderBy("ticker").select("alpha_1_aligned").collect()] == [-1.0, 0.0, -3.0]
    with pytest.raises(ValueError, match="unknown actions"):
        panel_joins.aligned(panel, {"alpha_1": "halve"})


def test_pair_ranks_against_pandas(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.normal(size=300).round(1), "b": rng.normal(size=300), "c": rng.integers(0, 3, 300).astype(float)})
    x.loc[:40, "b"] = np.nan
    x["k"] = range(300)
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in x.itertuples(index=False)], "a double, b double, c double, k long")
    for rank in (True, False):
        got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in selection.pair_correlation(df, ["a", "b", "c"], ["k"], rank=rank, buckets=8).collect()}
        want = {(i, j): x[[i, j]].dropna() for i, j in (("a", "b"), ("a", "c"), ("b", "c"))}
        assert got == {p: (len(v), pytest.approx((v.rank() if rank else v).corr().iloc[0, 1])) for p, v in want.items()}
    assert selection.pair_correlation(df, ["a"], ["k"]).count() == 0


def test_daily_statistics_equal_the_single_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(DAY + dt.timedelta(d), f"T{k}", float(rng.normal()) if rng.random() > 0.1 else None, float(rng.integers(0, 2)), float(rng.normal()) if rng.random() > 0.1 else None) for d in range(4) for k in range(30)]
    panel = spark.createDataFrame(rows, "date date, ticker string, x double, two double, y double")
    got = {(r["alpha"], r["date"]): r for r in evaluation.daily_statistics(panel, ["x", "two"], "y", ("two",)).collect()}
    pairs = evaluation.unpivot(panel, ["x", "two"], "y")
    assert len(got) == 8 and all(r["n_rows"] == 30 for r in got.values())
    for name, one in (("beta", evaluation.daily_ols(pairs, 20)), ("ic", evaluation.daily_rank_ic(pairs, 20)), ("spread", evaluation.decile_spread(pairs.filter("alpha = 'x'")).unionByName(evaluation.binary_spread(pairs.filter("alpha = 'two'")), allowMissingColumns=True))):
        want = {(r["alpha"], r["date"]): r[name] for r in one.collect()}
        assert {k: r[name] for k, r in got.items() if r[name] is not None} == {k: pytest.approx(v) for k, v in want.items()}


def test_curves_begin_at_one_and_follow_the_calendar(spark):
    days = [DAY + dt.timedelta(k) for k in range(4)]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    series = spark.createDataFrame([(days[0], 0.5), (days[2], 0.1), (DAY - dt.timedelta(9), 9.0)], "date date, x double")
    got = panel_joins.benchmark_curve(panel_joins.to_calendar(calendar, series, "x"), "x").orderBy("date").collect()
    assert [r["cum"] for r in got] == [pytest.approx(v) for v in (1, 1, 1.1, 1.1)]


def test_regime_scales_long_and_long_short(spark):
    days = [DAY + dt.timedelta(k) for k in range(3)]
    scores = spark.createDataFrame([(d, t, s) for d in days for t, s in (("A", 2.0), ("B", 1.0))], "date date, ticker string, score double")
    returns = spark.createDataFrame([(d, t, r) for d in days for t, r in (("A", 0.10), ("B", 0.02))], "date date, ticker string, ret double")
    scale = spark.createDataFrame([(days[0], 1.0), (days[1], 0.5)], "date date, regime_scale double")
    got = portfolio.simulate(scores, returns, n=1, bucket="day", scale=scale).orderBy("date").collect()
    assert [tuple(r)[1:] for r in got] == [pytest.approx(v) for v in ((0.10, 0.02, 0.078, 1.0), (0.05, 0.02, 0.039, 0.5), (0.05, 0.02, 0.039, 0.5))]


def test_small_operators(spark, tmp_path):
    rows = spark.createDataFrame([(DAY + dt.timedelta(k // 3), f"T{k % 3}", float(k % 4) - 1, float(k % 3) - 1) for k in range(30)], "date date, ticker string, a double, b double")
    assert splits.drop_thin(rows.filter("date > DATE'2020-01-02' OR ticker = 'T0'"), 3).select("date").distinct().count() == 8
    one, two = (sorted(r[0] for r in splits.sample_dates(rows, 4, seed).collect()) for seed in (1, 1))
    assert one == two and len(one) == 4
    same = selection.sign_agreement(rows.withColumn("g", F.lit(1)), "a", "b", ["g"]).first()
    pairs = [(k % 4 - 1, k % 3 - 1) for k in range(30) if (k % 4 - 1) * (k % 3 - 1)]
    assert (same["agreement"], same["n"]) == (pytest.approx(np.mean([np.sign(a) == np.sign(b) for a, b in pairs])), len(pairs))
    assert bars.drop_exact_duplicates(rows.unionByName(rows)).count() == 30
    rows.write.parquet(f"{tmp_path}/t.parquet")
    assert tables.preview(spark, f"{tmp_path}/t.parquet", 4).count() == 4
    assert tables.first_present(rows, ["z", "b"]) is not None and tables.first_present(rows, ["z"]) is None
    assert [r[0] for r in spark.createDataFrame([("brk b us equity",), ("BF/B",)], "t string").select(tables.ticker(F.col("t"))).collect()] == ["BRK.B", "BF.B"]
    times = spark.createDataFrame([("01/02/2020 09:30",), ("2020-01-02T09:30:00",), ("never",)], "t string").select(tables.parse_timestamp(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in times] == [dt.datetime(2020, 1, 2, 9, 30)] * 2 + [None]
    assert panel_joins.single_ticker(rows).first()["ok"] is False and panel_joins.last_rows(rows, 2).count() == 6
