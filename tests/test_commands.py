"""The commands from price files to method groups, on a small folder."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from alphaloom import commands


def _folder(root, names=8, days=340):
    rng = np.random.default_rng(4)
    prices = root / "prices"
    prices.mkdir()
    dates = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(days)]
    for t in range(names):
        c = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        o = c * (1 + rng.normal(0, 0.005, days))
        pd.DataFrame({"Date": dates, "Open": o, "High": np.maximum(o, c) * 1.01, "Low": np.minimum(o, c) * 0.99, "Close": c, "Volume": rng.integers(100, 1000, days)}).to_csv(prices / f"T{t}_daily.csv", index=False)
    short = pd.DataFrame({"Date": dates[:9], "Open": 1.0, "High": 1.0, "Low": 1.0, "Close": 1.0, "Volume": 1})
    short.to_csv(prices / "SHORT.csv", index=False)
    short.to_csv(prices / "UNKNOWN.csv", index=False)
    pd.DataFrame({"Ticker": [*(f"t{t}" for t in range(names)), "short"], "Sector": [*("AB"[t % 2] for t in range(names)), "A"]}).to_csv(root / "universe.csv", index=False)
    level = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, days)))
    pd.DataFrame({"date": dates, "close": level}).to_csv(root / "market.csv", index=False)
    pd.DataFrame({"date": dates, **{f: rng.normal(0, 0.01, days) for f in ("mkt_rf", "smb", "hml", "mom", "rf")}}).to_csv(root / "factors.csv", index=False)
    return prices


def test_commands_in_a_row(spark, tmp_path):
    prices, w = _folder(tmp_path), str(tmp_path)
    run = lambda *a: commands.main([str(x) for x in a])
    assert run("process-folder", "--universe", f"{w}/universe.csv", "--input-dir", prices, "--batch-id", "b1", "--output-dir", f"{w}/batches", "--market-file", f"{w}/market.csv") == 0
    assert [r["ticker"] for r in spark.read.parquet(f"{w}/batches/b1_skipped.parquet").collect()] == ["SHORT"]
    batch = spark.read.parquet(f"{w}/batches/b1_alpha_panel.parquet")
    assert batch.count() == 8 * 340 and len(commands.alpha_names(batch)) == 50 and {r[0] for r in batch.select("sector").distinct().collect()} == {"A", "B"}
    assert run("merge-batches", "--batch-dir", f"{w}/batches", "--output", f"{w}/raw.parquet", "--export-csv") == 0
    assert spark.read.option("header", "true").csv(f"{w}/raw.csv").count() == 8 * 340
    assert run("enrich", "--input", f"{w}/raw.parquet", "--output", f"{w}/rich.parquet", "--market-file", f"{w}/market.csv", "--factor-file", f"{w}/factors.csv") == 0
    rich = spark.read.parquet(f"{w}/rich.parquet")
    assert rich.columns == batch.columns and rich.filter("alpha_59 IS NOT NULL").count() > 0 and rich.filter("alpha_35 IS NOT NULL").isEmpty()
    narrow = [*commands.KEYS, *commands.META, *commands.B.OHLCV, "daily_vwap", "alpha_27", "alpha_37", "alpha_54"]
    rich.select(*narrow).write.parquet(f"{w}/narrow.parquet")  # fewer signals: the steps after it are the same
    assert run("cross-section", "--input", f"{w}/narrow.parquet", "--output", f"{w}/cs.parquet", "--least", 5, "--sector-least", 3) == 0
    assert run("labels", "--input", f"{w}/cs.parquet", "--output", f"{w}/model.parquet", "--market-file", f"{w}/market.csv") == 0
    model = spark.read.parquet(f"{w}/model.parquet")
    assert {"fwd_excess_21d", "fwd_vwap_1d", "alpha_27_cs_rank"} <= set(model.columns) and model.count() == 8 * 340
    assert run("validate-signals", "--input", f"{w}/model.parquet", "--output-dir", w, "--least", 5, "--controls", "alpha_37") == 0
    assert {(r["alpha"], r["target"]) for r in spark.read.parquet(f"{w}/controlled_betas.parquet").collect()} >= {("alpha_27", "fwd_cc_5d"), ("alpha_54", "fwd_cc_21d")}
    assert {(r["alpha"], r["target"]) for r in spark.read.parquet(f"{w}/single_signals.parquet").collect()} >= {(a, f"fwd_cc_{h}d") for a in ("alpha_27", "alpha_54") for h in (5, 21)}
    assert run("select-signals", "--input", f"{w}/model.parquet", "--output-dir", w, "--least", 5, "--t", 0) == 0
    assert {r["alpha"] for r in spark.read.parquet(f"{w}/clusters.parquet").collect()} == {"alpha_27", "alpha_37", "alpha_54"}
    assert run("elastic-net", "--input", f"{w}/model.parquet", "--output-dir", w) == 0
    assert run("rank-model", "--input", f"{w}/model.parquet", "--output-dir", w, "--rounds", 2, "--trials", 1, "--least", 5) == 0
    predictions = spark.read.parquet(f"{w}/predictions.parquet")
    assert {r[0] for r in predictions.select("split").distinct().collect()} == {"val", "test"} and predictions.filter("prediction IS NULL").isEmpty()
    assert run("combine", "--single", f"{w}/single_signals.parquet", "--net", f"{w}/elastic_net.parquet", "--importance", f"{w}/importance.parquet", "--output", f"{w}/groups.parquet") == 0
    assert spark.read.parquet(f"{w}/groups.parquet").filter("method_group IS NOT NULL").count() == 3
    evidence = ("--single", f"{w}/single_signals.parquet", "--net", f"{w}/elastic_net.parquet", "--importance", f"{w}/importance.parquet")
    assert run("final-select", *evidence, "--ic-summary", f"{w}/ic_summary.parquet", "--clusters", f"{w}/clusters.parquet", "--output-dir", w) == 0
    final = {r["alpha"]: r for r in spark.read.parquet(f"{w}/final_candidates.parquet").collect()}
    assert final.keys() == {"alpha_27", "alpha_37", "alpha_54"} and all(0 <= r["final_score"] <= 1 and r["final_group"].startswith("final_") for r in final.values())
    kept = [r["value"] for r in spark.read.text(f"{w}/final_features.txt").collect()]
    assert sorted(kept) == sorted(a for a, r in final.items() if r["final_group"] != "final_excluded_for_now")
    assert run("ablation", "--input", f"{w}/model.parquet", "--output-dir", w, "--rounds", 1, "--trials", 1, "--least", 5, "--clusters", f"{w}/clusters.parquet") == 0
    deltas = {r["experiment"]: r for r in spark.read.parquet(f"{w}/ablation.parquet").collect()}
    assert len(deltas) == 8 and deltas["baseline_current"]["test_rank_ic_delta"] in (0.0, None)
    assert run("report", "--work-dir", w, "--output", f"{w}/report.md") == 0
    text = [r["value"] for r in spark.read.text(f"{w}/report.md").collect()]
    assert text[0] == "# Research report" and {"## final candidates", "## ablation", "## single signals"} <= set(text)


def test_conflicting_batches_fail(spark, tmp_path):
    df = spark.sql("SELECT DATE'2020-01-01' AS date, 'A' AS ticker, 1.0D AS alpha_26")
    df.write.parquet(f"{tmp_path}/x_alpha_panel.parquet")
    df.write.parquet(f"{tmp_path}/y_alpha_panel.parquet")  # equal rows are one
    commands.merge_batches(spark, str(tmp_path), f"{tmp_path}/ok.parquet")
    assert spark.read.parquet(f"{tmp_path}/ok.parquet").count() == 1
    df.selectExpr("date", "ticker", "2.0D AS alpha_26").write.parquet(f"{tmp_path}/z_alpha_panel.parquet")
    with pytest.raises(ValueError, match="unique_keys"):
        commands.merge_batches(spark, str(tmp_path), f"{tmp_path}/bad.parquet")
    assert not (tmp_path / "bad.parquet").exists()


def test_minute_folder(spark, tmp_path):
    minutes = tmp_path / "m"
    minutes.mkdir()
    rows = [("01/02/2020", t, p, p, p, p, 10) for t, p in (("09:30", 1.0), ("10:00", 2.0), ("10:00", 2.0), ("17:00", 9.0))]
    cols = ["date", "time", "open", "high", "low", "close", "volume"]
    pd.DataFrame(rows, columns=cols).to_csv(minutes / "A.csv", index=False)
    pd.DataFrame([*rows, ("01/02/2020", "10:00", 3.0, 3.0, 3.0, 3.0, 10)], columns=cols).to_csv(minutes / "B.csv", index=False)
    pd.DataFrame({"ticker": ["A", "B"]}).to_csv(tmp_path / "u.csv", index=False)
    path = commands.process_folder(spark, f"{tmp_path}/u.csv", str(minutes), "m", str(tmp_path), layout="minute", min_rows=1)
    assert [(r["ticker"], r["open"], r["close"], r["volume"], r["daily_vwap"]) for r in spark.read.parquet(path).collect()] == [("A", 1.0, 2.0, 20.0, 1.5)]
    assert [(r["ticker"], r["conflicts"]) for r in spark.read.parquet(f"{tmp_path}/m_skipped.parquet").collect()] == [("B", 1)]
