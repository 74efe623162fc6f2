"""The ranker against direct sums and a planted signal; enrichment against pandas and lstsq."""

import datetime as dt
import tracemalloc
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import enrichment, evidence, ranker
from alphaloom.plans import model_queries


def _panel(spark, dates=30, names=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(dates):
        split = "train" if k < 18 else "val" if k < 24 else "test"
        for t in range(names):
            a, b = rng.normal(), rng.normal()
            y = float(np.abs(a) + 0.3 * rng.normal())  # a bend that no line ranks
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(k), t, split, y, a if rng.random() > 0.05 else None, b))
    return spark.createDataFrame(rows, "date date, ticker int, split string, y double, alpha_1 double, alpha_2 double")


@pytest.mark.parametrize("objective", ["pairwise", "ndcg"])
def test_pair_gradients(objective, monkeypatch):
    monkeypatch.setattr(ranker, "STRIP", 3)  # several strips
    rng = np.random.default_rng(0)
    grade, score = rng.integers(0, 4, 10).astype(float), rng.normal(size=10)
    place = {i: 1 / np.log2(k + 2) for k, i in enumerate(np.argsort(-score, kind="stable"))}
    g, h, weights = np.zeros(10), np.zeros(10), 0.0
    for i in range(10):
        for j in range(10):
            if grade[i] > grade[j]:
                w = 1.0 if objective == "pairwise" else abs(grade[i] - grade[j]) * abs(place[i] - place[j])
                rho = 1 / (1 + np.exp(score[i] - score[j]))
                g[i], g[j], weights = g[i] - rho * w, g[j] + rho * w, weights + w
                h[i], h[j] = h[i] + rho * (1 - rho) * w, h[j] + rho * (1 - rho) * w
    got = ranker.pair_gradients(grade, score, objective)
    assert np.allclose(got[0], g * 10 / weights) and np.allclose(got[1], h * 10 / weights)
    flat = ranker.pair_gradients(np.ones(4), np.zeros(4), objective)  # all equal: no pair
    assert not flat[0].any() and not flat[1].any()


@pytest.mark.parametrize("objective", ["pairwise", "ndcg"])
def test_pair_gradients_of_few_scores_do_not_form_the_pairs(objective):
    """A block of a large universe in a first round: as a hundred such rows say, and without anything of rows times rows."""
    rng = np.random.default_rng(5)
    grade, score = rng.integers(0, 32, 20_000), rng.choice([-0.1, 0.0, 0.2, 0.3], 20_000)
    tracemalloc.start()
    g, h = ranker.pair_gradients(grade.astype(float), score, objective)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6, peak
    assert abs(g.sum()) < 1e-6 * np.abs(g).sum() and (h >= 0).all()
    place, weights = 1 / np.log2(np.argsort(np.argsort(-score, kind="stable"), kind="stable") + 2.0), 0.0
    want = np.zeros((2, 100))
    for i in range(20_000):
        w = (grade[i] != grade) * (np.abs(grade[i] - grade) * np.abs(place[i] - place) if objective == "ndcg" else 1.0)
        weights += w.sum() / 2
        if i < 100:
            rho = 1 / (1 + np.exp(np.where(grade[i] > grade, 1, -1) * (score[i] - score)))
            want[:, i] = (np.where(grade[i] > grade, -rho, rho) * w).sum(), (rho * (1 - rho) * w).sum()
    assert np.allclose(g[:100], want[0] * 20_000 / weights) and np.allclose(h[:100], want[1] * 20_000 / weights)


@pytest.mark.parametrize("objective", ["pairwise", "ndcg"])
@pytest.mark.parametrize("spread", [0.1, 3.0, 40.0])
def test_pair_gradients_of_many_scores(objective, spread):
    """Sums through moments against direct ones, over scores in tiles, the last of them not full."""
    rng = np.random.default_rng(7)
    grade, score = rng.integers(0, 32, 1500).astype(float), rng.normal(size=1500).round(3) * spread
    place = 1 / np.log2(np.argsort(np.argsort(-score, kind="stable"), kind="stable") + 2.0)
    better = (grade[:, None] > grade[None, :]).astype(float)
    w = better if objective == "pairwise" else better * np.abs(grade[:, None] - grade[None, :]) * np.abs(place[:, None] - place[None, :])
    rho = 1 / (1 + np.exp(np.clip(score[:, None] - score[None, :], -50, 50)))
    want = ((rho * w).sum(0) - (rho * w).sum(1), (rho * (1 - rho) * w).sum(0) + (rho * (1 - rho) * w).sum(1))
    for got, x in zip(ranker.pair_gradients(grade, score, objective), want):
        assert np.abs(got - x * 1500 / w.sum()).max() < 1e-11 * np.abs(got).max()


@pytest.mark.parametrize("objective", ["pairwise", "ndcg"])
def test_pair_gradients_of_distinct_scores_do_not_form_the_pairs(objective):
    """Twenty thousand rows without two equal scores: a strip of 512 of them against all took more than 80 MB for each of its matrices."""
    rng = np.random.default_rng(6)
    grade, score = rng.integers(0, 4, 20_000).astype(float), rng.normal(size=20_000) * 0.2
    tracemalloc.start()
    ranker.pair_gradients(grade, score, objective)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak


def test_grow_takes_the_best_split():
    p = ranker.Params(max_depth=1, min_child_weight=1.0)
    rng = np.random.default_rng(3)
    x, g, h = rng.integers(0, 6, (200, 2)), rng.normal(size=200), np.ones(200)
    g[x[:, 1] > 3] += 2.0
    hist = np.zeros((1, 2, p.bins + 1, 2))
    for j in range(2):
        for v, w in enumerate((g, h)):
            hist[0, j, :, v] = np.bincount(x[:, j], w, p.bins + 1)
    tree = ranker.Tree.empty(1)
    ranker._grow(tree, hist, np.arange(2), 0, p)
    best = max(
        (sum(g[s].sum() ** 2 / (s.sum() + 1.0) for s in (left, ~left)) - g.sum() ** 2 / 201.0, j, c)
        for j in range(2) for c in range(1, 6) for m in (False, True)
        for left in [((x[:, j] > 0) & (x[:, j] <= c)) | ((x[:, j] == 0) & m)] if 1 <= left.sum() <= 199
    )
    assert np.isclose(tree.gain[0], best[0]) and (tree.feature[0], tree.cut[0]) == best[1:]
    leaf = tree.nodes(x, 1)
    assert all(np.isclose(tree.value[k], -p.eta * g[leaf == k].sum() / ((leaf == k).sum() + 1.0)) for k in (1, 2))


def test_ranker_learns_and_repeats(spark):
    panel = _panel(spark)
    grid = [ranker.Params(rounds=6, eta=0.3, max_depth=2, bins=16, min_child_weight=1.0), ranker.Params("ndcg", rounds=3, eta=0.3, max_depth=2, bins=16, min_child_weight=1.0)]
    model, tried = ranker.train_best(panel, ["alpha_1", "alpha_2"], "y", grid)
    assert len(tried) == 2 and max(ic for _, ic, _ in tried) == ranker.mean_rank_ic(panel, model, "y", "val")
    assert ranker.mean_rank_ic(panel, model, "y", "test") > 0.5
    top = {r["feature"]: r for r in ranker.importance(spark, model).collect()}
    assert top["alpha_1"]["importance_rank"] == 1 and abs(sum(r["normalized_gain"] for r in top.values()) - 1) < 1e-12
    again, _ = ranker.train_best(panel.repartition(7), ["alpha_1", "alpha_2"], "y", grid)
    one, two = ({(r["date"], r["ticker"]): r["prediction"] for r in ranker.predict(panel, m, ["date", "ticker"]).collect()} for m in (model, again))
    assert len(one) == panel.count() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_scores_kept_in_blocks_change_nothing(spark, monkeypatch):
    seen = _panel(spark).filter("split <> 'test'")
    model = ranker.Model(["alpha_1", "alpha_2"], ranker.bin_edges(seen, ["alpha_1", "alpha_2"], 16), ranker.Params(rounds=4, max_depth=1, bins=16))
    data, got = ranker.blocks(seen, model, "y"), []
    for kept in (25, 1):
        monkeypatch.setattr(ranker, "KEPT", kept)
        grown, history = ranker.train(data, model)
        got.append((history, [t.value.tolist() for t in grown.trees]))
    assert got[0] == got[1] and len(got[0][0]) == 5


def test_models_trained_together_are_those_trained_alone(spark):
    """Other features, depths, objectives, and rounds that end at other times."""
    panel, one = _panel(spark, 24, 50), ranker.Params(rounds=10, eta=0.3, max_depth=2, bins=16, min_child_weight=1.0, early_stopping=2)
    jobs = [(["alpha_2", "alpha_1"], [one, replace(one, objective="ndcg", rounds=3)]), (["alpha_1"], [replace(one, max_depth=1)])]
    together = ranker.train_grids(panel, jobs, "y")
    for (features, grid), (model, tried) in zip(jobs, together):
        alone = [ranker.train_best(panel, features, "y", [p]) for p in grid]
        assert [n for *_, n in tried] == [len(m.trees) for m, _ in alone]
        assert np.allclose([ic for _, ic, _ in tried], [t[0][1] for _, t in alone], atol=1e-12)
        same = next(m for m, _ in alone if m.params == model.params)
        assert model.features == same.features and all(np.allclose(a.value, b.value) and (a.feature == b.feature).all() for a, b in zip(model.trees, same.trees))


@pytest.mark.parametrize("query", ["ranker_importance", "ranker_diagnostics"])
def test_queries_train_the_whole_grid(query, monkeypatch):
    class Seen(Exception):
        pass

    def catch(panel, jobs, target, least=50):
        raise Seen([grid for _, grid in jobs])

    monkeypatch.setattr(model_queries.P, "month_panel", lambda *_: None)
    monkeypatch.setattr(model_queries, "_split_panel", lambda *_: None)
    monkeypatch.setattr(ranker, "train_grids", catch)
    with pytest.raises(Seen) as got:
        getattr(model_queries, query)(None, "")
    assert got.value.args[0] == [ranker.trials(o) for o in (("pairwise", "ndcg") if query == "ranker_importance" else ("ndcg",))]
    assert all(len(g) == 6 and {p.rounds for p in g} == {200} for g in got.value.args[0])


def test_ablation_query_runs_the_standard_experiments(monkeypatch):
    """Of eight experiments two pairs have equal features and grids, as all signals are usable: six searches of six trials."""
    jobs = []

    class Panel:
        class sparkSession:
            createDataFrame = staticmethod(lambda rows, schema: rows)

    monkeypatch.setattr(model_queries, "_ablation_months", lambda *_: None)
    monkeypatch.setattr(model_queries, "_split_panel", lambda *_: Panel)
    monkeypatch.setattr(ranker, "train_grids", lambda panel, asked, *_: jobs.extend(asked) or [(k, None) for k in range(len(asked))])
    monkeypatch.setattr(ranker, "mean_rank_ics", lambda panel, models, target, split, least: [float(m) for m in models])
    monkeypatch.setattr(evidence, "ablation_deltas", lambda rows, metrics: rows)
    rows = model_queries.ranker_ablation(None, "")
    assert [r[0] for r in rows] == [e.name for e in ranker.EXPERIMENTS] and {32, 34, 55, 66, 68} < set(model_queries._ABLATED)
    assert [r[3:5] for r in rows] == [(15, 0.0), (15, 0.0), (14, 1.0), (14, 2.0), (13, 3.0), (13, 3.0), (15, 4.0), (13, 5.0)]
    assert len(jobs) == 6 and all(grid == ranker.trials("pairwise", 500, k > 3) and len(grid) == 6 for k, (_, grid) in enumerate(jobs))


def test_ranker_edges(spark):
    panel = _panel(spark, 6, 60).withColumn("alpha_2", F.lit(None).cast("double"))  # no val date, one feature without values
    model, tried = ranker.train_best(panel, ["alpha_1", "alpha_2"], "y", [ranker.Params(rounds=2, max_depth=1)])
    assert tried[0][1] is None and len(model.trees) == 2 and all(t.feature[0] != 1 for t in model.trees)
    thin, _ = ranker.train_best(_panel(spark, 30, 10), ["alpha_1"], "y", [ranker.Params(rounds=1, max_depth=1)])  # no date has 50 rows
    assert {r["prediction"] for r in ranker.predict(panel, thin, ["date"]).collect()} == {0.0}


def test_ablation_ids_and_runs(spark):
    e = {x.name: x for x in (*ranker.EXPERIMENTS, *ranker.OPTIONAL_EXPERIMENTS)}
    have = set(range(26, 76))
    assert ranker.experiment_ids(e["exclude_alpha55_ATR"], {30, 35, 55}, set(), have) == [30]
    assert ranker.experiment_ids(e["force_include_alpha32"], {30}, set(), have) == [30, 32]
    assert ranker.experiment_ids(e["clean_backbone_set"], {27, 55, 60}, {60, 55}, have) == [30, 32, 34, 54, 56, 57, 60, 65, 66]
    assert ranker.experiment_ids(e["only_momentum_block"], set(), set(), {30, 31}) == [30, 31]
    grids = ([ranker.Params(rounds=1, max_depth=1)],) * 2
    got = ranker.run_ablation(_panel(spark), {1: "alpha_1", 2: "alpha_2"}, {1, 2}, {1}, "y", grids, (e["baseline_current"], e["only_momentum_block"])).collect()
    assert [(r["experiment"], r["n_features"], r["val_rank_ic"] is None) for r in got] == [("baseline_current", 2, False), ("only_momentum_block", 0, True)]


def test_enrichment(spark):
    rng = np.random.default_rng(5)
    n, days = 600, [dt.date(2015, 1, 1) + dt.timedelta(k) for k in range(600)]
    f = pd.DataFrame(rng.normal(0, 0.01, (n, 5)), columns=["mkt_rf", "smb", "hml", "mom", "rf"])
    market = f["mkt_rf"] + 0.001
    frames = []
    for t in range(6):
        frames.append(pd.DataFrame({"ticker": f"T{t}", "date": days, "sector": "S" if t < 5 else None, "volume": 10.0, "alpha_26": rng.normal(0, 0.02, n) + market, "alpha_30": rng.normal(size=n)}))
    pdf = pd.concat(frames)
    factors = f.assign(date=days).iloc[:590]
    snaps = spark.createDataFrame([("T0", days[10], 5.0), ("T0", days[300], 0.0)], "ticker string, date date, float_shares double")
    panel = spark.createDataFrame(pdf.assign(market_return=1.0, float_shares=2.0))  # names that clash
    out = enrichment.enrich(panel, spark.createDataFrame(factors), spark.createDataFrame(pd.DataFrame({"date": days, "market_return": market})), snaps).toPandas().sort_values(["ticker", "date"])
    x = np.column_stack([np.ones(n), f[["mkt_rf", "smb", "hml", "mom"]]])
    for t in ("T0", "T5"):
        own, one = out[out.ticker == t].reset_index(drop=True), pdf[pdf.ticker == t].reset_index(drop=True)
        y, res = (one["alpha_26"] - f["rf"]).to_numpy(), np.full(n, np.nan)
        for k in range(251, 590):
            b = np.linalg.lstsq(x[k - 251 : k + 1], y[k - 251 : k + 1], rcond=None)[0]
            res[k] = y[k] - x[k] @ b
        res = pd.Series(res)
        for c, want in (("alpha_33", res.shift(21).rolling(231).sum()), ("alpha_59", 252**0.5 * res.rolling(63).std())):
            want = want.where(pd.Series(range(n)) < 590)  # nothing after the last factor date
            assert want.notna().any() and np.allclose(own[c].astype(float), want, atol=1e-9, equal_nan=True)
        beta = one["alpha_26"].rolling(252).cov(market) / market.rolling(252).var()
        assert np.allclose(own["alpha_60"].astype(float), beta, atol=1e-9, equal_nan=True)
    five = pdf[pdf.ticker != "T5"]
    want = (five["alpha_30"] - five.groupby("date")["alpha_30"].transform("median")).to_numpy()
    assert np.allclose(out[out.ticker != "T5"]["alpha_34"].astype(float), want) and out[out.ticker == "T5"]["alpha_34"].isna().all()
    turnover = out[out.ticker == "T0"]["alpha_66"].astype(float).to_numpy()
    assert np.isnan(turnover[:10]).all() and (turnover[10:300] == 2.0).all() and np.isnan(turnover[300:]).all() and out["alpha_35"].isna().all()
    bare = enrichment.enrich(panel).filter("alpha_33 IS NOT NULL OR alpha_60 IS NOT NULL OR alpha_66 IS NOT NULL")
    assert bare.isEmpty()
