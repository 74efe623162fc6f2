"""P-values, regressions with controls, classes, groups and scores against direct computation."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alphaloom.operators import evaluation, evidence


def _series_p(t: float, v: int) -> float:
    """Student's t for whole degrees of freedom, as a finite trigonometric sum."""
    a = math.atan(abs(t) / math.sqrt(v))
    if v % 2:
        term, total = 1.0, 0.0
        for k in range((v - 1) // 2):
            total, term = total + term, term * math.cos(a) ** 2 * (2 * k + 2) / (2 * k + 3)
        inside = 2 / math.pi * (a + math.sin(a) * math.cos(a) * total)
    else:
        term, total = 1.0, 0.0
        for k in range(v // 2):
            total, term = total + term, term * math.cos(a) ** 2 * (2 * k + 1) / (2 * k + 2)
        inside = math.sin(a) * total
    return 1 - inside


def test_p_values():
    t = np.array([0.0, 0.3, -1.0, 2.0, -2.5, 4.0, 0.01, 12.7])
    for v in (1, 2, 3, 10, 61, 500, 2000):
        got = evidence.two_sided_p(t, np.full(len(t), v))
        assert np.allclose(got, [_series_p(x, v) for x in t], atol=1e-10), v
    assert evidence.two_sided_p([40.0], [50.0])[0] > 0  # the tail is not lost to rounding
    assert np.isnan(evidence.two_sided_p([np.nan, 1.0], [5, 0])).all()


def test_p_value_of_nulls(spark):
    df = spark.createDataFrame([(2.0, 10), (None, 10), (2.0, 0)], "t double, df int")
    got = [r["p"] for r in df.select(evidence.p_value(F.col("t"), F.col("df")).alias("p")).collect()]
    assert got[0] == pytest.approx(_series_p(2.0, 10)) and got[1:] == [None, None]


def test_controls_equal_lstsq(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(3):
        for i in range(40):
            a, b, c = rng.standard_normal(3).tolist()
            rows.append((dt.date(2020, 1, k + 1), str(i), a, b + 0.5 * a, c, 1.0, float(0.3 * a - b + rng.standard_normal())))
    rows[3] = (*rows[3][:4], None, *rows[3][5:])
    pdf = pd.DataFrame(rows, columns=["date", "ticker", "a1", "a2", "a3", "one", "y"])
    panel = spark.createDataFrame(rows, "date date, ticker string, a1 double, a2 double, a3 double, one double, y double")
    got = {(r["alpha"], r["date"]): r for r in evidence.daily_ols_controls(panel, ["a1", "a2"], "y", ["a2", "a3", "one"]).collect()}
    assert len(got) == 6
    for (alpha, day), r in got.items():
        g = pdf[pdf.date == day][["y", alpha, *(c for c in ("a2", "a3", "one") if c != alpha)]].dropna()
        x = np.column_stack([np.ones(len(g)), g.iloc[:, 1:]])
        beta = np.linalg.lstsq(x, g.y, rcond=None)[0]
        e = g.y - x @ beta
        assert r["n"] == len(g) and r["beta"] == pytest.approx(beta[1], abs=1e-9)
        assert r["r2"] == pytest.approx(1 - e @ e / ((g.y - g.y.mean()) ** 2).sum(), abs=1e-9)
    alone = evidence.daily_ols_controls(panel, ["a1"], "y", []).orderBy("date").collect()
    pairs = evaluation.unpivot(panel, ["a1"], "y")
    assert [r["beta"] for r in alone] == pytest.approx([r["beta"] for r in evaluation.daily_ols(pairs, 20).orderBy("date").collect()])
    twin = evidence.daily_ols_controls(panel.withColumn("copy", F.col("a1")), ["a1"], "y", ["copy"]).first()
    assert twin["beta"] is None  # its control explains the signal wholly
    assert evidence.daily_ols_controls(panel.limit(0), ["a1"], "y", ["a2"]).count() == 0


def test_beta_summary(spark):
    rng = np.random.default_rng(2)
    rows = [("a", dt.date(2020, 1, k + 1), 30, 0.0, float(b), 0.1, float(b / 0.1), 0.1, 0.1, 1.0) for k, b in enumerate(0.2 + 0.1 * rng.standard_normal(10))]
    rows.append(("b", dt.date(2020, 1, 1), 30, 0.0, -1.0, 0.1, -10.0, 0.1, 0.1, 1.0))
    daily = spark.createDataFrame(rows, "alpha string, date date, n long, intercept double, beta double, se double, t double, r2 double, adj_r2 double, residual_se double")
    split = spark.createDataFrame([(dt.date(2020, 1, k + 1), "train" if k < 6 else "val" if k < 8 else "test") for k in range(10)], "date date, split string")
    got = {r["alpha"]: r for r in evidence.beta_summary(evidence.with_p(daily), split).collect()}
    b = np.array([r[4] for r in rows[:10]])
    t = b.mean() / (b.std(ddof=1) / math.sqrt(10))
    assert got["a"]["beta_t"] == pytest.approx(t) and got["a"]["beta_p"] == pytest.approx(_series_p(t, 9), abs=1e-12)
    assert got["a"]["val_beta_mean"] == pytest.approx(b[6:8].mean()) and got["a"]["same_direction_all"] == bool((b[:6].mean() > 0) == (b[6:8].mean() > 0) == (b[8:].mean() > 0))
    assert got["b"]["beta_t"] is None and got["b"]["beta_p"] is None and not got["b"]["same_direction_all"] and got["b"]["n_days"] == 1


CLASS = "alpha string, missing_ratio double, ic_n_days long, mean_ic double, ic_t double, ic_p double, n_days long, beta_mean double, beta_t double, beta_p double, val_beta_mean double, test_beta_mean double, same_direction_all boolean, avg_r2 double"


def test_classes_redundancy_and_recommendation(spark):
    def row(name, mean_ic, ic_t, ic_p, beta, beta_t, beta_p, val, test, same, missing=0.1):
        return (name, missing, 9, mean_ic, ic_t, ic_p, 9, beta, beta_t, beta_p, val, test, same, 0.1)

    rows = [
        row("core", 0.1, 3.0, 0.01, 0.1, 3.0, 0.01, 0.1, 0.1, True), row("core_rev", -0.1, -3.0, 0.01, -0.1, -3.0, 0.01, -0.1, -0.1, True),
        row("conflict", 0.1, 3.0, 0.01, -0.1, -1.0, 0.4, 0.1, 0.1, False), row("weak", 0.1, 1.0, 0.4, 0.1, 1.0, 0.4, 0.1, 0.1, True),
        row("unstable", 0.1, 1.0, 0.4, 0.1, 2.5, 0.02, -0.1, 0.1, False), row("potential", 0.1, 2.5, 0.02, 0.1, 1.0, 0.4, 0.1, None, False),
        row("turned", 0.1, 2.5, 0.02, 0.1, 1.0, 0.4, -0.1, 0.1, False), row("gone", 0.1, 3.0, 0.01, 0.1, 3.0, 0.01, 0.1, 0.1, True, 0.9), row("no_p", 0.1, 3.0, 0.01, 0.1, 3.0, None, 0.1, 0.1, True),
    ]
    classed = evidence.evidence_class(spark.createDataFrame(rows, CLASS))
    pairs = spark.createDataFrame([("core", "potential", -0.9), ("core_rev", "weak", 0.99), ("core", "core_rev", 0.2)], "a string, b string, corr double")
    done = evidence.redundancy(classed, pairs).withColumn("rec", evidence.recommendation(F.col("alpha_class"), F.col("redundancy_decision")))
    got = {r["alpha"]: (r["alpha_class"], r["final_direction"], r["redundancy_decision"], r["rec"]) for r in done.collect()}
    assert got == {
        "core": ("Core Positive", "Positive", "keep", "Strong Keep"), "core_rev": ("Core Reverse", "Reverse", "keep", "Strong Keep"),
        "conflict": ("Needs Review", "Needs Review", "not_candidate", "Review"), "weak": ("Weak", "Weak", "not_candidate", "Drop"),
        "unstable": ("Unstable", "Positive", "not_candidate", "Review"), "potential": ("Potential Positive", "Positive", "drop_redundant", "Drop"),
        "turned": ("Needs Review", "Positive", "not_candidate", "Review"), "gone": ("Missing / Invalid", "Missing / Invalid", "not_candidate", "Drop"),
        "no_p": ("Missing / Invalid", "Missing / Invalid", "not_candidate", "Drop"),
    }
    assert evidence.redundancy(classed.limit(0), pairs).count() == 0


def test_method_groups_and_final_candidates(spark):
    rows = [("a", 0.6, True, 1.0, 1.0, 9.0, 0.0), ("b", 0.1, False, 9.0, 9.0, 1.0, 0.0), ("c", 0.6, False, 40.0, 40.0, 0.1, 0.0), ("d", 0.6, None, 40.0, 3.0, 0.1, 0.0), ("e", 0.1, False, 40.0, 40.0, 0.1, 0.5), ("f", None, None, None, None, None, None)]
    got = evidence.method_groups(spark.createDataFrame(rows, "alpha string, linear_score double, regularized boolean, average_rank double, best_rank double, best_gain double, horizon_consistency double")).collect()
    assert {r["alpha"]: r["method_group"] for r in got} == {"a": "core_alpha", "b": "nonlinear_alpha", "c": "linear_only_alpha", "d": "redundant_alpha", "e": "watchlist_alpha", "f": "rejected_alpha"}
    cols = "alpha_id int, linear_support double, lasso_support double, ranker_support double, ic_support double, selected_by_ic boolean, selected_by_ranker boolean, selected_by_linear boolean, redundancy_status string"
    rows = [(65, 1.0, 1.0, 1.0, 1.0, True, True, True, ""), (55, None, None, None, None, None, None, None, None), (68, 0.0, 0.0, 0.0, 0.0, False, False, False, ""), (57, 0.0, 0.0, 0.4, 0.0, False, False, False, ""), (31, 0.0, 0.0, 0.0, 0.0, False, False, False, "dropped_redundant"), (70, 0.0, 0.0, 0.0, 0.1, False, False, False, "")]
    got = {r["alpha_id"]: (round(r["final_score"], 9), r["final_group"]) for r in evidence.final_candidates(spark.createDataFrame(rows, cols)).collect()}
    assert got == {65: (0.975, "final_core_candidates"), 55: (0.08, "final_core_candidates"), 68: (0.055, "final_interaction_candidates"), 57: (0.1, "final_interaction_candidates"), 31: (0.0, "final_watchlist_candidates"), 70: (0.025, "final_excluded_for_now")}


def test_supports_best_row_and_deltas(spark):
    one = spark.range(1).select(
        evidence.lasso_support(F.lit(True), F.lit(1), F.lit(1)).alias("lasso"), evidence.ranker_support(F.lit(5.0), F.lit(10.0), F.lit(25.0), F.lit(60.0)).alias("ranker"),
        evidence.ic_support(F.lit(False), F.lit(False), F.lit(-1.0)).alias("ic"),
    ).first()
    assert tuple(one) == pytest.approx((0.875, 0.375, 0.2))
    rows = [("a", "5d", "raw", 3.0, 0.0, 0.0, 0.1, 1.0), ("a", "21d", "raw", 0.0, 0.0, 0.0, -0.1, 1.0), ("a", "5d", "z", 3.0, 3.0, None, 0.2, 0.5), ("a", "21d", "z", None, None, None, 0.1, 0.5), ("b", "5d", "z", 1.0, 1.0, 1.0, 0.0, 0.5)]
    res = spark.createDataFrame(rows, "alpha string, target string, variant string, beta_t double, ic_t double, spread_t double, mean_ic double, coverage double")
    got = {r["alpha"]: (r["target"], r["variant"], round(r["linear_score"], 9), r["horizon_consistency"]) for r in evidence.best_linear(res, "5d", "21d").collect()}
    assert got == {"a": ("5d", "z", 0.75, 0.5), "b": ("5d", "z", round(1 / 3, 9), 0.0)}
    runs = spark.createDataFrame([("baseline_current", "z", "ndcg", 0.1), ("no_55", "z", "ndcg", 0.07), ("no_55", "raw", "ndcg", 0.2)], "experiment string, variant string, objective string, ic double")
    got = {(r["experiment"], r["variant"]): r["ic_delta"] for r in evidence.ablation_deltas(runs, ["ic"]).collect()}
    assert got["no_55", "z"] == pytest.approx(-0.03) and got["no_55", "raw"] is None
