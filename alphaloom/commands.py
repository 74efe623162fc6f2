"""Commands over files: each step reads and writes tables, so any step can run alone. `python -m alphaloom <command> --flag value`.

A command's flags are the arguments of its function. A step that fails its checks writes nothing (process-folder may be forced)
and ends with status 1. Batch panels keep their bars, so that later steps need not build them again.
"""

from __future__ import annotations

import argparse
import inspect
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.nulls import number
from .functions.signals import add_signals, name, signal_columns
from .operators import bars as B
from .operators import cross_section, enrichment, evaluation, horizons, labels, quality_checks, ranker, selection, splits
from .operators.asof import asof_backward
from .operators.panel_joins import validate_minutes
from .sources import tables

KEYS = ["date", "ticker"]
META = ["company_name", "sector", "industry", "sub_industry"]
#: Signals that come with the enrichment alone.
LATER = (33, 34, 35, 59)


def dated(spark: SparkSession, path: str) -> DataFrame:
    """A table with `date` as a date and every other column but names as a number."""
    df = tables.read_table(spark, path)
    plain = lambda c: c in ("ticker", *META)
    day = F.coalesce(F.col("date").try_cast("date"), tables.parse_date(F.col("date").cast("string")))
    return df.select(*(day.alias(c) if c == "date" else F.col(c) if plain(c) else number(F.col(c).cast("string")).alias(c) for c in df.columns))


def alpha_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("alpha_") and c.removeprefix("alpha_").isdigit()]


def _unique(df: DataFrame) -> DataFrame:
    """Rows that are there and have distinct keys."""
    got = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*KEYS).alias("k"))
    return got.select(*quality_checks.check_row("has_rows", F.col("n") > 0, F.col("n"))).unionByName(got.select(*quality_checks.check_row("unique_keys", F.col("n") == F.col("k"), F.col("n") - F.col("k"))))


def _market(spark: SparkSession, path: str, price: str) -> DataFrame:
    return tables.market_returns(dated(spark, path).select("date", F.col(price).alias("level")).filter("date IS NOT NULL"))


def _write(df: DataFrame, report: DataFrame, path: str, export_csv: bool = False, force: bool = False) -> None:
    quality_checks.gated_write(df, report, path, force)
    if export_csv:
        tables.write_table(df.sparkSession.read.parquet(path), path.removesuffix(".parquet") + ".csv")


def process_folder(spark: SparkSession, universe: str, input_dir: str, batch_id: str, output_dir: str, layout: str = "daily", file_format: str = "csv", market_file: str = "", market_price: str = "close", float_file: str = "", min_rows: int = 300, force: bool = False) -> str:
    """Signals of all files of a folder, a ticker a file name, as one scan; files of a folder share one header.

    layout is daily or minute (date and time, or timestamp). Tickers that break a rule, have fewer than min_rows days or two
    versions of a minute are left out; `<batch>_skipped.parquet` says why. Returns the path of the panel.
    """
    known = tables.universe(tables.read_table(spark, universe))
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"[!._]*.{file_format}")
    raw = reader.parquet(input_dir) if file_format == "parquet" else reader.option("header", "true").option("enforceSchema", "false").csv(input_dir)
    rows = tables.normalise_headers(tables.ticker_from_file(raw, known))
    if layout == "minute":
        ts = F.col("timestamp").cast("string") if "timestamp" in rows.columns else F.concat_ws(" ", F.col("date").cast("string"), F.col("time").cast("string"))
        minutes = rows.select("ticker", tables.parse_timestamp(ts).alias("ts"), *(number(F.col(c).cast("string")).alias(c) for c in B.OHLCV)).dropDuplicates()
        twice = minutes.groupBy("ticker", "ts").count().filter("count > 1").groupBy("ticker").agg(F.count(F.lit(1)).alias("conflicts"))
        daily = B.minutes_to_daily(minutes.filter("ts IS NOT NULL"))
        faulty = validate_minutes(minutes).filter("NOT passed").select("ticker", F.to_json(F.struct("no_time", "inf", "missing", "high_logic", "low_logic", "price", "volume")).alias("minute_faults"))
    else:
        day = F.coalesce(F.col("date").try_cast("date"), tables.parse_date(F.col("date").cast("string")))
        daily = B.standardise_daily(rows.withColumn("date", day))
        twice = daily.select("ticker").limit(0).withColumn("conflicts", F.lit(0).cast("long"))
        faulty = daily.select("ticker").limit(0).withColumn("minute_faults", F.lit(None).cast("string"))
    daily = ranker.cut(daily)  # read by the checks and by the signals
    verdict = B.validate_bars(daily, min_rows).join(twice, "ticker", "left").fillna(0, ["conflicts"])
    verdict = verdict.join(faulty, "ticker", "left").withColumn("passed", F.col("passed") & (F.col("conflicts") == 0) & F.col("minute_faults").isNull())
    verdict.filter("NOT passed").write.mode("overwrite").parquet(f"{output_dir}/{batch_id}_skipped.parquet")
    good = daily.join(verdict.filter("passed").select("ticker"), "ticker", "left_semi")
    if market_file:  # one row a date: bounded by the calendar
        good = good.join(F.broadcast(_market(spark, market_file, market_price).select("date", "market_return")), "date", "left")
    if float_file:
        good = asof_backward(good, dated(spark, float_file), "float_shares", stale_after_last=True)
    ids = sorted({*signal_columns("A"), 51})
    out = add_signals(good, ids, "A").drop("market_return", "float_shares").withColumns({name(k): F.lit(None).cast("double") for k in LATER})
    out = out.join(known.select("ticker", *META), "ticker", "left")
    path = f"{output_dir}/{batch_id}_alpha_panel.parquet"
    _write(out.select(*KEYS, *META, *B.OHLCV, "daily_vwap", *(name(k) for k in range(26, 76))), _unique(good), path, force=force)
    return path


def merge_batches(spark: SparkSession, batch_dir: str, output: str, export_csv: bool = False) -> str:
    """All batch panels as one: equal rows become one, unequal rows of a key fail."""
    merged = spark.read.parquet(f"{batch_dir}/*_alpha_panel.parquet").dropDuplicates()
    _write(merged, _unique(merged), output, export_csv)
    return output


def enrich(spark: SparkSession, input: str, output: str, market_file: str = "", market_price: str = "close", factor_file: str = "", float_file: str = "", export_csv: bool = False) -> str:
    """Signals 33, 34, 59, 60 and 66 from factors, sectors, the market and shares afloat; 35 is NULL. Faulty factors fail."""
    panel = spark.read.parquet(input)
    fresh = panel.drop(*(name(k) for k in (33, 34, 35, 59, 60, 66)))
    factors = dated(spark, factor_file) if factor_file else None
    report = _unique(panel)
    if factors is not None:
        names = [*enrichment.FACTORS, "rf"]
        bad = tables.factor_checks(factors, names)
        total = sum((F.col(c) for c in bad.columns), F.lit(0))
        report = report.unionByName(bad.select(*quality_checks.check_row("factors", total == 0, F.to_json(F.struct(*bad.columns)))))
    market = _market(spark, market_file, market_price) if market_file else None
    out = enrichment.enrich(fresh, factors, market, dated(spark, float_file) if float_file else None)
    _write(out.select(*panel.columns), report, output, export_csv)
    return output


def cross_section_panel(spark: SparkSession, input: str, output: str, variant: str = "A", least: int = 50, sector_least: int = 5, export_csv: bool = False) -> str:
    """Transforms within a date of every signal that has values."""
    panel = spark.read.parquet(input)
    seen = panel.agg(*(F.count(a).alias(a) for a in alpha_names(panel))).first()
    alphas = [a for a in alpha_names(panel) if seen[a]]
    out = cross_section.transform(panel, alphas, variant, least=least, sector_least=sector_least)
    _write(out, _unique(panel), output, export_csv)
    return output


def label_panel(spark: SparkSession, input: str, output: str, market_file: str = "", market_price: str = "close", export_csv: bool = False) -> str:
    """Forward returns of 1, 5 and 21 rows, and those over the market's where its file is given."""
    panel = spark.read.parquet(input)
    out = labels.add_labels(panel)
    for h in labels.HORIZONS:
        out = labels.add_excess(out, _market(spark, market_file, market_price), h) if market_file else out
    _write(out, _unique(panel), output, export_csv)
    return output


def _features(panel: DataFrame, suffix: str) -> list[str]:
    return [f"{a}{suffix}" for a in alpha_names(panel) if f"{a}{suffix}" in panel.columns]


def validate_signals(spark: SparkSession, input: str, output_dir: str, short: str = "fwd_cc_5d", long: str = "fwd_cc_21d", suffix: str = "", least: int = 20, least_dates: int = 100, controls: str = "") -> str:
    """Betas, rank ICs and spreads by signal for two horizons, their stability and the leading stable signals.

    `controls` names columns, by commas; then `controlled_betas.parquet` has the betas beside them.
    """
    panel = spark.read.parquet(input)
    names = _features(panel, suffix)
    two = tuple(f"{name(k)}{suffix}" for k in (37, 38))
    both = [horizons.combined_summary(panel, names, t, lags, two if not suffix else (), least, least_dates) for t, lags in ((short, 5), (long, 21))]
    table = f"{output_dir}/single_signals.parquet"
    horizons.add_stability(*both).write.mode("overwrite").parquet(table)
    if controls:
        from .operators.evidence import daily_ols_controls

        beside = [c.strip() for c in controls.split(",") if c.strip()]
        made = [evaluation.newey_west(daily_ols_controls(panel, names, t, beside, least), "beta", lags).withColumn("target", F.lit(t)) for t, lags in ((short, 5), (long, 21))]
        made[0].unionByName(made[1]).write.mode("overwrite").parquet(f"{output_dir}/controlled_betas.parquet")
    horizons.top_stable(spark.read.parquet(table), least_dates).write.mode("overwrite").parquet(f"{output_dir}/top_signals.parquet")
    return table


def select_signals(spark: SparkSession, input: str, output_dir: str, target: str = "fwd_cc_5d", suffix: str = "", least: int = 50, t: float = 2.0, corr: float = 0.8) -> str:
    """IC summary on the train dates, the significant signals, and greedy clusters of correlated ones with their heads."""
    panel = spark.read.parquet(input)
    train = panel.join(F.broadcast(splits.date_split(panel).filter("split = 'train'")), "date", "left_semi")  # one row a date
    names = _features(panel, suffix)
    summary = f"{output_dir}/ic_summary.parquet"
    evaluation.ic_summary(evaluation.daily_rank_ic(evaluation.unpivot(train, names, target), least)).write.mode("overwrite").parquet(summary)
    strong = selection.significant(spark.read.parquet(summary), least=t)
    left = [r["alpha"] for r in strong.select("alpha").collect()]  # one row a signal
    path = f"{output_dir}/clusters.parquet"
    pairs = selection.pair_correlation(train, left or names[:1], KEYS, rank=True)
    selection.redundancy_clusters(strong, pairs, corr).write.mode("overwrite").parquet(path)
    return path


def elastic_net(spark: SparkSession, input: str, output_dir: str, target: str = "fwd_cc_5d", suffix: str = "_cs_zscore", folds: int = 5) -> str:
    """Coefficients of the elastic net of the best penalty over expanding folds; missing features are 0, as z-scores' mean."""
    panel = spark.read.parquet(input).filter(F.col(target).isNotNull())
    names = _features(panel, suffix)
    rows = panel.fillna(0.0, names).join(F.broadcast(splits.expanding_folds(panel, folds)), "date")  # one row a date
    penalty, ratio, beta = selection.elastic_net_cv(selection.gram(rows, names, target, "fold"), np.logspace(-6, -2, 20), (0.2, 0.5, 0.8, 0.95, 1.0))
    got = [(n, float(b), abs(float(b)) > 1e-12, float(penalty), float(ratio)) for n, b in zip(names, beta)]
    path = f"{output_dir}/elastic_net.parquet"
    spark.createDataFrame(got, "feature string, coef double, selected boolean, penalty double, l1_ratio double").write.mode("overwrite").parquet(path)
    return path


def rank_model(spark: SparkSession, input: str, output_dir: str, target: str = "fwd_cc_5d", suffix: str = "_cs_rank", objective: str = "pairwise", rounds: int = 200, trials: int = 6, least: int = 50) -> str:
    """The best of the covering trials: trials, importance and predictions on the val and test dates."""
    panel = spark.read.parquet(input)
    names = _features(panel, suffix)
    panel = panel.select(*KEYS, target, *names).join(F.broadcast(splits.date_split(panel)), "date")  # one row a date
    model, tried = ranker.train_best(panel, names, target, ranker.trials(objective, rounds)[:trials], least)
    rows = [(k, p.max_depth, p.eta, p.reg_lambda, p.reg_alpha, float(p.min_child_weight), ic, n) for k, (p, ic, n) in enumerate(tried, 1)]
    spark.createDataFrame(rows, "trial int, max_depth int, eta double, reg_lambda double, reg_alpha double, min_child_weight double, val_rank_ic double, trees int").write.mode("overwrite").parquet(f"{output_dir}/trials.parquet")
    ranker.importance(spark, model).write.mode("overwrite").parquet(f"{output_dir}/importance.parquet")
    path = f"{output_dir}/predictions.parquet"
    ranker.predict(panel.filter("split <> 'train'"), model, [*KEYS, "split", target]).write.mode("overwrite").parquet(path)
    return path


def ablation(spark: SparkSession, input: str, output_dir: str, target: str = "fwd_cc_5d", suffix: str = "_cs_rank", objective: str = "pairwise", rounds: int = 200, trials: int = 6, least: int = 50, clusters: str = "", optional: bool = False) -> str:
    """The standard experiments with and without signals, their rank ICs and the differences from the baseline.

    `clusters` is what select-signals wrote; its heads are the selected signals, all usable ones without it.
    """
    from .operators.evidence import ablation_deltas

    panel = spark.read.parquet(input)
    names = _features(panel, suffix)
    number_of = lambda f: int(f.removeprefix("alpha_").split("_")[0])
    columns = {number_of(f): f for f in names}
    usable = {number_of(r["feature"]) for r in splits.usable_features(panel, names, target, dates=min(50, least)).filter("usable").collect()}  # one row a signal
    heads = {number_of(r["alpha"]) for r in spark.read.parquet(clusters).filter("is_head").collect()} if clusters else usable
    rows = panel.select(*KEYS, target, *names).join(F.broadcast(splits.date_split(panel)), "date")  # one row a date
    grids = tuple(ranker.trials(objective, rounds, high)[:trials] for high in (False, True))
    got = ranker.run_ablation(ranker.cut(rows), columns, usable, heads, target, grids, ranker.EXPERIMENTS + (ranker.OPTIONAL_EXPERIMENTS if optional else ()), least)
    path = f"{output_dir}/ablation.parquet"
    ablation_deltas(got, ["val_rank_ic", "test_rank_ic"]).write.mode("overwrite").parquet(path)
    return path


def _by_method(spark: SparkSession, single: str, net: str, importance: str, short: str, long: str) -> DataFrame:
    """One row a signal: the best linear evidence, what the elastic net chose, and the ranker's gains and ranks."""
    from .operators.evidence import best_linear

    base = lambda c: F.regexp_extract(c, r"^(alpha_\d+)", 1)  # noqa: E731  # features are named after their signal
    results = spark.read.parquet(single).withColumns({"alpha": base("alpha"), "variant": F.lit("value"), "mean_ic": F.col("ic_mean")})
    linear = best_linear(results, short, long)
    chosen = spark.read.parquet(net).groupBy(base("feature").alias("alpha")).agg(F.bool_or("selected").alias("regularized"), F.count_if("selected").cast("int").alias("times"))
    ranked = spark.read.parquet(importance).groupBy(base("feature").alias("alpha")).agg(F.avg("importance_rank").alias("average_rank"), F.min("importance_rank").alias("best_rank"), F.max("gain").alias("best_gain"))
    return linear.join(chosen, "alpha", "full_outer").join(ranked, "alpha", "full_outer")


def combine(spark: SparkSession, single: str, net: str, importance: str, output: str, short: str = "fwd_cc_5d", long: str = "fwd_cc_21d") -> str:
    """Method groups of signals from validate-signals, elastic-net and rank-model."""
    from .operators.evidence import method_groups

    method_groups(_by_method(spark, single, net, importance, short, long).drop("times")).write.mode("overwrite").parquet(output)
    return output


def final_select(spark: SparkSession, single: str, net: str, importance: str, ic_summary: str, clusters: str, output_dir: str, short: str = "fwd_cc_5d", long: str = "fwd_cc_21d") -> str:
    """Final scores and groups of candidates from every step's evidence, a list of the kept signals and a report."""
    from .operators import evidence as E
    from .operators.panel_joins import GROUP_ORDER, group_place

    base = lambda c: F.regexp_extract(c, r"^(alpha_\d+)", 1)
    ic = spark.read.parquet(ic_summary).groupBy(base("alpha").alias("alpha")).agg(F.max_by("mean_ic", F.abs("t_stat")).alias("ic"), F.max_by("icir", F.abs("t_stat")).alias("icir"), F.max_by("t_stat", F.abs("t_stat")).alias("ic_t_stat"))
    heads = spark.read.parquet(clusters).groupBy(base("alpha").alias("alpha")).agg(F.bool_or("is_head").alias("selected_by_ic"))
    table = _by_method(spark, single, net, importance, short, long).join(ic, "alpha", "full_outer").join(heads, "alpha", "left")
    top = table.agg(F.max("best_gain").alias("_top"))  # one row
    survived = F.col("selected_by_ic").isNotNull()
    status = F.when(F.col("selected_by_ic"), "cluster_head_kept").when(survived, "dropped_redundant").otherwise("failed_significance_filter")
    made = table.crossJoin(F.broadcast(top)).select(
        "alpha", F.regexp_extract("alpha", r"(\d+)", 1).cast("int").alias("alpha_id"), F.col("linear_score").alias("linear_support"), "horizon_consistency",
        E.lasso_support(F.col("regularized"), F.col("times"), F.lit(0)).alias("lasso_support"), E.ranker_support(F.col("best_gain"), F.col("_top"), F.col("average_rank"), F.col("best_rank")).alias("ranker_support"),
        E.ic_support(F.coalesce("selected_by_ic", F.lit(False)), survived, F.col("ic_t_stat")).alias("ic_support"), F.col("ic").alias("mean_ic"), "icir", F.col("ic_t_stat").alias("t_stat"),
        F.coalesce("selected_by_ic", F.lit(False)).alias("selected_by_ic"), ((F.col("best_rank") <= 10) | (F.col("average_rank") <= 20)).alias("selected_by_ranker"), (F.col("linear_score") >= 0.55).alias("selected_by_linear"), status.alias("redundancy_status"),
    )
    path = f"{output_dir}/final_candidates.parquet"
    E.final_candidates(made).write.mode("overwrite").parquet(path)
    final = spark.read.parquet(path).orderBy(group_place(F.col("final_group")), F.desc("final_score"), "alpha")
    rows = final.collect()  # one row a signal
    tables.write_lines(spark, [r["alpha"] for r in rows if r["final_group"] != GROUP_ORDER[-1]], f"{output_dir}/final_features.txt")
    lines = ["# Final candidates", "", *(f"- {g}: {sum(r['final_group'] == g for r in rows)}" for g in GROUP_ORDER), ""]
    for g in GROUP_ORDER:
        lines += tables.markdown(g, final.filter(F.col("final_group") == g).select("alpha", "final_score", "linear_support", "lasso_support", "ranker_support", "ic_support", "redundancy_status"), 100)
    tables.write_lines(spark, lines, f"{output_dir}/final_report.md")
    return path


#: Tables that the steps write, in the order that a report shows them.
REPORTED = ("top_signals", "single_signals", "controlled_betas", "ic_summary", "clusters", "elastic_net", "trials", "importance", "ablation", "final_candidates")


def report(spark: SparkSession, work_dir: str, output: str, rows: int = 20) -> str:
    """One Markdown text of the tables that the steps have left in a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(work_dir)
    held = {f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)}
    lines = ["# Research report", ""]
    for t in REPORTED:
        if f"{t}.parquet" in held:
            lines += tables.markdown(t.replace("_", " "), spark.read.parquet(f"{work_dir}/{t}.parquet"), rows)
    tables.write_lines(spark, lines, output)
    return output


COMMANDS: dict[str, Callable[..., str]] = {
    "process-folder": process_folder, "merge-batches": merge_batches, "enrich": enrich, "cross-section": cross_section_panel, "labels": label_panel,
    "validate-signals": validate_signals, "select-signals": select_signals, "elastic-net": elastic_net, "rank-model": rank_model, "combine": combine,
    "ablation": ablation, "final-select": final_select, "report": report,
}


def run_pipeline(spark: SparkSession, input_dir: str, universe: str, work_dir: str, market_file: str = "", factor_file: str = "", float_file: str = "", with_net: bool = False, with_ranker: bool = False, **process) -> dict[str, str]:
    """All steps from price files to selected signals; the paths that they wrote."""
    out = {"batch": process_folder(spark, universe, input_dir, "all", work_dir, market_file=market_file, float_file=float_file, **process)}
    out["enriched"] = enrich(spark, out["batch"], f"{work_dir}/enriched.parquet", market_file, factor_file=factor_file, float_file=float_file)
    out["ranked"] = cross_section_panel(spark, out["enriched"], f"{work_dir}/ranked.parquet")
    out["model"] = label_panel(spark, out["ranked"], f"{work_dir}/model.parquet", market_file)
    out["single"] = validate_signals(spark, out["model"], work_dir)
    out["clusters"] = select_signals(spark, out["model"], work_dir)
    if with_net:
        out["net"] = elastic_net(spark, out["model"], work_dir)
    if with_ranker:
        out["predictions"] = rank_model(spark, out["model"], work_dir)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="alphaloom")
    sub = p.add_subparsers(dest="command", required=True)
    for key, f in COMMANDS.items():
        one = sub.add_parser(key, help=(f.__doc__ or "").strip().splitlines()[0])
        for arg in list(inspect.signature(f, eval_str=True).parameters.values())[1:]:
            flag, needed = "--" + arg.name.replace("_", "-"), arg.default is inspect.Parameter.empty
            if arg.annotation is bool:
                one.add_argument(flag, action=argparse.BooleanOptionalAction, default=arg.default)
            else:
                one.add_argument(flag, type=arg.annotation, required=needed, default=None if needed else arg.default)
    return p


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    spark = SparkSession.builder.appName("alphaloom").getOrCreate()
    try:
        print(COMMANDS[args.pop("command")](spark, **args))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0
