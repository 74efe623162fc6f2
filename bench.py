"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("momentum_top10", "bars_daily", "validate_ohlcv", "alpha_27", "alpha_50", "alpha_61", "alpha_63", "alpha_66", "alpha_34_sector_median", "alpha_33_59_residual", "cs_b", "labels", "rank_ic_summary", "fama_macbeth", "decile_spread", "ndcg", "pair_rank_corr", "simulate_equal", "perf_metrics")


def main() -> None:
    from pyspark.sql import SparkSession

    from alphaloom.plans.queries import QUERIES

    cpus, d = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bars_daily"](spark, d).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(d).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
