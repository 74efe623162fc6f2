"""Checks on panels: every check is a row (check, status, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPORT = "check string, status string, detail string"


def check_row(name: str, ok: Column, detail: Column, severity: str = "FAIL") -> list[Column]:
    return [F.lit(name).alias("check"), F.when(ok, "PASS").otherwise(severity).alias("status"), detail.cast("string").alias("detail")]


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing_rate, all_missing, mostly_missing.

    The flags go through an array function, as one generated method of many columns would be too long to be compiled.
    """
    flags = F.transform(F.array(*(F.col(c).isNull() for c in columns)), lambda x: x.cast("double"))
    rates = df.select(flags.alias("_missing")).agg(*(F.avg(F.col("_missing")[k]).alias(c) for k, c in enumerate(columns)))
    out = rates.unpivot([], columns, "column", "missing_rate")
    return out.withColumn("all_missing", F.col("missing_rate") >= 1).withColumn("mostly_missing", F.col("missing_rate") > 0.5)


def signal_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = df.select("date", *columns).unpivot(["date"], columns, "alpha", "value")
    seen = F.col("value").isNotNull()
    return rows.groupBy("alpha").agg(
        F.count_if(~seen).alias("n_missing"), F.min(F.when(seen, F.col("date"))).alias("first_date"), F.max(F.when(seen, F.col("date"))).alias("last_date"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"),
    )


def coverage_worst(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """Values are counted, and divided once: sums of shares would differ in their last bits by the order of rows, and part tickers of equal coverage."""
    seen = F.size(F.filter(F.array(*(F.col(c).isNotNull() for c in columns)), lambda x: x))
    coverage = (F.sum("_seen") / (F.count(F.lit(1)) * len(columns))).alias("coverage")
    return df.select("ticker", seen.alias("_seen")).groupBy("ticker").agg(coverage).orderBy("coverage", "ticker").limit(n)


def thin_groups(df: DataFrame, columns: list[str], least: int = 50, sector_least: int = 5) -> DataFrame:
    """alpha, thin_dates, thin_sectors: groups with some values, but too few."""
    rows = df.select("date", "sector", *columns).unpivot(["date", "sector"], columns, "alpha", "value")
    sectors = rows.groupBy("alpha", "date", "sector").agg(F.count("value").alias("n"))
    dates = sectors.groupBy("alpha", "date").agg(F.sum("n").alias("total"), F.count_if(F.col("n") < sector_least).alias("thin"))
    return dates.groupBy("alpha").agg(F.count_if(F.col("total") < least).alias("thin_dates"), F.sum("thin").alias("thin_sectors"))


def date_gaps(df: DataFrame, most: int = 5) -> DataFrame:
    w = Window.orderBy("date")
    days = df.select("date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    return days.filter(F.col("gap") > most)


def panel_report(df: DataFrame, keys: list[str], ranks: list[str], zscores: list[str], required: list[str]) -> DataFrame:
    """Structure, key and range checks in one scan."""
    got = df.agg(
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("dup"),
        *(F.count_if(~F.col(c).between(0, 1)).alias(f"r_{c}") for c in ranks),
        *(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"i_{c}") for c in [*ranks, *zscores]),
    )
    absent = [c for c in required if c not in df.columns]
    rows = [got.select(*check_row("unique_keys", F.col("dup") == 0, F.col("dup"))), got.select(*check_row("required_columns", F.lit(not absent), F.lit(",".join(absent))))]
    rows += [got.select(*check_row(f"range_{c}", F.col(f"r_{c}") == 0, F.col(f"r_{c}"))) for c in ranks]
    rows += [got.select(*check_row(f"finite_{c}", F.col(f"i_{c}") == 0, F.col(f"i_{c}"))) for c in [*ranks, *zscores]]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def gate(report: DataFrame) -> None:
    """Raises where a check failed; warnings pass."""
    bad = [f"{r['check']}: {r['detail']}" for r in report.filter("status = 'FAIL'").collect()]
    if bad:
        raise ValueError("failed checks: " + "; ".join(bad))


def gated_write(df: DataFrame, report: DataFrame, path: str, force: bool = False) -> None:
    if not force:
        gate(report)
    df.write.mode("overwrite").parquet(path)


def same_on_truncation(build, bars: DataFrame, cut, columns: list[str], tol: float = 1e-8) -> DataFrame:
    """Look-ahead check: rows up to `cut` built from all bars and from bars up to it, compared."""
    full, short = build(bars).filter(F.col("date") <= F.lit(cut)), build(bars.filter(F.col("date") <= F.lit(cut)))
    pairs = full.select("ticker", "date", *columns).join(short.select("ticker", "date", *(F.col(c).alias(f"_{c}") for c in columns)), ["ticker", "date"], "full_outer")
    differs = lambda c: ~(F.col(c).eqNullSafe(F.col(f"_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"_{c}")) <= tol, F.lit(False)))
    got = pairs.agg(*(F.count_if(differs(c)).alias(c) for c in columns))
    out = None
    for c in columns:
        row = got.select(*check_row(f"no_lookahead_{c}", F.col(c) == 0, F.col(c)))
        out = row if out is None else out.unionByName(row)
    return out
