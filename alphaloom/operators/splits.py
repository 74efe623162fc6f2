"""Date splits, folds and samples: tables with one row a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def date_split(panel: DataFrame, train: float = 0.6, val: float = 0.2, on: str = "date") -> DataFrame:
    """date, split: the first share of unique dates trains, the next validates, the rest tests."""
    w, every = Window.orderBy(on), Window.partitionBy()
    k, n = F.row_number().over(w), F.count(F.lit(1)).over(every)
    days = panel.select(on).distinct().select(on, k.alias("k"), n.alias("n"))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * (train + val))
    return days.select(on, F.when(F.col("k") <= a, "train").when(F.col("k") <= b, "val").otherwise("test").alias("split"))


def expanding_folds(panel: DataFrame, folds: int, on: str = "date") -> DataFrame:
    """date, fold: unique dates in `folds` + 1 consecutive blocks, the first ones a date longer where they don't divide."""
    k, n = F.row_number().over(Window.orderBy(on)) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    days = panel.select(on).distinct().select(on, k.alias("k"), n.alias("n"))
    size, extra = F.floor(F.col("n") / (folds + 1)), F.col("n") % (folds + 1)
    fold = F.when(F.col("k") < extra * (size + 1), F.floor(F.col("k") / (size + 1))).otherwise(extra + F.floor((F.col("k") - extra * (size + 1)) / F.greatest(size, F.lit(1))))
    return days.select(on, fold.cast("int").alias("fold"))


def walk_forward(panel: DataFrame, train: int = 12, val: int = 3, step: int = 3, on: str = "date") -> DataFrame:
    """fold, train_from, train_to, val_to by month starts; ends are exclusive."""
    span = panel.agg(F.trunc(F.min(on), "month").alias("a"), F.trunc(F.max(on), "month").alias("b"))
    starts = span.select(F.posexplode(F.expr(f"sequence(a, b, interval {step} month)")).alias("fold", "train_from"), "b")
    out = starts.withColumn("train_to", F.add_months("train_from", train)).withColumn("val_to", F.add_months("train_from", train + val))
    return out.filter(F.col("val_to") <= F.add_months("b", 1)).drop("b")


def stride(panel: DataFrame, every: int, on: str = "date") -> DataFrame:
    """Rows of every n-th unique date."""
    days = panel.select(on).distinct().withColumn("_k", F.row_number().over(Window.orderBy(on)) - 1).filter(F.col("_k") % every == 0)
    return panel.join(days.select(on), on, "left_semi")


def sample_dates(panel: DataFrame, n: int = 100, seed: int = 42, on: str = "date") -> DataFrame:
    """n seeded dates: a sampling operator."""
    return panel.select(on).distinct().orderBy(F.xxhash64(F.col(on), F.lit(seed))).limit(n)


def drop_thin(panel: DataFrame, least: int = 50, on: str = "date") -> DataFrame:
    w = Window.partitionBy(on)
    return panel.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") >= least).drop("_n")


def usable_features(panel: DataFrame, features: list[str], target: str, rows: int = 1000, dates: int = 50, on: str = "date") -> DataFrame:
    """feature, n_rows, n_dates, usable: in one aggregation."""
    both = panel.select(on, F.col(target).alias("_t"), *features).filter(F.col("_t").isNotNull()).unpivot([on], features, "feature", "value")
    out = both.filter(F.col("value").isNotNull()).groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(on).alias("n_dates"))
    return out.withColumn("usable", (F.col("n_rows") >= rows) & (F.col("n_dates") >= dates))
