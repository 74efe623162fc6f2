"""Backward as-of join of point-in-time snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(panel: DataFrame, snapshots: DataFrame, value: str, by: str = "ticker", on: str = "date", stale_after_last: bool = False) -> DataFrame:
    """The panel with the latest `value` at or before each row; optionally NULL after the last snapshot of its key.

    One exchange by key: panel rows and snapshots are unioned and the value is carried forward, snapshots first on ties.
    """
    left = panel.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(snapshots.schema[value].dataType)).withColumn("_seen", F.lit(None).cast(panel.schema[on].dataType))
    right = snapshots.select(by, on, value).withColumn("_side", F.lit(0)).withColumn("_seen", F.col(on))
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    if stale_after_last:
        out = out.withColumn("_last", F.max("_seen").over(Window.partitionBy(by))).withColumn(value, F.when(F.col(on) <= F.col("_last"), F.col(value)))
    return out.filter("_side = 1").select(*panel.columns, value)
