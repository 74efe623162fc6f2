"""Point-in-time transforms of signals within a date, in the three generations' definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import div
from ..functions.ranks import pct_rank, unit_rank


def winsorised(x: Column, by: list[str], low: float = 0.01, high: float = 0.99) -> Column:
    w = Window.partitionBy(*by)
    return F.when(x.isNotNull(), F.greatest(F.percentile(x, low).over(w), F.least(F.percentile(x, high).over(w), x)))


def zscore(x: Column, by: list[str], population: bool = False) -> Column:
    w = Window.partitionBy(*by)
    return div(x - F.avg(x).over(w), (F.stddev_pop if population else F.stddev_samp)(x).over(w))


def _gate(x: Column, by: list[str], least: int) -> Column:
    return F.count(x).over(Window.partitionBy(*by)) >= least


def transform(panel: DataFrame, alphas: list[str], variant: str = "B", on: str = "date", least: int = 50, sector_least: int = 5) -> DataFrame:
    """Adds the variant's columns for each alpha.

    A: `_cs_winsorized _cs_zscore _cs_rank _sector_neutral_value _sector_neutral_rank`; B: `_z _rank _sector_neutral_rank`; T: `_z _rank`.
    """
    by, sector = [on], [on, "sector"]
    panel = panel.withColumns({f"_w_{a}": F.when(_gate(F.col(a), by, least), winsorised(F.col(a), by)) for a in alphas})
    out = {}
    for a in alphas:
        raw, win = F.col(a), F.col(f"_w_{a}")
        ok, sector_ok = _gate(raw, by, least), _gate(raw, sector, sector_least)
        if variant == "A":
            out |= {
                f"{a}_cs_winsorized": win, f"{a}_cs_zscore": zscore(win, by), f"{a}_cs_rank": F.when(ok, pct_rank(raw, by)),
                f"{a}_sector_neutral_value": F.when(sector_ok, raw - F.avg(raw).over(Window.partitionBy(*sector))),
                f"{a}_sector_neutral_rank": F.when(sector_ok, pct_rank(raw, sector)),
            }
        elif variant == "B":
            out |= {f"{a}_z": zscore(win, by), f"{a}_rank": unit_rank(win, by), f"{a}_sector_neutral_rank": F.when(ok & sector_ok, unit_rank(win, sector))}
        else:
            out |= {f"{a}_z": zscore(win, by, population=True), f"{a}_rank": pct_rank(win, by)}
    return panel.withColumns(out).drop(*(f"_w_{a}" for a in alphas))


def minus_sector_median(panel: DataFrame, x: str, out: str, least: int = 5, on: str = "date") -> DataFrame:
    """Signal 34: x minus the median of its sector on the date."""
    w = Window.partitionBy(on, "sector")
    return panel.withColumn(out, F.when(F.count(x).over(w) >= least, F.col(x) - F.median(x).over(w)))
