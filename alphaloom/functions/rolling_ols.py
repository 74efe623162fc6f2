"""Rolling multi-factor regression residuals: the one signal input that needs Python."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rolling_residual(y: np.ndarray, x: np.ndarray, window: int = 252, least: int | None = None) -> np.ndarray:
    """Residual of the last row of each window's OLS with intercept, over its complete rows, from cumulative cross products."""
    least = window // 2 if least is None else least
    n, design = len(y), np.column_stack([np.ones(len(y)), x])
    ok = np.isfinite(y) & np.isfinite(design).all(1)
    d, t = np.where(ok[:, None], design, 0.0), np.where(ok, y, 0.0)
    window_sum = lambda v: (lambda c: c[window:] - c[:-window])(np.concatenate([np.zeros((1, *v.shape[1:])), np.cumsum(v, 0)]))
    out = np.full(n, np.nan)
    if n < window:
        return out
    gram, cross, count = window_sum(d[:, :, None] * d[:, None, :]), window_sum(d * t[:, None]), window_sum(ok.astype(float))
    use = (count >= max(least, 1)) & ok[window - 1 :]
    if use.any():
        beta = np.einsum("nij,nj->ni", np.linalg.pinv(gram[use], hermitian=True), cross[use])
        rows = np.flatnonzero(use) + window - 1
        out[rows] = y[rows] - (design[rows] * beta).sum(1)
    return out


def add_residual(df: DataFrame, y: str, factors: list[str], window: int = 252, least: int | None = None) -> DataFrame:
    """Adds `residual`. One ticker's history is one group; its length is bounded by the calendar."""
    keys = df.select("ticker", "date", y, *factors)
    schema = T.StructType([*(f for f in keys.schema if f.name in ("ticker", "date")), T.StructField("residual", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        pdf["residual"] = rolling_residual(pdf[y].to_numpy(float), pdf[factors].to_numpy(float), window, least)
        return pdf[["ticker", "date", "residual"]]

    out = keys.groupBy("ticker").applyInPandas(run, schema)
    return df.join(out.withColumn("residual", F.when(~F.isnan("residual"), F.col("residual"))), ["ticker", "date"], "left")
