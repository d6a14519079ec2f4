"""Lag, rolling, exponential and difference features of the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS
from shelfcast.functions.series import (
    add_ema, add_levels, newest_first, preceding, run_marks, run_since, run_until, series_window, trailing,
)

# Lags and the windows of the leakage-safe family.
LAGS = (1, 7, 14, 28)
SAFE_WINDOWS = (7, 14, 28)
DIFFS = (1, 2, 7)
# Fixed value: a span of 14 rows as a smoothing factor.
SAFE_ALPHA = 2 / 15


def lag_columns(target: str, w, max_lag: int = 28) -> dict[str, Column]:
    return {f"{target}_lag_{n}": F.lag(target, n).over(w) for n in LAGS if n <= max_lag}


def rolling_columns(target: str, w, windows: Sequence[int] = SAFE_WINDOWS, max_lag: int = 28, median: bool = True) -> dict[str, Column]:
    """Trailing statistics with the current row included."""
    out = {}
    for n in windows:
        if n > max_lag:
            continue
        f = trailing(w, n)
        out[f"{target}_rolling_mean_{n}"] = F.avg(target).over(f)
        out[f"{target}_rolling_std_{n}"] = F.stddev_samp(target).over(f)
        out[f"{target}_rolling_min_{n}"] = F.min(target).over(f)
        out[f"{target}_rolling_max_{n}"] = F.max(target).over(f)
        if median:
            out[f"{target}_rolling_median_{n}"] = F.percentile(target, F.lit(0.5)).over(f)
    return out


def diff_columns(target: str, w) -> dict[str, Column]:
    return {f"{target}_diff_{n}": F.col(target) - F.lag(target, n).over(w) for n in DIFFS}


def lag_level(target: str, w, windows: Sequence[int] = SAFE_WINDOWS, max_lag: int = 28) -> dict[str, Column]:
    return {**lag_columns(target, w, max_lag), **rolling_columns(target, w, windows, max_lag), **diff_columns(target, w)}


def add_lag_features(df: DataFrame, target: str = "sales", keys: Sequence[str] = KEYS, date: str = DATE,
                     max_lag: int = 28, windows: Sequence[int] = SAFE_WINDOWS, alpha: float = 0.3) -> DataFrame:
    out = add_ema(df, target, f"{target}_ema_{int(1 / alpha)}", alpha, adjust=False, keys=keys, date=date)
    return out.withColumns(lag_level(target, series_window(keys, date), windows, max_lag))


def promo_level(promo: str = "on_promo", keys: Sequence[str] = KEYS, date: str = DATE,
                windows: Sequence[int] = SAFE_WINDOWS) -> tuple[dict, dict, list]:
    """Trailing promotion counts and the position in the current run of equal flags."""
    w = series_window(keys, date)
    one = {f"{promo}_rolling_{n}": F.sum(promo).over(trailing(w, n)) for n in windows}
    two = {"days_since_last_promo": run_since(w, "_run"), "days_until_next_promo": run_until(newest_first(keys, date), "_run")}
    return {**one, **run_marks(F.col(promo), w, "_run")}, two, ["_run_rn", "_run_starts", "_run_ends"]


def add_promo_lag_features(df: DataFrame, promo: str = "on_promo", keys: Sequence[str] = KEYS, date: str = DATE,
                           windows: Sequence[int] = SAFE_WINDOWS) -> DataFrame:
    return add_levels(df, promo_level(promo, keys, date, windows))


def safe_columns(columns: Sequence[str], target: str, w) -> dict[str, Column]:
    """Columns that use earlier rows only."""
    out = lag_columns(target, w)
    for n in SAFE_WINDOWS:
        f = preceding(w, n)
        out[f"{target}_rolling_mean_{n}"] = F.avg(target).over(f)
        out[f"{target}_rolling_std_{n}"] = F.stddev_samp(target).over(f)
    if "on_promo" in columns:
        out["promo_lag_1"] = F.lag("on_promo", 1).over(w)
        out["promo_rolling_7"] = F.sum("on_promo").over(preceding(w, 7))
    return out


def add_safe_lag_features(df: DataFrame, target: str = "sales", keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    out = add_ema(df, target, f"{target}_ema_14", SAFE_ALPHA, adjust=True, keys=keys, date=date, shift=1)
    return out.withColumns(safe_columns(df.columns, target, series_window(keys, date)))
