"""Temperature and precipitation features (optional family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS
from shelfcast.functions.series import START, add_levels, series_window, slope, trailing

# Window sizes, lags, category edges and labels.
WINDOWS = (3, 7, 14)
LAGS = (1, 3, 7)
TEMP_EDGES, TEMP_LABELS = (0, 10, 20, 30), ("very_cold", "cold", "mild", "warm", "hot")
RAIN_EDGES, RAIN_LABELS = (0.1, 2.5, 10, 25), ("none", "light", "moderate", "heavy", "extreme")


def category(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the label of the first edge that is not below the value."""
    out = F.when(x.isNull(), F.lit(None))
    for edge, label in zip(edges, labels):
        out = out.when(x <= edge, label)
    return out.otherwise(labels[-1])


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _temperature(t: str, w) -> tuple[dict, dict]:
    x = F.col(t)
    change = x - F.lag(x).over(w)
    one = {
        "temp_category": category(x, TEMP_EDGES, TEMP_LABELS),
        "is_very_cold": _yes(x < 0),
        "is_cold": _yes((x >= 0) & (x < 10)),
        "is_mild": _yes((x >= 10) & (x < 20)),
        "is_warm": _yes((x >= 20) & (x < 30)),
        "is_hot": _yes(x >= 30),
        "temp_change": change,
        "_temp_rn": F.row_number().over(w),
        "_sum": F.sum(x).over(w.rowsBetween(START, 0)),
        "_cnt": F.count(x).over(w.rowsBetween(START, 0)),
    }
    for n in WINDOWS:
        f = trailing(w, n)
        one[f"temp_rolling_mean_{n}"] = F.avg(x).over(f)
        one[f"_temp_max_{n}"] = F.max(x).over(f)
        one[f"_temp_min_{n}"] = F.min(x).over(f)
        one[f"temp_rolling_std_{n}"] = F.stddev_samp(x).over(f)
    for n in LAGS:
        one[f"temp_lag_{n}"] = F.lag(x, n).over(w)
    # The mean of the last 365 rows as a difference of running sums: constant work per row.
    total = F.col("_sum") - F.coalesce(F.lag("_sum", 365).over(w), F.lit(0.0))
    rows = F.col("_cnt") - F.coalesce(F.lag("_cnt", 365).over(w), F.lit(0))
    two = {
        "temp_change_abs": F.abs("temp_change"),
        **{f"temp_rolling_range_{n}": F.col(f"_temp_max_{n}") - F.col(f"_temp_min_{n}") for n in WINDOWS},
        "temp_trend": slope(x, F.col("_temp_rn"), w, 7),
        "temp_seasonal_deviation": x - F.try_divide(total, rows),
    }
    return one, two


def _precipitation(p: str, w) -> tuple[dict, dict]:
    x = F.col(p)
    one = {
        "precip_category": F.when(x > 0, category(x, RAIN_EDGES, RAIN_LABELS)),
        "is_dry": _yes(x == 0),
        "is_light_rain": _yes((x > 0) & (x <= 2.5)),
        "is_moderate_rain": _yes((x > 2.5) & (x <= 10)),
        "is_heavy_rain": _yes((x > 10) & (x <= 25)),
        "is_extreme_rain": _yes(x > 25),
        "precip_change": x - F.lag(x).over(w),
        "_rain_rn": F.row_number().over(w),
    }
    for n in WINDOWS:
        f = trailing(w, n)
        one[f"precip_rolling_mean_{n}"] = F.avg(x).over(f)
        one[f"precip_rolling_total_{n}"] = F.sum(x).over(f)
        one[f"precip_rolling_max_{n}"] = F.max(x).over(f)
    for n in LAGS:
        one[f"precip_lag_{n}"] = F.lag(x, n).over(w)

    def spell(reset: Column) -> Column:
        last = F.last(F.when(reset, F.col("_rain_rn")), ignorenulls=True).over(w.rowsBetween(START, 0))
        return (F.col("_rain_rn") - F.coalesce(last, F.lit(1))).cast("int")

    return one, {"dry_spell_duration": spell(x > 0), "wet_spell_duration": spell(x == 0)}


def _combined(t: str, p: str) -> dict:
    x, y = F.col(t), F.col(p)
    return {
        "weather_comfort": x * (1 - y / 100),
        "is_bad_weather": _yes((x < 10) & (y > 5)),
        "is_good_weather": _yes((x >= 15) & (x <= 25) & (y < 1)),
        "is_extreme_weather": _yes(x < -5) | _yes(x > 35) | _yes(y > 25),
        "weather_severity": F.abs(x - 20) / 20 + y / 25,
    }


def levels(columns: Sequence[str], temperature: str = "temperature", precipitation: str = "precipitation",
           keys: Sequence[str] = KEYS, date: str = DATE) -> tuple[dict, dict, list]:
    """The weather family for whichever of the two measures is at hand."""
    w = series_window(keys, date)
    one, two = {}, {}
    if temperature in columns:
        a, b = _temperature(temperature, w)
        one.update(a)
        two.update(b)
    if precipitation in columns:
        a, b = _precipitation(precipitation, w)
        one.update(a)
        two.update(b)
    if temperature in columns and precipitation in columns:
        two.update(_combined(temperature, precipitation))
    return one, two, [c for c in one if c.startswith("_")]


def add_weather(df: DataFrame, temperature: str = "temperature", precipitation: str = "precipitation",
                keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """Weather columns per series. For a table with one row per store and day pass ``keys=("store_id",)``."""
    return add_levels(df, levels(df.columns, temperature, precipitation, keys, date))
