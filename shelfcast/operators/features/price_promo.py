"""Price, promotion, elasticity and promotion-effect features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS
from shelfcast.functions.series import (
    add_levels, change_base, newest_first, pct_change, run_marks, run_since, run_until, series_window, slope, trailing,
)

# Window sizes.
WINDOWS = (7, 14, 28)
LONG_WINDOWS = (14, 28)


def levels(columns: Sequence[str], price: str = "price", promo: str = "on_promo", sales: str = "sales",
           keys: Sequence[str] = KEYS, date: str = DATE) -> tuple[dict, dict, list]:
    """The price and promotion family for the columns at hand."""
    w = series_window(keys, date)
    has_price, has_promo, has_sales = (c in columns for c in (price, promo, sales))
    one, two, scratch = {}, {}, []
    if has_price:
        one["_price_rn"] = F.row_number().over(w)
        one.update(change_base(F.col(price), w, "_price"))
        one[f"{price}_diff"] = F.col(price) - F.lag(price).over(w)
        two[f"{price}_pct_change"] = pct_change("_price")
        scratch += ["_price_rn", "_price_now", "_price_before"]
        for n in WINDOWS:
            f = trailing(w, n)
            mean, std, low, high = f"{price}_rolling_mean_{n}", f"{price}_rolling_std_{n}", f"_price_min_{n}", f"_price_max_{n}"
            one.update({mean: F.avg(price).over(f), std: F.stddev_samp(price).over(f),
                        low: F.min(price).over(f), high: F.max(price).over(f)})
            scratch += [low, high]
            two[f"{price}_volatility_{n}"] = F.try_divide(std, mean)
            place = F.try_divide(F.col(price) - F.col(low), F.col(high) - F.col(low))
            two[f"{price}_percentile_{n}"] = F.when(F.col(high) == F.col(low), 0.5).otherwise(place)
        two["price_trend"] = slope(F.col(price), F.col("_price_rn"), w, 7)
    if has_promo:
        for n in WINDOWS:
            f = trailing(w, n)
            one[f"{promo}_rolling_{n}"] = F.sum(promo).over(f)
            one[f"{promo}_frequency_{n}"] = F.avg(promo).over(f)
        one.update(run_marks(F.col(promo), w, "_run"))
        scratch += ["_run_rn", "_run_starts", "_run_ends"]
        two["days_since_last_promo"] = run_since(w, "_run")
        two["days_until_next_promo"] = run_until(newest_first(keys, date), "_run")
    if has_price and has_sales:
        one.update(change_base(F.col(sales), w, "_sales"))
        scratch += ["_sales_now", "_sales_before"]
        elasticity = F.try_divide(pct_change("_sales"), pct_change("_price"))
        two["price_elasticity"] = elasticity
        for n in LONG_WINDOWS:
            two[f"price_elasticity_rolling_{n}"] = F.avg(elasticity).over(trailing(w, n))
        two["price_sensitivity"] = F.stddev_samp(elasticity).over(trailing(w, 28))
    if has_promo and has_sales:
        one["baseline_sales"] = F.avg(sales).over(trailing(w, 14))
        lift = F.try_divide(F.col(sales) - F.col("baseline_sales"), F.col("baseline_sales"))
        two["promo_sales_lift"] = lift
        for n in LONG_WINDOWS:
            two[f"promo_effectiveness_{n}"] = F.avg(lift).over(trailing(w, n))
        # Looks at the next day: for analysis, never a model input.
        two["promo_cannibalization"] = F.when(F.col(promo) == 1, F.lead(lift).over(w)).otherwise(0.0)
    return one, two, scratch


def run_lengths(df: DataFrame, promo: str = "on_promo") -> DataFrame:
    """Columns that follow from the position in the run."""
    since = F.col("days_since_last_promo")
    return df.withColumns({"promo_duration": since, "promo_intensity": F.col(promo) * (since + 1)})


def add_price_promo(df: DataFrame, price: str = "price", promo: str = "on_promo", sales: str = "sales",
                    keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """All price and promotion columns in two window levels over one partitioning."""
    out = add_levels(df, levels(df.columns, price, promo, sales, keys, date))
    return run_lengths(out, promo) if promo in df.columns else out
