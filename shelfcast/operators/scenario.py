"""What-if scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import KEYS

# Fixed value: number of equal slots a day's draw falls into.
SLOTS = 1_000_000


def scenario_plan(requests: DataFrame, promo_pct: float, price_change_pct: float, base_price: float = 10.0,
                  seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fill both plans of a request table: a promotion on about ``promo_pct`` % of days, one changed price.

    The draw of a day is a hash of series, day and seed, so it does not depend on partitions or retries.
    """
    days = F.sequence("start_date", "end_date")
    price = base_price * (1 + price_change_pct / 100)

    def draw(d: Column) -> Column:
        return (F.pmod(F.xxhash64(*keys, d, F.lit(seed)), F.lit(SLOTS)) < promo_pct / 100 * SLOTS).cast("int")

    return requests.withColumns({"promo_plan": F.transform(days, draw), "price_plan": F.transform(days, lambda d: F.lit(price))})


def scenario_compare(base: DataFrame, scenario: DataFrame, column: str = "yhat", keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals of both forecasts per series with the impact and its percentage."""
    a = base.groupBy(*keys).agg(F.sum(column).alias("base_total"))
    b = scenario.groupBy(*keys).agg(F.sum(column).alias("scenario_total"))
    impact = F.col("scenario_total") - F.col("base_total")
    return a.join(b, list(keys)).withColumns({"impact": impact, "impact_pct": F.try_divide(impact, F.col("base_total")) * 100})


def accuracy_gain(previous_rmse: Column, new_rmse: Column) -> Column:
    return F.try_divide(previous_rmse - new_rmse, previous_rmse) * 100


def inventory_savings(safety_stock_cut: Column, holding_cost: Column, stockouts_cut: Column, stockout_cost: Column) -> Column:
    return safety_stock_cut * holding_cost + stockouts_cut * stockout_cost
