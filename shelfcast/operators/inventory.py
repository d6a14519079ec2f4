"""Inventory policies from forecast tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS, Config
from shelfcast.functions.normal import norm_cdf, norm_ppf

# Two-sided 95 % normal quantile, least deviation, days per year, cost of one order.
Z_95 = 1.96
MIN_STD = 0.1
DAYS = 365
ORDER_COST = 10
CARRYING_RATE = 0.25


def safety_stock(std: Column, lead_time: Column, service_level: Column) -> Column:
    return F.greatest(norm_ppf(service_level) * std * F.sqrt(lead_time), F.lit(0.0))


def eoq(demand: Column, holding_cost: Column) -> Column:
    """Economic order quantity: at least 1, and 0 where holding costs nothing."""
    size = F.sqrt(F.try_divide(2 * (demand * DAYS) * ORDER_COST, F.when(holding_cost > 0, holding_cost)))
    return F.when(holding_cost > 0, F.greatest(size, F.lit(1.0))).otherwise(0.0)


def optimal_reorder_point(mean: Column, std: Column, lead_time: Column, service_level: Column) -> Column:
    return F.greatest(mean * lead_time + safety_stock(std, lead_time, service_level), F.lit(0.0))


def stockout_probability(stock: Column, mean: Column, std: Column, lead_time: Column) -> Column:
    need, spread = mean * lead_time, std * F.sqrt(lead_time)
    step = F.when(stock >= need, 0.0).otherwise(1.0)
    p = 1 - norm_cdf(F.try_divide(stock - need, spread))
    return F.when(spread == 0, step).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))


def turnover(annual_sales: Column, average_inventory: Column) -> Column:
    return F.when(average_inventory > 0, F.try_divide(annual_sales, average_inventory)).otherwise(0.0)


def carrying_cost(average_inventory: Column, rate: float = CARRYING_RATE) -> Column:
    return average_inventory * rate


def with_params(df: DataFrame, params: DataFrame | None, config: Config, keys: Sequence[str]) -> DataFrame:
    defaults = {"service_level": config.service_level, "lead_time": config.lead_time,
                "holding_cost": config.holding_cost, "stockout_cost": config.stockout_cost}
    if params is None:
        return df.withColumns({k: F.lit(v) for k, v in defaults.items()})
    return df.join(params.select(*keys, *[c for c in params.columns if c in defaults]), list(keys), "left").withColumns(
        {k: F.coalesce(F.col(k), F.lit(v)) if k in params.columns else F.lit(v) for k, v in defaults.items()}
    )


def inventory_metrics(forecasts: DataFrame, params: DataFrame | None = None, config: Config = Config(),
                      keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """One row per series over the first lead-time days of its forecast."""
    w = Window.partitionBy(*keys).orderBy(date)
    rows = with_params(forecasts, params, config, keys).withColumn("_day", F.row_number().over(w))
    first = rows.where(F.col("_day") <= F.col("lead_time"))
    fixed = ["service_level", "lead_time", "holding_cost", "stockout_cost"]
    per = first.groupBy(*keys, *fixed).agg(
        F.sum("yhat").alias("expected_demand"),
        F.greatest(F.avg(F.col("yhat_upper") - F.col("yhat_lower")) / (2 * Z_95), F.lit(MIN_STD)).alias("demand_std"),
    )
    per = per.withColumn("safety_stock", safety_stock(F.col("demand_std"), F.col("lead_time"), F.col("service_level")))
    return per.withColumns({
        "reorder_point": F.col("expected_demand") + F.col("safety_stock"),
        "stockout_probability": 1 - F.col("service_level"),
        "economic_order_quantity": eoq(F.col("expected_demand"), F.col("holding_cost")),
    })


def optimize_order_quantity(demand: DataFrame, column: str = "yhat", holding_cost: float = 0.1, stockout_cost: float = 10.0,
                            keys: Sequence[str] = KEYS) -> DataFrame:
    """Order quantity, newsvendor quantity and 95 % seven-day reorder point per series."""
    per = demand.groupBy(*keys).agg(F.avg(column).alias("expected_demand"), F.stddev_pop(column).alias("demand_std"))
    mean, std = F.col("expected_demand"), F.col("demand_std")
    ratio = stockout_cost / (stockout_cost + holding_cost)
    return per.withColumns({
        "eoq": eoq(mean, F.lit(holding_cost)),
        "newsvendor_quantity": F.greatest(norm_ppf(F.lit(ratio)) * std + mean, F.lit(0.0)),
        "service_level_95_reorder": optimal_reorder_point(mean, std, F.lit(7), F.lit(0.95)),
        "critical_ratio": F.lit(ratio),
    })
