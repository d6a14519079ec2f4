"""One query from raw order lines to forecast accuracy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.base import FILLED, K, W, as_panel, query
from shelfcast.operators import baselines, clean, metrics
from shelfcast.operators.features import lag
from shelfcast.functions.series import series_window
from shelfcast.sources.star import sales_panel

HORIZON = 28


def holdout_accuracy(spark, folder):
    """Panel, calendar gaps, imputation and leakage-safe means, a forecast of the last weeks, accuracy per series."""
    raw = sales_panel(spark, folder)
    first, last = raw.agg(F.min("date"), F.max("date")).first()
    cut = F.lit(last - dt.timedelta(days=HORIZON - 1))
    full = clean.impute_sales(clean.fill_calendar_gaps(raw, start=first, end=last))
    w = series_window()
    full = full.withColumn("recent", lag.safe_columns([], "sales", w)["sales_rolling_mean_28"])
    train, val = full.where(F.col("date") < cut), full.where(F.col("date") >= cut)
    ahead = baselines.seasonal_naive(as_panel(train), HORIZON).select("store_id", "item_id", "date", F.col("sales").alias("forecast"))
    both = val.join(ahead, ["store_id", "item_id", "date"]).withColumnRenamed("sales", "actual")
    level = both.groupBy("store_id", "item_id").agg(F.avg("recent").alias("recent_level"))
    return metrics.series_metrics(both).join(level, ["store_id", "item_id"])


NAMES = ["RMSE", "MAE", "MAPE", "sMAPE"]

query(
    "holdout_accuracy",
    f"""WITH {FILLED},
    full_panel AS (SELECT date, {K}, coalesce(last_value(sales IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING),
        first_value(sales IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sales FROM filled),
    r AS (SELECT *, avg(sales) OVER ({W} ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS recent FROM full_panel),
    c AS (SELECT max(date) - 27 AS cut FROM filled),
    t AS (SELECT r.*, row_number() OVER (PARTITION BY {K} ORDER BY date DESC) AS back FROM r, c WHERE date < cut),
    v AS (SELECT r.date, r.store_id, r.item_id, r.sales AS actual, r.recent, t.sales AS forecast FROM r, c, t
          WHERE r.date >= cut AND t.store_id = r.store_id AND t.item_id = r.item_id AND t.back = 7 - date_diff('day', cut, r.date) % 7),
    e AS (SELECT *, actual - forecast AS e, (abs(actual) + abs(forecast)) / 2 AS half FROM v) --result
    SELECT {K}, sqrt(avg(e * e)) AS "RMSE", avg(abs(e)) AS "MAE", avg(abs(e / actual)) FILTER (WHERE actual <> 0) * 100 AS "MAPE",
      avg(abs(e) / half) FILTER (WHERE half <> 0) * 100 AS "sMAPE", count(*) AS length, avg(recent) AS recent_level FROM e GROUP BY {K}""",
    [*NAMES, "recent_level"],
)(holdout_accuracy)
