"""Batch scoring of request tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.config import DATE, KEYS
from shelfcast.operators.features.calendar import cyclical, date_parts
from shelfcast.panel import series_keys

# The scoring vector in order, and what its columns hold when nothing is known.
FEATURES = (
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year",
    "is_month_start", "is_month_end", "is_weekend",
    "is_holiday", "days_to_holiday", "days_from_holiday",
    "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_lag_28",
    "sales_rolling_mean_7", "sales_rolling_mean_14", "sales_rolling_mean_28",
    "sales_rolling_std_7", "sales_rolling_std_14", "sales_rolling_std_28",
    "sales_ema_14",
    "on_promo", "price", "price_pct_change", "promo_rolling_7",
    "annual_sin", "annual_cos", "monthly_sin", "monthly_cos", "weekly_sin", "weekly_cos",
)
HISTORY = tuple(c for c in FEATURES if c.startswith("sales_"))
DEFAULT_PRICE = 1.0
DEFAULT_DISTANCE = 30
BASE_SHARE, COMPLEXITY_SHARE = 0.15, 0.1


def expand_requests(requests: DataFrame) -> DataFrame:
    """One row per requested day, both ends included, with its planned promotion and price."""
    days = requests.select("*", F.posexplode(F.sequence("start_date", "end_date")).alias("_i", "date"))
    out = days.withColumns({
        "on_promo": F.coalesce(F.get("promo_plan", F.col("_i")), F.lit(0)).cast("int"),
        "price": F.get("price_plan", F.col("_i")).cast("double"),
    })
    return out.drop("_i", "promo_plan", "price_plan", "start_date", "end_date")


def scoring_features(days: DataFrame, history: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The scoring vector for expanded requests.

    ``history`` may hold the last known lag and rolling values per series (see ``last_known``);
    without it, and for unknown series, they are 0.
    """
    parts, cycles = date_parts(), cyclical()
    cal = {c: parts[c] for c in FEATURES if c in parts}
    cal.update({c: cycles[c] for c in FEATURES if c in cycles})
    fixed = {
        "is_holiday": F.lit(0), "days_to_holiday": F.lit(DEFAULT_DISTANCE), "days_from_holiday": F.lit(DEFAULT_DISTANCE),
        "price": F.coalesce("price", F.lit(DEFAULT_PRICE)), "price_pct_change": F.lit(0.0), "promo_rolling_7": F.col("on_promo"),
    }
    known = [c for c in HISTORY if history is not None and c in history.columns]
    out = days.join(history.select(*keys, *known), list(keys), "left") if known else days
    past = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in known else F.lit(0.0) for c in HISTORY}
    return out.withColumns({**cal, **fixed, **past})


def last_known(features: DataFrame, keys: Sequence[str] = KEYS, date: str = DATE) -> DataFrame:
    """The newest lag and rolling values of each series."""
    have = [c for c in HISTORY if c in features.columns]
    return features.groupBy(*keys).agg(*[F.max_by(c, date).alias(c) for c in have])


def vector_spread(columns: Sequence[str] = FEATURES) -> Column:
    """Population standard deviation across the scoring vector of a row."""
    values = [F.col(c).cast("double") for c in columns]
    mean = sum(values[1:], values[0]) / len(values)
    squares = [(v - mean) * (v - mean) for v in values]
    return F.sqrt(sum(squares[1:], squares[0]) / len(values))


def fallback_interval(df: DataFrame, point: str = "yhat", columns: Sequence[str] = FEATURES) -> DataFrame:
    """Bounds for models that give none: 15 % of the point, widened by the spread of the inputs."""
    df = df.withColumn("_u", F.abs(F.col(point)) * BASE_SHARE * (1 + COMPLEXITY_SHARE * vector_spread(columns)))
    return df.withColumns({
        "yhat_lower": F.greatest(F.col(point) - F.col("_u"), F.lit(0.0)),
        "yhat_upper": F.col(point) + F.col("_u"),
    }).drop("_u")


def predict(model, df: DataFrame, name: str = "model", version: str = "latest") -> DataFrame:
    """Apply a fitted model; points and lower bounds are not negative."""
    out = model.transform(df)
    if "yhat" not in out.columns:
        out = out.withColumnRenamed("prediction", "yhat")
    if "yhat_lower" not in out.columns or "yhat_upper" not in out.columns:
        out = fallback_interval(out)
    return out.select(
        *KEYS, DATE, F.greatest("yhat", F.lit(0.0)).alias("yhat"), F.greatest("yhat_lower", F.lit(0.0)).alias("yhat_lower"),
        "yhat_upper", F.lit(name).alias("model_name"), F.lit(version).alias("model_version"),
    )


def requests_for_all(panel: DataFrame, as_of, days: int = 7, keys: Sequence[str] = KEYS) -> DataFrame:
    """A request for every series from ``as_of`` to ``days`` later."""
    start = as_of if isinstance(as_of, Column) else F.lit(as_of if isinstance(as_of, dt.date) else str(as_of)).cast("date")
    return series_keys(panel, keys).withColumns({
        "start_date": start, "end_date": F.date_add(start, days),
        "promo_plan": F.lit(None).cast("array<int>"), "price_plan": F.lit(None).cast("array<double>"),
    })


def score_all_series(panel: DataFrame, model, as_of, days: int = 7, history: DataFrame | None = None,
                     name: str = "model", version: str = "latest") -> DataFrame:
    requests = requests_for_all(panel, as_of, days)
    return predict(model, scoring_features(expand_requests(requests), history), name, version)
