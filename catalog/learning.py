"""Trained models: closed forms against SQL, the others by invariants that SQL can say, and by the tests."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from catalog.base import FILLED, K, PANEL, as_panel, filled_of, panel_of, query
from shelfcast.config import Config
from shelfcast.functions.ranking import checkpointed
from shelfcast.operators import clean, explain, models, scoring, tuning
from shelfcast.panel import rolling_origin_splits, split_at
from shelfcast.plans.scoring import scoring_run
from shelfcast.plans.training import train_and_select


def parts(spark, folder):
    """(training rows, validation rows) of the imputed panel: the last four weeks are held out."""
    p = clean.impute_defaults(clean.impute_median(clean.impute_sales(filled_of(spark, folder)), ["price"]))
    # Read by every fold and again for features of later days, so written once.
    panel = as_panel(checkpointed(p.select("date", "store_id", "item_id", "sales", "on_promo", "price")))
    return split_at(panel, rolling_origin_splits(panel, 1, 28)[0])


def _boosted(spark, folder, forecaster):
    train, val = parts(spark, folder)
    fitted = forecaster.fit(models.model_features(train))
    return fitted, models.future_features(train, val)


@query("gbt_forecast")
def _(spark, folder):
    fitted, ahead = _boosted(spark, folder, models.gbt_forecaster())
    return fitted.predict(ahead).select("store_id", "item_id", "date", "yhat")


@query("boosted_depth_forecast")
def _(spark, folder):
    fitted, ahead = _boosted(spark, folder, models.boosted_depth_forecaster())
    return fitted.predict(ahead).select("store_id", "item_id", "date", "yhat")


@query("quantile_forecast")
def _(spark, folder):
    fitted, ahead = _boosted(spark, folder, models.QuantileForecaster(models.gbt_forecaster()))
    return fitted.predict(ahead).select("store_id", "item_id", "date", "q10", "q50", "q90", "yhat", "yhat_lower", "yhat_upper")


@query("seasonal_ar_forecast")
def _(spark, folder):
    train, val = parts(spark, folder)
    return models.SeasonalArForecaster(seasonal=(1, 1, 1, 7), exog=("on_promo",)).fit(train).predict(val)


@query("trend_seasonality_forecast")
def _(spark, folder):
    train, val = parts(spark, folder)
    fitted = models.TrendSeasonalityForecaster(regressors=("on_promo",)).fit(train)
    return fitted.predict(val).select("store_id", "item_id", "date", "yhat", "yhat_lower", "yhat_upper")


@query("feature_importance")
def _(spark, folder):
    fitted, _ = _boosted(spark, folder, models.gbt_forecaster())
    return fitted.feature_importance().limit(10)


@query("contributions")
def _(spark, folder):
    train, val = parts(spark, folder)
    fitted = models.TrendSeasonalityForecaster(regressors=("on_promo",)).fit(train)
    return explain.explain_contributions(fitted.contributions(val), 5)


@query("mean_abs_contribution")
def _(spark, folder):
    train, val = parts(spark, folder)
    fitted = models.TrendSeasonalityForecaster(regressors=("on_promo",)).fit(train)
    return explain.mean_abs_contribution(fitted.contributions(val))


@query("tune_seasonal_ar")
def _(spark, folder):
    train, _ = parts(spark, folder)
    # No time budget: all trials run, so that rows don't depend on the clock.
    return tuning.tune_seasonal_ar(as_panel(train), budget_sec=math.inf)[1].select("trial", "fold", "metric", "value")


@query("train_and_select")
def _(spark, folder):
    found = train_and_select(panel_of(spark, folder), {"trend_seasonality": models.TrendSeasonalityForecaster()}, Config())
    return found["summary"]


def scoring_model(spark, folder):
    train, _ = parts(spark, folder)
    days = scoring.scoring_features(train.select("date", "store_id", "item_id", "on_promo", "price"))
    labelled = days.join(train.select("date", "store_id", "item_id", "sales"), ["date", "store_id", "item_id"])
    return models.GbtForecaster(inputs=scoring.FEATURES).fit(labelled)


@query("score_all_series")
def _(spark, folder):
    return scoring.score_all_series(panel_of(spark, folder), scoring_model(spark, folder), dt.date(2001, 11, 5))


@query("scoring_run")
def _(spark, folder):
    return scoring_run(panel_of(spark, folder), scoring_model(spark, folder), dt.date(2001, 11, 5))["summary"]


@query(
    "custom_series_model",
    f"""WITH {PANEL}, b AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY date DESC) AS back FROM panel) --result
    SELECT {K}, avg(sales) AS level FROM b WHERE back <= 7 GROUP BY {K}""",
    ["level"],
)
def _(spark, folder):
    def last_week(pdf):
        tail = pdf.sort_values("date").sales.tail(7)
        return pdf[["store_id", "item_id"]].head(1).assign(level=float(tail.mean()))

    p = panel_of(spark, folder).select("date", "store_id", "item_id", "sales")
    return models.per_series(p, last_week, "store_id string, item_id string, level double")


DAY_ZERO = "1992-01-01"


@query(
    "series_trend",
    f"""WITH {PANEL}, d AS (SELECT {K}, sales, CAST(date - DATE '{DAY_ZERO}' AS DOUBLE) AS x FROM panel) --result
    SELECT {K}, count(*) AS n, regr_slope(sales, x) AS slope, regr_intercept(sales, x) AS intercept, avg(x) AS mean_x FROM d GROUP BY {K}""",
    ["slope", "intercept", "mean_x"],
)
def _(spark, folder):
    days = panel_of(spark, folder).withColumn("x", F.datediff("date", F.lit(DAY_ZERO)))
    return models.series_slopes(days, "sales", "x")


def _means_sql(name: str, by: str) -> str:
    past = "ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""SELECT {by}, date, sum(sum(sales)) OVER (PARTITION BY {by} {past}) AS s, sum(count(sales)) OVER (PARTITION BY {by} {past}) AS n
      FROM panel GROUP BY {by}, date""" if name else f"SELECT date, sum(sum(sales)) OVER ({past}) AS s, sum(count(sales)) OVER ({past}) AS n FROM panel GROUP BY date"


@query(
    "key_target_means",
    f"""WITH {PANEL}, every AS ({_means_sql("", "")}), stores AS ({_means_sql("store", "store_id")}), series AS ({_means_sql("series", K)}) --result
    SELECT r.store_id, r.item_id, r.date, (coalesce(s.s, 0) + 10 * e.s / e.n) / (coalesce(s.n, 0) + 10) AS mean_store,
      (coalesce(r.s, 0) + 10 * e.s / e.n) / (coalesce(r.n, 0) + 10) AS mean_series
    FROM series r JOIN stores s ON s.store_id = r.store_id AND s.date = r.date JOIN every e ON e.date = r.date""",
    ["mean_store", "mean_series"],
    ["date"],
)
def _(spark, folder):
    panel = panel_of(spark, folder).select("store_id", "item_id", "date", "sales")
    store, series = (models.earlier_means(panel, by, name) for by, name in ((["store_id"], "mean_store"), (["store_id", "item_id"], "mean_series")))
    return series.join(store, ["store_id", "date"]).select("store_id", "item_id", "date", "mean_store", "mean_series")


LAST_WEEKS = f"WITH {FILLED}, ends AS (SELECT max(date) AS last FROM filled) --result\nSELECT {K}"


@query("tree_contributions", LAST_WEEKS + ", date, TRUE AS adds_up FROM filled, ends WHERE date > last - 28", [], ["date"])
def _(spark, folder):
    """What every input adds to the boosted forecast of a row: with the bias, the forecast itself."""
    fitted, ahead = _boosted(spark, folder, models.gbt_forecaster())
    ahead = checkpointed(ahead)
    ids = ["store_id", "item_id", "date"]
    total = fitted.contributions(ahead).groupBy(*ids).agg(F.sum("contribution").alias("total"))
    off = F.abs(F.col("yhat") - fitted.bias() - F.col("total"))
    return fitted.predict(ahead).select(*ids, "yhat").join(total, ids, "left").select(*ids, (off < 1e-6 * (1 + F.abs("yhat"))).alias("adds_up"))


@query("tree_mean_abs_contribution")
def _(spark, folder):
    fitted, ahead = _boosted(spark, folder, models.gbt_forecaster())
    return explain.mean_abs_contribution(fitted.contributions(ahead), 10)


def _checked(val, pred):
    """Per series: days forecast, and whether bounds are in order."""
    both = val.select("store_id", "item_id", "date", F.col("sales").alias("actual")).join(pred, ["store_id", "item_id", "date"], "left")
    ordered = F.every((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper")))
    return both.groupBy("store_id", "item_id").agg(F.count("yhat").alias("n_days"), F.coalesce(ordered, F.lit(False)).alias("ordered"))


CHECKED = LAST_WEEKS + ", count(*) AS n_days, TRUE AS ordered FROM filled, ends WHERE date > last - 28 GROUP BY store_id, item_id"


@query("leaf_quantile_checks", CHECKED)
def _(spark, folder):
    _, val = parts(spark, folder)
    fitted, ahead = _boosted(spark, folder, models.QuantileForecaster(models.gbt_forecaster()))
    return _checked(val, fitted.predict(ahead))


@query("moving_average_checks", CHECKED)
def _(spark, folder):
    train, val = parts(spark, folder)
    return _checked(val, models.SeasonalArForecaster(order=(1, 1, 2), seasonal=(1, 0, 1, 7), exog=("on_promo",)).fit(train).predict(val))


@query("own_trend_checks", CHECKED)
def _(spark, folder):
    train, val = parts(spark, folder)
    return _checked(val, models.TrendSeasonalityForecaster(regressors=("on_promo",)).fit(train).predict(val))
