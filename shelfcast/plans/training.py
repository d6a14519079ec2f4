"""From raw rows to a champion model."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.config import Config
from shelfcast.functions.ranking import checkpointed as saved
from shelfcast.operators import backtest, runlog
from shelfcast.operators.clean import clean
from shelfcast.operators.models import model_features
from shelfcast.panel import Panel, union_all

log = logging.getLogger(__name__)


def naive_fit(train: DataFrame) -> None:
    return None


def naive_predict(_, future: DataFrame) -> DataFrame:
    """One-step naive from the lag column; the lag is missing beyond the first day and falls back on the 28-day mean."""
    return future.withColumn("yhat", F.coalesce(F.col("sales_lag_1"), F.col("sales_rolling_mean_28"), F.lit(0.0)))


def register(panel: Panel, per_fold: DataFrame, summary: DataFrame, forecasters: dict[str, object],
             featurise: Callable[[DataFrame], DataFrame], registry: str, at: dt.datetime) -> None:
    """Log the fold metrics; store the best forecaster and enter it in the model table."""
    spark = per_fold.sparkSession
    run = f"{at:%Y%m%dT%H%M%S%f}"
    runs = backtest.metrics_long(per_fold).select(F.concat(F.lit(f"{run}-"), "model").alias("run_id"), "model", "fold", "metric", "value",
                                                  F.lit(at).alias("logged_at"))
    runlog.log_runs(runs, f"{registry}/runs")
    best = backtest.select_champion(summary.where(F.col("model").isin(list(forecasters)))).first()
    if best is None:
        return
    path = f"{registry}/models/{best.model}/{run}"
    forecasters[best.model].fit(featurise(panel.df)).save(path)
    try:
        known = spark.read.schema(runlog.MODEL_SCHEMA).parquet(f"{registry}/table")
        version = (known.where(F.col("name") == best.model).agg(F.max("version")).first()[0] or 0) + 1
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        version = 1
    runlog.log_models(spark.createDataFrame([(best.model, version, "Production", path, f"{run}-{best.model}", at)], runlog.MODEL_SCHEMA), f"{registry}/table")


def train_and_select(raw: DataFrame, forecasters: dict[str, object], config: Config = Config(), impute: bool = True,
                     featurise: Callable[[DataFrame], DataFrame] = model_features, registry: str | None = None,
                     at: dt.datetime | None = None) -> dict[str, DataFrame]:
    """Clean, featurise, backtest each forecaster, the one-step naive model and the baselines, rank, and pick the champion.

    Returns the tables ``predictions``, ``folds`` (status), ``fold_metrics``, ``summary`` and
    ``champion``. A forecaster that fails on all folds is left out. With a ``registry`` (a folder that
    all executors share) the fold metrics are added to its run log, and the best forecaster, fitted on
    all rows, is stored and entered in its model table for production; ``at`` is the time entered.
    """
    panel = Panel(saved(clean(raw, impute=impute)))
    spark = raw.sparkSession
    predictions = [backtest.baseline_backtest(panel, config.horizon, config.folds)]
    status = []
    ways = {"one_step_naive": (naive_fit, naive_predict), **{n: (f.fit, lambda m, df: m.predict(df)) for n, f in forecasters.items()}}
    for name, (fit, predict) in ways.items():
        try:
            pred, rows = backtest.rolling_backtest(panel, fit, predict, featurise, config.horizon, config.folds, name)
            predictions.append(pred.select("store_id", "item_id", "fold", "date", "actual", "model", "forecast"))
            status += [(name, r["fold"], r["status"], r["error"]) for r in rows]
        except ValueError as e:
            log.warning("%s left out: %s", name, e)
            status.append((name, None, "failed", str(e)))
    both = union_all(predictions)
    per_fold = backtest.fold_metrics(both)
    summary = backtest.aggregate_folds(per_fold)
    if registry:
        register(panel, per_fold, summary, forecasters, featurise, registry, at or dt.datetime.now())
    return {
        "predictions": both,
        "folds": spark.createDataFrame(status, "model string, fold int, status string, error string"),
        "fold_metrics": per_fold,
        "summary": summary,
        "champion": backtest.select_champion(summary),
    }


