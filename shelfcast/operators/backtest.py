"""Rolling-origin backtests and champion selection."""

from __future__ import annotations

import copy
import datetime as dt
import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.series import series_window
from shelfcast.operators.baselines import BASELINES, by_name, forecasts_at, running_state
from shelfcast.operators.metrics import DEFAULT, metric_columns
from shelfcast.operators.validate import assert_chronological
from shelfcast.panel import Panel, union_all

log = logging.getLogger(__name__)


def fold_table(panel: Panel, horizon: int = 28, n_folds: int = 6) -> list[dict]:
    """Cuts at equal steps over the whole period: train before the cut, validate ``horizon`` days from it."""
    first, last = panel.df.agg(F.min(panel.date), F.max(panel.date)).first()
    if first is None:
        raise ValueError("cannot backtest an empty panel")
    size = (last - first).days // n_folds
    cuts = [first + dt.timedelta(days=(f + 1) * size) for f in range(n_folds)]
    return [{"fold": f + 1, "cut": c, "end": c + dt.timedelta(days=horizon)} for f, c in enumerate(cuts)]


def baseline_backtest(panel: Panel, horizon: int = 28, n_folds: int = 6, models: Sequence[str] = tuple(BASELINES)) -> DataFrame:
    """Predictions of all baselines on all folds: keys, date, fold, model, actual, forecast.

    The state of a series runs along once; each cut picks that of the last known row before it. No row is copied for a
    fold it trains, so one scan and one shuffle of the panel serve any number of folds, without a join.
    """
    folds = fold_table(panel, horizon, n_folds)
    d, state, last = F.col(panel.date), F.col("_state"), F.lit(dt.date.max)
    picked = [state.isNotNull() & (d < F.lit(f["cut"])) & (F.coalesce(F.col("_next"), last) >= F.lit(f["cut"])) for f in folds]
    inside = [(d >= F.lit(f["cut"])) & (d < F.lit(f["end"])) for f in folds]
    few = running_state(panel).where(reduce(or_, [*picked, *inside]))
    so_far = series_window(panel.keys, panel.date).rowsBetween(Window.unboundedPreceding, 0)
    at_cut = {f"_s{f['fold']}": F.last(F.when(here, state), ignorenulls=True).over(so_far) for f, here in zip(folds, picked)}
    hits = [F.when(here, F.struct(F.lit(f["fold"]).alias("fold"), F.col(f"_s{f['fold']}").alias("_s"))) for f, here in zip(folds, inside)]
    # A series without training rows keeps its validation rows, with null forecasts.
    val = few.withColumns(at_cut).select(*panel.keys, panel.date, F.col(panel.target).alias("actual"), F.explode(F.array_compact(F.array(*hits))).alias("_f"))
    val = val.select(*panel.keys, panel.date, "actual", "_f.fold", "_f._s.*")
    step = F.datediff(panel.date, "_last") - 1
    rows = val.withColumn("_j", step).select("*", by_name(forecasts_at(F.col("_j")), models, "model", "forecast").alias("_p"))
    return rows.select(*panel.keys, "fold", panel.date, "actual", "_p.model", "_p.forecast")


def rolling_backtest(
    panel: Panel,
    fit_fn: Callable[[DataFrame], object],
    predict_fn: Callable[[object, DataFrame], DataFrame],
    feature_fn=None,
    horizon: int = 28,
    n_folds: int = 5,
    name: str = "model",
    parallel: int = 2,
) -> tuple[DataFrame, list[dict]]:
    """Fit and predict on every fold. Returns predictions and one status row per fold.

    ``feature_fn`` is a callable on frames or an object with ``fit_transform`` and ``transform``.
    Validation features are built on the training rows followed by the validation dates without
    their target. A fold that fails is recorded and left out; it is an error if all fail.
    """
    folds = fold_table(panel, horizon, n_folds)
    d = F.col(panel.date)

    def one(f: dict):
        train = panel.df.where(d < F.lit(f["cut"]))
        val = panel.df.where((d >= F.lit(f["cut"])) & (d < F.lit(f["end"])))
        if train.isEmpty() or val.isEmpty():
            return None, {**f, "status": "skipped", "error": None}
        try:
            assert_chronological(train, val, panel.date)
            blind = val.withColumn(panel.target, F.lit(None).cast(val.schema[panel.target].dataType))
            both = train.unionByName(blind)
            if feature_fn is None:
                fitted, ahead = train, both
            elif hasattr(feature_fn, "fit_transform"):
                own = copy.copy(feature_fn)  # folds run side by side, and each fits its own
                fitted, ahead = own.fit_transform(train), own.transform(both)
            else:
                fitted, ahead = feature_fn(train), feature_fn(both)
            model = fit_fn(fitted)
            pred = predict_fn(model, ahead.where(d >= F.lit(f["cut"])))
            actual = val.select(*panel.keys, panel.date, F.col(panel.target).alias("actual"))
            keep = [c for c in ("yhat", "yhat_lower", "yhat_upper") if c in pred.columns]
            out = actual.join(pred.select(*panel.keys, panel.date, *keep), [*panel.keys, panel.date], "left")
            out = out.withColumnRenamed("yhat", "forecast").withColumns({"fold": F.lit(f["fold"]), "model": F.lit(name)})
            return out, {**f, "status": "ok", "error": None}
        except Exception as e:  # noqa: BLE001 - one bad fold must not end the run
            log.warning("fold %s of %s failed: %s", f["fold"], name, e)
            return None, {**f, "status": "failed", "error": str(e)}

    with ThreadPoolExecutor(parallel) as pool:
        results = list(pool.map(one, folds))
    frames = [r for r, _ in results if r is not None]
    if not frames:
        raise ValueError(f"no fold of {name} succeeded: {[s['error'] or s['status'] for _, s in results]}")
    return union_all(frames), [s for _, s in results]


def fold_metrics(predictions: DataFrame, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    """Metrics per model and fold, pooled over the series, with the number of validation rows and of those without a forecast."""
    counts = [F.count("*").alias("n_val"), F.count_if(F.col("forecast").isNull()).alias("n_unpredicted")]
    return predictions.groupBy("model", "fold").agg(*metric_columns("actual", "forecast", metrics), *counts)


def aggregate_folds(per_fold: DataFrame, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    cols = [f(m).alias(n) for m in metrics for f, n in ((F.avg, m), (F.stddev_pop, f"{m}_std"))]
    return per_fold.groupBy("model").agg(*cols)


def champion_scores(aggregated: DataFrame) -> DataFrame:
    score = F.coalesce(F.col("sMAPE") + 0.1 * F.coalesce(F.col("sMAPE_std"), F.lit(0.0)), F.lit(float("inf")))
    return aggregated.withColumn("score", score)


def select_champion(aggregated: DataFrame) -> DataFrame:
    """The model with the smallest mean sMAPE plus a tenth of its spread."""
    return champion_scores(aggregated).orderBy("score", "model").limit(1)


def metrics_long(per_fold: DataFrame, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    return per_fold.unpivot(["model", "fold"], list(metrics), "metric", "value")
