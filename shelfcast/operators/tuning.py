"""Random search and successive halving over forecaster settings by rolling-origin error."""

from __future__ import annotations

import logging
import math
import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.metrics import metric_columns
from shelfcast.operators.models import (
    GbtForecaster, SeasonalArForecaster, future_features, model_features,
)
from shelfcast.panel import Panel, rolling_origin_splits, split_at

log = logging.getLogger(__name__)

# Search ranges by forecaster. ("int", low, high), ("float", low, high) or ("log", low, high).
# Depth ends at 10 because trees here are grown level by level.
BOOSTED_SPACE = {
    "max_depth": ("int", 3, 10), "step_size": ("log", 0.01, 0.3), "feature_share": ("float", 0.5, 1.0),
    "subsampling_rate": ("float", 0.5, 1.0), "min_instances": ("int", 10, 100),
}
DEPTH_SPACE = {
    "max_depth": ("int", 3, 10), "step_size": ("log", 0.01, 0.3), "max_iter": ("int", 50, 500),
    "subsampling_rate": ("float", 0.5, 1.0), "feature_share": ("float", 0.5, 1.0),
}
AR_SPACE = {"p": ("int", 0, 3), "d": ("int", 0, 2), "q": ("int", 0, 3), "P": ("int", 0, 2), "D": ("int", 0, 1), "Q": ("int", 0, 2), "s": ("int", 7, 14)}
# Fits of a search that run side by side.
PARALLEL = 8
TRIAL_SCHEMA = "trial int, params map<string,string>, fold int, metric string, value double"


def draw(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, (kind, low, high) in space.items():
        if kind == "int":
            out[name] = rng.randint(low, high)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            out[name] = rng.uniform(low, high)
    return out


def boosted(params: dict, **fixed) -> GbtForecaster:
    return GbtForecaster(**{**params, **fixed})


def seasonal_ar(params: dict, **fixed) -> SeasonalArForecaster:
    return SeasonalArForecaster(order=(params["p"], params["d"], params["q"]),
                                seasonal=(params["P"], params["D"], params["Q"], params["s"]), **fixed)


def tune(panel: Panel, space: dict, make: Callable[[dict], object], trials: int = 20, folds: int = 3, horizon: int = 28,
         seed: int = 42, budget_sec: float = 300.0, featurise: bool = True) -> tuple[dict, DataFrame]:
    """Best settings by mean fold RMSE, and the trial table. A trial that fails counts as infinite.

    Parameter draws are made up front from the seed. The budget is looked at as a trial begins; the
    first trial always runs. Features of a fold are built once and reused by all trials.
    """
    rng = random.Random(seed)
    candidates = [draw(space, rng) for _ in range(trials)]
    with _folds(panel, folds, horizon, featurise) as data:
        return _search(panel, candidates, data, make, budget_sec)


@contextmanager
def _folds(panel: Panel, folds: int, horizon: int, featurise: bool) -> Iterator[list[tuple]]:
    """(fold, training rows, validation rows, actual values) of each fold, kept while the trials run."""
    data = []
    try:
        for f in rolling_origin_splits(panel, folds, horizon):
            train, val = split_at(panel, f)
            actual = val.select(*panel.keys, panel.date, F.col(panel.target).alias("actual"))
            if featurise:
                train, val = (model_features(train, panel.target, panel.keys, panel.date).persist(),
                              future_features(train, val, panel.target, panel.keys, panel.date).persist())
            data.append((f["fold"], train, val, actual))
        yield data
    finally:
        if featurise:
            for _, train, val, _ in data:
                train.unpersist()
                val.unpersist()


def _rmse(panel: Panel, forecaster, train: DataFrame, val: DataFrame, actual: DataFrame) -> float:
    pred = forecaster.fit(train).predict(val).select(*panel.keys, panel.date, F.col("yhat").alias("forecast"))
    rmse = actual.join(pred, [*panel.keys, panel.date]).agg(*metric_columns(metrics=["RMSE"])).first().RMSE
    return float("inf") if rmse is None else rmse


def halving(panel: Panel, candidates: Sequence[dict], make: Callable[[dict], object], folds: int = 3, horizon: int = 28,
            keep: float = 1 / 3, parallel: int = 4, featurise: bool = True) -> tuple[dict, DataFrame]:
    """Best settings by successive halving, and the trial table with the ``rung`` of each fit.

    All settings are fitted on the newest fold; each further rung takes one older fold and the best ``keep`` of the
    settings by mean RMSE so far, two at least, ties to the earlier one. The fits of a rung run side by side, each in a
    scheduler pool of its own. A trial that fails counts as infinite.
    """
    if not candidates:
        raise ValueError("no settings to try")
    context = panel.df.sparkSession.sparkContext
    rows, scores, left = [], {i: [] for i in range(len(candidates))}, list(range(len(candidates)))

    def one(i: int, data: tuple) -> float:
        context.setLocalProperty("spark.scheduler.pool", f"trial-{i}")
        try:
            return _rmse(panel, make(candidates[i]), *data)
        except Exception as e:  # noqa: BLE001 - a bad setting must not end the search
            log.warning("trial %d failed: %s", i, e)
            return float("inf")
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    def mean(i: int) -> float:
        return sum(scores[i]) / len(scores[i])

    with _folds(panel, folds, horizon, featurise) as data, ThreadPoolExecutor(parallel) as pool:
        for rung, (fold, *frames) in enumerate(reversed(data), 1):
            for i, value in zip(left, pool.map(lambda i: one(i, frames), left)):
                scores[i].append(value)
                rows.append((i, {k: str(v) for k, v in candidates[i].items()}, fold, "RMSE", value, rung))
            left.sort(key=lambda i: (mean(i), i))
            if rung < folds:
                left = left[: max(2, int(len(left) * keep))]
    if mean(left[0]) == float("inf"):
        raise ValueError("no trial succeeded")
    return candidates[left[0]], panel.df.sparkSession.createDataFrame(rows, f"{TRIAL_SCHEMA}, rung int")


def _search(panel: Panel, candidates: list[dict], data: list[tuple], make: Callable[[dict], object], budget_sec: float) -> tuple[dict, DataFrame]:
    """All fits of all trials, PARALLEL of them side by side: one is many short jobs and much planning, which leave
    most of a cluster idle. Trials begin in their order; once one is late for the budget, none begins after it."""
    lock, on_time, began = Lock(), [], time.monotonic()

    def begins(i: int) -> bool:
        with lock:
            while len(on_time) <= i:
                on_time.append(not on_time or on_time[-1] and time.monotonic() - began < budget_sec)
            return on_time[i]

    def one(i: int, fold, train: DataFrame, val: DataFrame, actual: DataFrame) -> tuple | None:
        if not begins(i):
            return None
        try:
            value = _rmse(panel, make(candidates[i]), train, val, actual)
        except Exception as e:  # noqa: BLE001 - a bad draw must not end the search
            log.warning("trial %d failed: %s", i, e)
            value = float("inf")
        return i, {k: str(v) for k, v in candidates[i].items()}, fold, "RMSE", value

    with ThreadPoolExecutor(PARALLEL) as pool:
        run = inheritable_thread_target(panel.df.sparkSession)(one)
        fits = [pool.submit(run, i, *frames) for i in range(len(candidates)) for frames in data]
        rows = [r for r in (f.result() for f in fits) if r]
    if not all(on_time):
        log.info("time budget reached after %d trials", sum(on_time))
    best, best_score = None, float("inf")
    for i, ran in enumerate(on_time):
        score = sum(r[-1] for r in rows if r[0] == i) / len(data) if ran else float("inf")
        if score < best_score:
            best, best_score = candidates[i], score
    if best is None:
        raise ValueError("no trial succeeded")
    return best, panel.df.sparkSession.createDataFrame(rows, TRIAL_SCHEMA)


def tune_boosted(panel: Panel, trials: int = 20, budget_sec: float = 300.0, max_iter: int = 100, **kw):
    return tune(panel, BOOSTED_SPACE, lambda p: boosted(p, max_iter=max_iter, keys=panel.keys), trials, budget_sec=budget_sec, **kw)


def tune_depth_boosted(panel: Panel, trials: int = 20, budget_sec: float = 300.0, **kw):
    return tune(panel, DEPTH_SPACE, lambda p: boosted(p, keys=panel.keys), trials, budget_sec=budget_sec, **kw)


def tune_seasonal_ar(panel: Panel, trials: int = 20, budget_sec: float = 180.0, **kw):
    return tune(panel, AR_SPACE, lambda p: seasonal_ar(p, keys=panel.keys), trials, budget_sec=budget_sec, featurise=False, **kw)
