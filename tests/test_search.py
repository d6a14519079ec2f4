"""Backtests by state, searches over settings, permutation importance and the counts behind the checks."""

import math
import threading
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import backtest, baselines, explain, profile, tuning, validate
from shelfcast.panel import Panel


def test_states_with_missing_values(series):
    df = series([None, None, 4, 9, None, 2, 7, 8, None, None, 3, 5, 6, 1, 12, None, 7, 3, 2, 9]).union(series([None] * 12 + [5, None, 4, 8, 1, 1, 2, 3], store="S2"))
    got = {(r.store_id, r.date, r.fold, r.model): r.forecast for r in backtest.baseline_backtest(Panel(df), 4, 3).collect()}
    folds, want = backtest.fold_table(Panel(df), 4, 3), {}
    for f in folds:
        for r in baselines.all_baselines(Panel(df.where(F.col("date") < F.lit(f["cut"]))), 30).collect():
            if f["cut"] <= r.date < f["end"]:
                want[(r.store_id, r.date, f["fold"], r.forecast_type)] = r.sales
    days = df.count() // 2
    assert len(got) == 2 * 4 * sum(min(4, max(0, days - (f["cut"] - folds[0]["cut"]).days - 6)) for f in folds)
    assert all(got[k] == pytest.approx(want[k]) if k in want else got[k] is None for k in got)
    assert any(v is None for v in got.values()) and set(want) & set(got)


@pytest.mark.parametrize("n_folds", [2, 6])
def test_shuffle_does_not_depend_on_folds(series, n_folds):
    plan = backtest.baseline_backtest(Panel(series(range(60))), 7, n_folds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan[plan.index("Exchange hashpartitioning"):]


@dataclass(frozen=True)
class LastMean:
    window: int

    def fit(self, train):
        if self.window < 0:
            raise ValueError("no such window")
        means = baselines.moving_average(Panel(train), 1, self.window).select("store_id", "item_id", F.col("sales").alias("yhat"))
        return Means(means)


@dataclass(frozen=True)
class Means:
    means: DataFrame

    def predict(self, df):
        return df.join(self.means, ["store_id", "item_id"], "left")


def waves(series, n=120):
    return Panel(series([10 + 5 * math.sin(i / 9) + (i * 7919) % 5 for i in range(n)]))


def test_halving_finds_the_best_of_the_full_search(series):
    panel = waves(series)
    settings = [{"window": w} for w in (1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 20, 30)]
    best, trials = tuning.halving(panel, settings, lambda p: LastMean(**p), horizon=7, featurise=False)
    with tuning._folds(panel, 3, 7, False) as data:
        full, _ = tuning._search(panel, settings, data, lambda p: LastMean(**p), math.inf)
    assert best == full
    rungs = {r.rung: r["count"] for r in trials.groupBy("rung").count().collect()}
    assert rungs == {1: 12, 2: 4, 3: 2} and sum(rungs.values()) <= 3 * len(settings) / 2


def test_halving_survives_bad_settings(series):
    panel = waves(series, 60)
    best, trials = tuning.halving(panel, [{"window": -1}, {"window": 3}], lambda p: LastMean(**p), folds=2, horizon=7, featurise=False)
    assert best == {"window": 3} and trials.where("value = double('infinity')").count() == 2
    with pytest.raises(ValueError):
        tuning.halving(panel, [{"window": -1}], lambda p: LastMean(**p), folds=1, horizon=7, featurise=False)
    with pytest.raises(ValueError):
        tuning.halving(panel, [], lambda p: LastMean(**p))


def test_search_fits_side_by_side(series, monkeypatch):
    # Four fits wait for each other: two folds of two trials. One after the other, every one would fail.
    all_four, rmse = threading.Barrier(4), tuning._rmse
    monkeypatch.setattr(tuning, "_rmse", lambda *args: all_four.wait(60) is not None and rmse(*args))
    panel, settings = waves(series, 60), [{"window": 3}, {"window": -1}]
    with tuning._folds(panel, 2, 7, False) as data:
        best, trials = tuning._search(panel, settings, data, lambda p: LastMean(**p), math.inf)
    rows = [(r.trial, r.fold, math.isinf(r.value)) for r in trials.collect()]
    assert best == settings[0] and rows == [(0, 1, False), (0, 2, False), (1, 1, True), (1, 2, True)]


def test_search_ends_with_its_budget(series, monkeypatch):
    panel, settings = waves(series, 60), [{"window": w} for w in range(1, 30)]
    clock = iter(range(1000))
    monkeypatch.setattr(tuning, "time", SimpleNamespace(monotonic=lambda: next(clock)))
    with tuning._folds(panel, 1, 7, False) as data:
        _, trials = tuning._search(panel, settings, data, lambda p: LastMean(**p), 5)
    assert [r.trial for r in trials.collect()] == [0, 1, 2, 3, 4]


class Twice:
    def predict(self, df):
        return df.withColumn("yhat", 2 * F.coalesce("price", F.lit(0.0)))


def test_permutation_importance(series):
    price = [float((i * 37) % 11) for i in range(50)]
    df = series([2 * p for p in price], price=price, temperature=[float(i % 3) for i in range(50)])
    got = {r.feature: r for r in explain.permutation_importance(Twice(), df, ["price", "temperature"]).collect()}
    assert got["temperature"].importance == 0 and got["temperature"].rmse == 0
    assert got["price"].importance == got["price"].rmse > 1
    again = {r.feature: r.rmse for r in explain.permutation_importance(Twice(), df.repartition(7), ["price", "temperature"]).collect()}
    assert again["price"] == pytest.approx(got["price"].rmse)
    other = {r.feature: r.rmse for r in explain.permutation_importance(Twice(), df, ["price"], seed=7).collect()}
    assert other["price"] != got["price"].rmse
    one = explain.permutation_importance(Twice(), df.limit(1), ["price"]).first()
    assert one.importance == 0
    with pytest.raises(ValueError):
        explain.permutation_importance(Twice(), df.limit(0), ["price"])


def test_every_value_is_dealt_once(series):
    price = [float(i) for i in range(40)]
    df = series(price, price=price)

    class Seen:
        def predict(self, rows):
            got = sorted(r.price for r in rows.where("_feature = 'price'").collect())
            assert got == price
            return rows.withColumn("yhat", F.col("price"))

    assert explain.permutation_importance(Seen(), df, ["price"]).first().rmse > 0


def test_report_table(series):
    df = series([1, None, 3], price=[1.0, 2.0, None], on_promo=[0, 1, 0])
    rows = {(r.section, r.item, r.metric): r.value for r in profile.report_table(profile.quality_report(df)).collect()}
    assert rows[("missingness", "sales", "n_null")] == 1 and rows[("missing_runs", "S1/I1", "max_run")] == 1
    assert rows[("duplicates", "", "n_rows")] == 3 and rows[("cardinality", "price", "n_distinct")] == 2
    assert np.isclose(rows[("completeness", "S1/I1", "completeness")], 100)
    gap = profile.report_table({"missing_dates": profile.missing_dates(df.where("sales is not null"))}).collect()
    assert [(r.item, r.metric, r.value) for r in gap] == [("2023-01-02", "n", 1.0)]


def test_violations(series):
    df = series([1, -2, 3], on_promo=[0, 2, None])
    assert validate.raw_violations(df).first().asDict() == {"n_text": 0, "n_negative": 1, "n_promo": 2}
    assert validate.raw_violations(df.limit(0)).first().n_negative == 0
    late = validate.chronology(df, df).first()
    assert late.leaks and not validate.chronology(df.limit(0), df).first().leaks
    found = {(r.check, r.column): r.n for r in validate.feature_violations(df.withColumn("sales", F.lit(float("-inf")))).collect()}
    assert found == {("null", "store_id"): 0, ("null", "item_id"): 0, ("null", "date"): 0, ("infinite", "sales"): 3}
