import datetime as dt
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.config import Config
from shelfcast.operators import backtest, baselines, explain, metrics, models, runlog, trees, tuning
from shelfcast.panel import Panel
from shelfcast.plans.training import train_and_select


def values(df):
    return [r.sales for r in df.orderBy("date").collect()]


def test_baselines(series):
    ramp = Panel(series(range(100, 110)))
    assert values(baselines.naive(ramp, 5)) == [109] * 5
    assert values(baselines.moving_average(ramp, 5, 3)) == [108] * 5
    week = Panel(series(list(range(100, 170, 10)) * 2))
    assert values(baselines.seasonal_naive(week, 7)) == list(range(100, 170, 10))
    assert values(baselines.seasonal_naive(Panel(series([1, 2, 3])), 4)) == [3] * 4
    level = pd.Series(range(100, 110), dtype=float).ewm(alpha=0.3, adjust=False).mean().iloc[-1]
    assert values(baselines.exponential_smoothing(ramp, 2)) == pytest.approx([level] * 2)
    first = baselines.naive(ramp, 5).orderBy("date").first().date
    assert first == dt.date(2023, 1, 11)


def test_all_baselines_equal_each(series, spark):
    df = series([5, 7, 9, 4, 6, 8, 3, 2, None, 7]).union(series([4, 5], store="S2"))
    p = Panel(df)
    together = baselines.all_baselines(p, 9)
    for name, fn in baselines.BASELINES.items():
        a = {(r.store_id, r.date): r.sales for r in together.where(F.col("forecast_type") == name).collect()}
        b = {(r.store_id, r.date): r.sales for r in fn(p, 9).collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_one_step_naive_stays_in_its_series(series):
    df = series([1, 2, 3]).union(series([10, 20, 30], store="S2"))
    got = {(r.store_id, r.date.day): r.yhat for r in baselines.one_step_naive(Panel(df)).collect()}
    assert got[("S2", 1)] == 20 and got[("S1", 2)] == 1


def frame(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "actual double, forecast double")


def test_metrics(spark):
    y = [100, 110, 120, 130, 140]
    r = metrics.point_metrics(frame(spark, y, [v + 5 for v in y])).first()
    assert (r.RMSE, r.MAE, r.R2) == (5, 5, 0.875)
    assert metrics.point_metrics(frame(spark, [100, 200, 300], [110, 180, 330])).first().MAPE == pytest.approx(10)
    zero = metrics.point_metrics(frame(spark, [0] * 5, range(1, 6))).first()
    assert zero.MAPE is None and zero.sMAPE == 200 and zero.R2 is None
    assert metrics.point_metrics(frame(spark, [], []), metrics=["RMSE", "odd"]).first().asDict() == {"RMSE": None, "odd": None}


def test_quantile_metrics(spark):
    rows = list(zip([10, 20, 30, 40, 50], [8, 14, 28, 34, 48], [12, 18, 32, 38, 52], [16, 22, 36, 42, 56]))
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "actual double, q10 double, q50 double, q90 double")
    r = metrics.quantile_metrics(df).first()
    assert r["Coverage_80"] == r["Coverage_90"] == 100 and r["Pinball_0.5"] == 1.0 and r["Pinball_0.1"] == pytest.approx(0.36)


def test_mase_and_aggregation(spark, series):
    train = series([1, 3, 5, 7])
    df = series([9, 11]).select("date", "store_id", "item_id", F.col("sales").alias("actual"), (F.col("sales") - 1).alias("forecast"))
    assert metrics.mase(df, train).first().MASE == 0.5
    assert metrics.mase(df, series([4, 4])).first().MASE is None
    per = spark.createDataFrame([(1.0, 1), (4.0, 3)], "RMSE double, length int")
    assert [metrics.aggregate_metrics(per, ["RMSE", "none"], h).first().RMSE for h in ("mean", "median", "weighted")] == [2.5, 2.5, 3.25]
    with pytest.raises(ValueError):
        metrics.aggregate_metrics(per, ["RMSE"], "odd")


def test_folds(series):
    p = Panel(series(range(40)))
    folds = backtest.fold_table(p, 7, 2)
    assert [f["cut"] for f in folds] == [dt.date(2023, 1, 20), dt.date(2023, 2, 8)]
    pred = backtest.baseline_backtest(p, 7, 2)
    per = {(r.model, r.fold): r for r in backtest.fold_metrics(pred).collect()}
    assert per[("naive", 1)].n_val == 7 and per[("naive", 2)].n_val == 2
    assert per[("naive", 1)].MAE == pytest.approx(np.mean(range(1, 8)))
    agg = {r.model: r for r in backtest.aggregate_folds(backtest.fold_metrics(pred)).collect()}
    assert agg["naive"].MAE_std == pytest.approx(np.std([4.0, 1.5]))
    assert backtest.select_champion(backtest.aggregate_folds(backtest.fold_metrics(pred))).first().model == "naive"


def test_backtest_equals_fold_by_fold(series):
    df = series([(i * 7919) % 23 for i in range(60)]).union(series([(i * 31) % 11 for i in range(60)], store="S2"))
    p = Panel(df)
    got = {(r.store_id, r.date, r.fold, r.model): r.forecast for r in backtest.baseline_backtest(p, 10, 3).collect()}
    want = {}
    for f in backtest.fold_table(p, 10, 3):
        ahead = baselines.all_baselines(Panel(df.where(F.col("date") < F.lit(f["cut"]))), 10)
        val = df.where((F.col("date") >= F.lit(f["cut"])) & (F.col("date") < F.lit(f["end"]))).select("store_id", "date")
        for r in ahead.join(val, ["store_id", "date"]).collect():
            want[(r.store_id, r.date, f["fold"], r.forecast_type)] = r.sales
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_backtest_is_one_scan_and_one_shuffle(series):
    plan = backtest.baseline_backtest(Panel(series(range(40))), 7, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_rolling_backtest_records_failures(series):
    p = Panel(series(range(40)))

    def fit(train):
        if train.count() < 25:
            raise RuntimeError("too short")
        return train.agg(F.avg("sales")).first()[0]

    pred, status = backtest.rolling_backtest(p, fit, lambda m, f: f.withColumn("yhat", F.lit(m)), horizon=7, n_folds=2)
    assert [s["status"] for s in status] == ["failed", "ok"] and pred.count() == 2
    with pytest.raises(ValueError, match="no fold"):
        backtest.rolling_backtest(p, lambda t: 1 / 0, lambda m, f: f, horizon=7, n_folds=2)


@pytest.fixture(scope="module")
def weekly(spark):
    rows = []
    for s in range(2):
        for i in range(140):
            d = dt.date(2023, 1, 1) + dt.timedelta(days=i)
            promo = int(i % 9 == 0)
            rows.append((d, f"S{s}", "I", float(20 + 5 * s + 6 * np.sin(2 * np.pi * i / 7) + 8 * promo), promo, 10.0 - promo))
    return spark.createDataFrame(rows, "date date, store_id string, item_id string, sales double, on_promo int, price double").persist()


def held_out(weekly, n=14):
    cut = dt.date(2023, 1, 1) + dt.timedelta(days=140 - n)
    return weekly.where(F.col("date") < F.lit(cut)), weekly.where(F.col("date") >= F.lit(cut))


def rmse(val, pred):
    both = val.select("store_id", "item_id", "date", F.col("sales").alias("actual")).join(pred.withColumnRenamed("yhat", "forecast"), ["store_id", "item_id", "date"])
    row = metrics.point_metrics(both).first()
    assert both.count() == val.count()
    return row.RMSE


def test_quantile_forecaster(weekly, tmp_path):
    train, val = held_out(weekly)
    fitted = models.QuantileForecaster(models.gbt_forecaster(max_iter=8, step_size=0.3), horizon=14).fit(models.model_features(train))
    out = fitted.predict(models.future_features(train, val)).persist()
    assert out.where("yhat_lower > yhat or yhat > yhat_upper").isEmpty()
    assert rmse(val, out.select("store_id", "item_id", "date", "yhat")) < 6
    imp = fitted.point.feature_importance().collect()
    assert imp[0].importance > 0 and "sales" not in {r.feature for r in imp}
    fitted.point.save(str(tmp_path / "m"))
    again = models.FittedGbt.load(str(tmp_path / "m"))
    assert again.inputs == fitted.point.inputs
    part = models.future_features(train, val)
    a = {(r.store_id, r.date): r.yhat for r in again.predict(part).collect()}
    b = {(r.store_id, r.date): r.yhat for r in fitted.point.predict(part).collect()}
    assert a == b


def test_future_features_do_not_use_future_sales(weekly):
    train, val = held_out(weekly)
    a = models.future_features(train, val).toPandas()
    b = models.future_features(train, val.withColumn("sales", F.lit(1e9))).toPandas()
    key = ["store_id", "date"]
    pd.testing.assert_frame_equal(a.sort_values(key).reset_index(drop=True), b.sort_values(key).reset_index(drop=True))


def test_seasonal_ar(weekly):
    train, val = held_out(weekly)
    fitted = models.SeasonalArForecaster(order=(1, 0, 0), seasonal=(1, 1, 0, 7), exog=("on_promo",)).fit(train)
    out = fitted.predict(val).persist()
    assert rmse(val, out.select("store_id", "item_id", "date", "yhat")) < 6
    assert out.where("yhat_lower > yhat or yhat > yhat_upper").isEmpty()
    assert models.difference_weights(1, 1, 3) == [1.0, 0.0, 1.0, -1.0]


def test_trend_seasonality_and_contributions(weekly):
    train, val = held_out(weekly)
    fitted = models.TrendSeasonalityForecaster(regressors=("on_promo",), annual_order=1, reg_param=0.001).fit(train)
    out = fitted.predict(val)
    assert rmse(val, out.select("store_id", "item_id", "date", "yhat")) < 3
    parts = fitted.contributions(val)
    top = explain.explain_contributions(parts, 2)
    assert top.count() == 2 * val.count()
    assert "_r_on_promo" in {r.feature for r in explain.mean_abs_contribution(parts, 5).collect()}


@pytest.fixture(scope="module")
def boosted(weekly):
    train, val = held_out(weekly)
    fitted = models.gbt_forecaster(max_iter=12, step_size=0.3, max_depth=4).fit(models.model_features(train))
    return fitted, models.future_features(train, val).persist()


def walk(nodes, tree, values):
    """The nodes that a row passes in one tree."""
    at, way = 0, []
    while True:
        n = nodes[tree, at]
        way.append(n)
        if n.left < 0:
            return way
        at = n.left if values[n.feature] <= n.threshold else n.right


def test_tree_contributions_follow_the_paths(boosted):
    fitted, ahead = boosted
    nodes = {(r.tree, r.node): r for r in trees.node_table(fitted.pipeline.stages[-1]).collect()}
    count = 1 + max(t for t, _ in nodes)
    assert count == 12 and all(nodes[t, 0].weight > 0 for t in range(count))
    scored = fitted.pipeline.transform(models._with_means(ahead, fitted.means, fitted.keys)).select("store_id", "date", "features", "prediction").collect()
    got = {}
    for r in fitted.contributions(ahead).collect():
        got.setdefault((r.store_id, r.date), {})[r.feature] = r.contribution
    assert len(got) == len(scored) == ahead.count()
    bias = fitted.bias()
    for r in scored:
        want = dict.fromkeys(fitted.inputs, 0.0)
        for t in range(count):
            way = walk(nodes, t, r.features)
            for here, there in zip(way, way[1:]):
                want[fitted.inputs[here.feature]] += here.weight * (there.prediction - here.prediction)
        mine = got[r.store_id, r.date]
        assert mine == pytest.approx(want, abs=1e-9)
        assert sum(mine.values()) == pytest.approx(r.prediction - bias)
    assert explain.mean_abs_contribution(fitted.contributions(ahead), 3).count() == 3


def test_tree_contributions_of_odd_rows(boosted):
    fitted, ahead = boosted
    assert fitted.contributions(ahead.limit(0)).count() == 0
    odd = ahead.limit(1).select([F.lit(None).cast(f.dataType).alias(f.name) if f.name in fitted.inputs else F.col(f.name) for f in ahead.schema.fields])
    total = fitted.contributions(odd).agg(F.sum("contribution")).first()[0]
    assert total == pytest.approx(fitted.predict(odd).first().yhat - fitted.bias())


def test_leaf_quantiles_widen_where_rows_are_hard_to_tell(spark):
    rng = np.random.default_rng(3)
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(days=i), "S", f"I{k}", float(20 + 40 * (k >= 3) + rng.normal(0, 1 if k < 3 else 8)), float(k >= 3)) for i in range(200) for k in range(6)]
    df = spark.createDataFrame(rows, "date date, store_id string, item_id string, sales double, wild double")
    fitted = models.QuantileForecaster(models.GbtForecaster(max_iter=4, max_depth=3, inputs=("wild",)), horizon=60).fit(df.where("date < '2023-06-20'"))
    out = fitted.predict(df.where("date >= '2023-06-20'")).withColumn("inside", (F.col("sales").between(F.col("yhat_lower"), F.col("yhat_upper"))).cast("int"))
    by = {r.wild: r for r in out.groupBy("wild").agg(F.avg("inside").alias("inside"), F.avg(F.col("yhat_upper") - F.col("yhat_lower")).alias("width")).collect()}
    assert by[1.0].width > 3 * by[0.0].width
    assert all(abs(r.inside - 0.8) < 0.1 for r in by.values()), by
    assert abs(out.agg(F.avg("inside")).first()[0] - 0.8) < 0.05
    few = models.QuantileForecaster(models.GbtForecaster(max_iter=1, max_depth=2, inputs=("wild",)), horizon=1).fit(df.limit(40))
    assert few.predict(df.limit(5)).where("yhat_lower <= yhat and yhat <= yhat_upper").count() == 5


def arma(n, phi, theta, seed, season=0):
    rng = np.random.default_rng(seed)
    e, z = rng.normal(size=n + 50), np.zeros(n + 50)
    for t in range(50, n + 50):
        z[t] = phi * z[t - 1] + e[t] + theta * e[t - (season or 1)]
    return z[50:]


@pytest.mark.parametrize("season", (0, 7))
def test_moving_average_terms_are_recovered(spark, season):
    rows = [(dt.date(2015, 1, 1) + dt.timedelta(days=i), "S", f"I{k}", 5.0 + float(v)) for k in range(4) for i, v in enumerate(arma(1500, 0.5, 0.6, k, season))]
    df = spark.createDataFrame(rows, "date date, store_id string, item_id string, sales double")
    spec = models.SeasonalArForecaster(order=(1, 0, 0 if season else 1), seasonal=(0, 0, 1 if season else 0, season or 7))
    fitted = spec.fit(df.where("date < '2019-01-01'"))
    assert fitted.coef["_z1"] == pytest.approx(0.5, abs=0.08) and fitted.coef[f"_e{season or 1}"] == pytest.approx(0.6, abs=0.08)
    val = df.where("date >= '2019-01-01' and date < '2019-01-15'")
    without = models.SeasonalArForecaster(order=(1, 0, 0), seasonal=(0, 0, 0, 7)).fit(df.where("date < '2019-01-01'"))
    assert fitted.sigma < without.sigma
    mine, plain = ({(r.item_id, r.date): r.yhat for r in m.predict(val).collect()} for m in (fitted, without))
    assert mine.keys() == plain.keys() and any(abs(mine[k] - plain[k]) > 0.05 for k in mine)


def test_shocks_enter_the_first_steps_only(spark):
    rows = [(dt.date(2015, 1, 1) + dt.timedelta(days=i), "S", "I", float(v)) for i, v in enumerate(arma(800, 0.0, 0.8, 5))]
    df = spark.createDataFrame(rows, "date date, store_id string, item_id string, sales double")
    last = df.agg(F.max("date")).first()[0]
    ahead = spark.createDataFrame([(last + dt.timedelta(days=i), "S", "I") for i in (1, 2, 3)], "date date, store_id string, item_id string")
    fitted = models.SeasonalArForecaster(order=(0, 0, 1), seasonal=(0, 0, 0, 7)).fit(df)
    state = fitted.state.first()
    y = [r.yhat for r in fitted.predict(ahead).orderBy("date").collect()]
    level = state._mu + state._sd * fitted.intercept
    assert y[1] == pytest.approx(level) and y[2] == pytest.approx(level)
    assert y[0] == pytest.approx(level + state._sd * fitted.coef["_e1"] * state._es[-1])


def test_series_have_their_own_trend(spark):
    rng = np.random.default_rng(8)
    slopes = {"up": 0.004, "flat": 0.0, "down": -0.003}
    rows = [(dt.date(2022, 1, 1) + dt.timedelta(days=i), "S", k, float(np.expm1(3 + b * i + rng.normal(0, 0.05)))) for k, b in slopes.items() for i in range(300)]
    df = spark.createDataFrame(rows, "date date, store_id string, item_id string, sales double")
    train, val = df.where("date < '2022-10-01'"), df.where("date >= '2022-10-01'")
    fitted = models.TrendSeasonalityForecaster(annual_order=0).fit(train)
    pred = {(r.item_id, r.date): r.yhat for r in fitted.predict(val).collect()}
    for r in val.collect():
        assert pred[r.item_id, r.date] == pytest.approx(r.sales, rel=0.35)
    told = fitted.contributions(val).where("feature = '_own_trend'").groupBy("item_id").agg(F.avg("contribution").alias("c")).collect()
    told = {r.item_id: r.c for r in told}
    assert told["up"] > told["flat"] > told["down"]
    noise = spark.createDataFrame([("S", f"I{i}", float(t), float(rng.normal())) for i in range(40) for t in range(30)], "store_id string, item_id string, t double, y double")
    shrunk = models.series_slopes(noise, "y", "t", shrink=models.chance_shrinkage(noise, "y", "t"))
    raw = models.series_slopes(noise, "y", "t")
    total = lambda d: d.agg(F.sum(F.abs("slope"))).first()[0]
    assert total(shrunk) < 0.6 * total(raw)  # slopes of chance are drawn in


def test_key_means_know_no_later_day(spark, weekly):
    means = models.earlier_means(weekly, ("store_id",), "m").collect()
    rows = weekly.collect()
    for r in means:
        past = [x.sales for x in rows if x.date < r.date]
        mine = [x.sales for x in rows if x.date < r.date and x.store_id == r.store_id]
        want = None if not past else (sum(mine) + 10 * sum(past) / len(past)) / (len(mine) + 10)
        assert r.m is None if want is None else r.m == pytest.approx(want)
    odd = spark.createDataFrame([("a,b", "c", 1.0), ("a", "b,c", 5.0), (None, "x", 3.0), ("a", None, None)], "store_id string, item_id string, sales double")
    stored = models.key_means(odd, models.key_levels(("store_id", "item_id")))
    assert stored.where("column = 'series' and value is not null").count() == 3
    told = {(r.store_id, r.item_id): r._mean_series for r in models._with_means(odd, stored, ("store_id", "item_id")).collect()}
    assert told["a,b", "c"] < told[None, "x"] < told["a", "b,c"] and told["a", None] == pytest.approx(3.0)

def test_model_matrix(spark, series):
    m = models.to_model_matrix(series([1, 2], a=[None, float("inf")], b=[float("nan"), 3.0]), ["a", "b"]).orderBy("date").collect()
    assert m[0].features.toArray().tolist() == [0.0, 0.0] and m[1].features[0] > 1e308 and m[1].label == 2.0


def test_rounds_carry_no_plan(weekly, monkeypatch):
    seen, fit = [], models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    train = weekly.where(F.col("date") < dt.date(2023, 4, 1))
    models.gbt_forecaster(max_iter=2).fit(models.model_features(train))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.startswith("*(1) Scan ExistingRDD") and len(plan.strip().splitlines()) == 1 and seen[0].count() == train.count()


def test_quantile_fits_run_side_by_side(weekly, monkeypatch):
    both, fit = threading.Barrier(2), models.GBTRegressor.fit
    monkeypatch.setattr(models.GBTRegressor, "fit", lambda self, rows: both.wait(120) is not None and fit(self, rows))
    assert models.QuantileForecaster(models.gbt_forecaster(max_iter=2), horizon=14).fit(models.model_features(weekly)).quantiles == (0.1, 0.5, 0.9)


@pytest.mark.parametrize("n", [5, 203, 5000])
def test_any_number_of_key_values(spark, n, tmp_path):
    rows = spark.range(n * 2).selectExpr("date_add(date'2023-01-01', cast(id % 2 as int)) as date", "'S' as store_id",
                                         f"concat('I', lpad(cast(id div 2 as string), 6, '0')) as item_id", "cast(id div 2 as double) as sales", "id % 2 as x")
    fitted = models.GbtForecaster(max_iter=3, inputs=("x",), step_size=0.5, feature_share=1.0, subsampling_rate=1.0).fit(rows)
    assert {r.feature for r in fitted.feature_importance().collect()} == {"x", "store_id", "item_id"}
    found = fitted.predict(rows)
    error = found.agg(F.avg(F.abs(F.col("yhat") - F.col("sales"))), F.count("*")).first()
    assert error[1] == 2 * n and error[0] < 0.15 * n  # neighbours differ, so their codes do too
    fitted.save(str(tmp_path / "m"))
    again = models.FittedGbt.load(str(tmp_path / "m")).predict(rows.withColumn("item_id", F.lit("unknown")))
    assert again.count() == 2 * n


def test_features_after_a_long_hole(spark):
    days = spark.range(60).selectExpr("date_add(date'2020-01-01', cast(id as int)) as date", "'S' as store_id", "'I' as item_id", "cast(id + 1 as double) as sales", "30D as price")
    ahead = spark.sql("select date'2022-01-01' as date, 'S' as store_id, 'I' as item_id, cast(null as double) as sales, 1D as price")
    row = models.future_features(days, ahead).first()
    assert (row.sales_lag_1, row.sales_lag_28, row.sales_rolling_mean_28) == (60.0, 33.0, 46.5) and row.price_pct_change == pytest.approx(-29 / 30)


def test_folds_fit_their_own_features(weekly):
    class Fitted:
        """Notes the last day that it was fitted on."""

        def fit_transform(self, df):
            self.last = df.agg(F.max("date")).first()[0]
            return df.withColumn("seen", F.lit(self.last))

        def transform(self, df):
            return df.withColumn("seen", F.lit(self.last))

    def run(parallel):
        found, _ = backtest.rolling_backtest(Panel(weekly), lambda df: df.agg(F.max("seen")).first()[0],
                                             lambda m, df: df.withColumn("yhat", F.datediff(F.lit(m), F.col("seen")).cast("double")),
                                             Fitted(), horizon=7, n_folds=4, parallel=parallel)
        return sorted(map(str, found.collect()))

    rows = run(4)
    assert rows == run(1) and all("forecast=0.0" in r for r in rows)


def test_rows_without_a_forecast_stay(spark, weekly):
    cut = backtest.fold_table(Panel(weekly), 7, 2)[0]["cut"]
    late = weekly.where((F.col("date") == cut) & (F.col("store_id") == weekly.first().store_id)).limit(1).withColumn("item_id", F.lit("late"))
    found = backtest.baseline_backtest(Panel(weekly.unionByName(late)), 7, 2)
    assert found.where("item_id = 'late' and forecast is null").count() == len(baselines.BASELINES)
    assert backtest.fold_metrics(found).agg(F.sum("n_unpredicted")).first()[0] == found.where("forecast is null").count()


def test_tuning(weekly):
    best, trials = tuning.tune_seasonal_ar(Panel(weekly), trials=2, folds=2, horizon=7)
    assert set(best) == set(tuning.AR_SPACE) and trials.count() == 4
    again, _ = tuning.tune_seasonal_ar(Panel(weekly), trials=2, folds=2, horizon=7)
    assert best == again
    _, one = tuning.tune_seasonal_ar(Panel(weekly), trials=3, folds=2, horizon=7, budget_sec=0.0)
    assert one.select("trial").distinct().count() == 1


def test_train_and_select(weekly):
    class Broken:
        def fit(self, df):
            raise RuntimeError("no")

    found = train_and_select(weekly, {"trend": models.TrendSeasonalityForecaster(annual_order=1), "broken": Broken()}, Config(horizon=7, folds=2))
    names = {r.model for r in found["summary"].collect()}
    assert "trend" in names and "broken" not in names and {"naive", "seasonal_naive"} <= names
    assert found["champion"].count() == 1
    assert found["folds"].where("model = 'broken'").count() == 1


def test_run_log(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    rows = [("r1", "a", 1, "sMAPE", 5.0, now), ("r2", "b", 1, "sMAPE", 3.0, now), ("r3", "b", 1, "sMAPE", None, now)]
    runlog.log_runs(spark.createDataFrame(rows, runlog.RUN_SCHEMA), str(tmp_path / "runs"))
    runlog.log_runs(spark.createDataFrame([("r4", "a", 1, "MAE", 1.0, now)], runlog.RUN_SCHEMA), str(tmp_path / "runs"))
    runs = runlog.read_runs(spark, str(tmp_path / "runs"))
    assert [r.run_id for r in runlog.best_runs(runs, limit=5).collect()] == ["r2", "r1"]
    table = [("m", 1, "None", "/p1", "r1", now), ("m", 2, "None", "/p2", "r2", now)]
    path = str(tmp_path / "models")
    runlog.log_models(spark.createDataFrame(table, runlog.MODEL_SCHEMA), path)
    read = lambda: spark.read.schema(runlog.MODEL_SCHEMA).parquet(path)
    assert runlog.champion_row(read(), runs, "m").version == 2
    runlog.log_models(runlog.promote(read(), "m", 1, "Production", "2024-02-01"), path)
    assert runlog.champion_row(read(), runs, "m").version == 1
    assert {(r.stage, r.version) for r in runlog.latest_model(read(), "m").collect()} == {("Production", 1), ("None", 2)}
    assert runlog.champion_row(read(), runs, "other") is None
    with pytest.raises(ValueError):
        runlog.load_champion(read(), runs, "other")


@pytest.mark.parametrize("kind", ["gbt", "quantile", "seasonal_ar", "trend_seasonality"])
def test_stored_models_predict_the_same(spark, weekly, tmp_path, kind):
    train, val = held_out(weekly)
    made = {"gbt": models.GbtForecaster(max_iter=2), "quantile": models.QuantileForecaster(models.GbtForecaster(max_iter=2), horizon=7),
            "seasonal_ar": models.SeasonalArForecaster(seasonal=(1, 1, 1, 7), exog=("on_promo",)),
            "trend_seasonality": models.TrendSeasonalityForecaster(regressors=("on_promo",), annual_order=1)}[kind]
    boosted = kind in ("gbt", "quantile")
    fitted = made.fit(models.model_features(train) if boosted else train)
    ahead = models.future_features(train, val) if boosted else val
    fitted.save(str(tmp_path / "m"))
    again = models.load_fitted(spark, str(tmp_path / "m"))
    values = lambda m: sorted((r.store_id, r.item_id, r.date, r.yhat) for r in m.predict(ahead).collect())
    assert values(again) == values(fitted) and len(values(fitted)) == val.count()
    new = ahead.withColumn("item_id", F.lit("unseen"))
    assert again.predict(new).count() == val.count()


def test_training_registers_its_champion(spark, weekly, tmp_path):
    folder = str(tmp_path / "registry")
    for hour in (1, 2):
        train_and_select(weekly, {"trend": models.TrendSeasonalityForecaster(annual_order=1)}, Config(horizon=7, folds=2),
                         registry=folder, at=dt.datetime(2024, 1, 1, hour))
    table = spark.read.schema(runlog.MODEL_SCHEMA).parquet(f"{folder}/table")
    runs = runlog.read_runs(spark, f"{folder}/runs")
    assert sorted(r.version for r in table.collect()) == [1, 2]
    assert {"one_step_naive", "trend", "naive"} <= {r.model for r in runs.select("model").distinct().collect()}
    champion = runlog.load_champion(table, runs, "trend")
    assert champion.predict(weekly.limit(3)).count() == 3
