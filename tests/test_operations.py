import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.normal import norm_cdf, norm_ppf
from shelfcast.operators import drift, explain, inventory, models, scenario, scoring, validate
from shelfcast.plans.scoring import scoring_run


def forecasts(spark, rows):
    data = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "S1", "I1", *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "date date, store_id string, item_id string, yhat double, yhat_lower double, yhat_upper double")


def test_normal(spark):
    nd = statistics.NormalDist()
    df = spark.range(-900, 901).select((F.col("id") / 100.0).alias("x"))
    for r in df.select("x", norm_cdf(F.col("x")).alias("p")).collect():
        assert r.p == pytest.approx(nd.cdf(r.x), abs=1e-15)
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.02, 0.3, 0.5, 0.7, 0.975, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", norm_ppf(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(nd.inv_cdf(r.p), rel=1e-13, abs=1e-15)
    assert spark.range(1).select(norm_ppf(F.lit(0.0)).alias("z")).first().z is None


def test_inventory_fixture(spark):
    f = forecasts(spark, [(100, 90, 110), (105, 95, 115), (98, 88, 108)])
    r = inventory.inventory_metrics(f).first()
    assert r.expected_demand == 303 and r.demand_std == pytest.approx(20 / 3.92)
    assert r.safety_stock == pytest.approx(statistics.NormalDist().inv_cdf(0.95) * 20 / 3.92 * 7**0.5)
    assert r.reorder_point == pytest.approx(r.expected_demand + r.safety_stock)
    assert r.economic_order_quantity == pytest.approx((2 * 303 * 365 * 10 / 0.1) ** 0.5)
    params = spark.createDataFrame([("S1", "I1", 2)], "store_id string, item_id string, lead_time int")
    assert inventory.inventory_metrics(f, params).first().expected_demand == 205


def test_inventory_edges(spark):
    row = spark.range(1).select(
        inventory.stockout_probability(F.lit(70.0), F.lit(10.0), F.lit(0.0), F.lit(7)).alias("step0"),
        inventory.stockout_probability(F.lit(69.0), F.lit(10.0), F.lit(0.0), F.lit(7)).alias("step1"),
        inventory.stockout_probability(F.lit(70.0), F.lit(10.0), F.lit(2.0), F.lit(7)).alias("half"),
        inventory.eoq(F.lit(0.0), F.lit(0.1)).alias("eoq_min"), inventory.eoq(F.lit(5.0), F.lit(0.0)).alias("eoq_free"),
        inventory.turnover(F.lit(5.0), F.lit(0.0)).alias("turn"), inventory.carrying_cost(F.lit(8.0)).alias("carry"),
    ).first()
    assert (row.step0, row.step1, row.eoq_min, row.eoq_free, row.turn, row.carry) == (0, 1, 1, 0, 0, 2)
    assert row.half == pytest.approx(0.5)
    flat = forecasts(spark, [(100, 100, 100)] * 8)
    assert inventory.inventory_metrics(flat).first().demand_std == 0.1
    o = inventory.optimize_order_quantity(forecasts(spark, [(100, 0, 0), (110, 0, 0), (90, 0, 0)])).first()
    assert o.newsvendor_quantity > 100 and o.expected_demand == 100


def test_inventory_requests(spark):
    df = spark.createDataFrame([(0.95, 7, 0.1, 1.0), (0.4, 0, -1.0, 1.0)], "service_level double, lead_time int, holding_cost double, stockout_cost double")
    assert sorted(len(r.errors) for r in validate.validate_inventory_requests(df).collect()) == [0, 3]


def test_psi(spark):
    e = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    same = drift.psi_numeric(e, e, ["v"]).first().psi
    moved = drift.psi_numeric(e, e.select((F.col("v") * 0.5).alias("v")), ["v"]).first().psi
    assert same == 0 and moved > 0.2
    assert drift.psi_numeric(e, e.where("v < 0"), ["v"]).count() == 1
    flat = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert drift.psi_numeric(flat, flat, ["v"]).first().psi == 0
    a = spark.createDataFrame([("x",)] * 3 + [("y",)], "c string")
    b = spark.createDataFrame([("x",)] + [("y",)] * 2 + [("z",)], "c string")
    import math
    want = (0.25 - 0.75) * math.log(0.25 / 0.75) + (0.5 - 0.25) * math.log(0.5 / 0.25)
    assert drift.psi_categorical(a, b, ["c"]).first().psi == pytest.approx(want)


def test_drift_rows(spark, series):
    old = series([10, 20, 30], price=[1.0, 2.0, 3.0], on_promo=[0, 0, 0])
    new = series([20, 40, None], price=[1.0, 2.0, 3.0], on_promo=[0, 0, 0])
    m = {r.metric: r.value for r in drift.data_drift(new, old).collect()}
    assert m["sales_mean_drift"] == pytest.approx(0.5) and m["price_mean_drift"] == 0 and m["on_promo_mean_drift"] == 0
    assert m["sales_missing_drift"] == pytest.approx(1 / 3)
    alerts = {r.metric: r.severity for r in drift.drift_alerts(drift.data_drift(new, old)).collect()}
    assert alerts["sales_mean_drift"] == "drift" and alerts["sales_missing_drift"] == "missing_data"
    empty = spark.createDataFrame([], "yhat double")
    assert drift.prediction_drift(empty, empty).count() == 0


def requests(spark):
    row = ("S1", "I1", dt.date(2024, 1, 1), dt.date(2024, 1, 7), [1, 0, 1], [9.0, 8.0])
    return spark.createDataFrame([row], "store_id string, item_id string, start_date date, end_date date, promo_plan array<int>, price_plan array<double>")


def test_expand_and_vector(spark):
    days = scoring.expand_requests(requests(spark)).orderBy("date").collect()
    assert [d.on_promo for d in days] == [1, 0, 1, 0, 0, 0, 0] and [d.price for d in days[:3]] == [9.0, 8.0, None]
    v = scoring.scoring_features(scoring.expand_requests(requests(spark))).orderBy("date").collect()
    assert len(scoring.FEATURES) == 33 and v[2].price == 1.0 and v[0].days_to_holiday == 30 and v[0].sales_lag_1 == 0.0
    hist = spark.createDataFrame([("S1", "I1", 42.0)], "store_id string, item_id string, sales_lag_1 double")
    assert scoring.scoring_features(scoring.expand_requests(requests(spark)), hist).first().sales_lag_1 == 42.0


def test_fallback_interval(spark):
    import numpy as np

    v = scoring.scoring_features(scoring.expand_requests(requests(spark))).withColumn("yhat", F.lit(10.0))
    r = scoring.fallback_interval(v).first()
    spread = np.std([float(r[c]) for c in scoring.FEATURES])
    u = 10 * 0.15 * (1 + 0.1 * spread)
    assert r.yhat_upper == pytest.approx(10 + u) and r.yhat_lower == pytest.approx(max(0, 10 - u))
    top = explain.explain_simple(v, 3).where(F.col("date") == F.lit(dt.date(2024, 1, 1))).orderBy("rank").collect()
    assert top[0].feature == "year" and top[0].importance == 2024


def test_explain_simple_moves_one_row_for_each_row(spark):
    day, nan = dt.date(2024, 1, 1), float("nan")
    # Ties, missing values and rows with the same ids, null ones too, which are ranked together.
    rows = [("S", "a", day, 1.0, -5.0, 5.0, 0.0), ("S", "a", day, -7.0, 5.0, None, nan), ("S", "b", day, None, None, None, 2.0),
            ("S", None, day, 3.0, None, -3.0, 1.0), ("S", None, day, 3.0, 4.0, None, None), (None, "a", None, 0.0, -0.0, 0.0, 0.0)]
    rows += [("S", "c", day, float(i * 7 % 5), -float(i % 4), None if i % 3 else nan, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "store_id string, item_id string, date date, z double, y double, x double, b double")
    for k in (0, 1, 3, 9, 30):
        want = []
        for ids in {r[:3] for r in rows}:
            cells = [(c, None if v is None else abs(v)) for r in rows if r[:3] == ids for c, v in zip("zyxb", r[3:])]
            cells.sort(key=lambda c: (c[1] is None, c[1] == c[1], -(c[1] or 0.0) if c[1] == c[1] else 0.0, c[0]))
            want += [(*ids, c, v, i) for i, (c, v) in enumerate(cells[:k], 1)]
        found = explain.explain_simple(df, k, ["z", "y", "x", "b"])
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert dict(found.dtypes) == {"store_id": "string", "item_id": "string", "date": "date", "feature": "string", "importance": "double", "rank": "int"}
    plan = explain.explain_simple(df, 3, ["z", "y", "x", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan and "Generate" not in plan[plan.index("Exchange"):]
    assert "unboundedfollowing" not in plan  # however often ids repeat, a task holds some of their rows


def test_scenarios(spark):
    plan = scenario.scenario_plan(requests(spark), 100, -10)
    r = plan.first()
    assert r.promo_plan == [1] * 7 and r.price_plan == pytest.approx([9.0] * 7)
    assert scenario.scenario_plan(requests(spark), 0, 0).first().promo_plan == [0] * 7
    many = spark.range(300).select(F.lit("S").alias("store_id"), F.col("id").cast("string").alias("item_id"), F.lit(dt.date(2024, 1, 1)).alias("start_date"), F.lit(dt.date(2024, 1, 20)).alias("end_date"))
    share = scoring.expand_requests(scenario.scenario_plan(many, 30, 0)).agg(F.avg("on_promo")).first()[0]
    assert share == pytest.approx(0.3, abs=0.03)
    base = forecasts(spark, [(100, 0, 0), (100, 0, 0)])
    c = scenario.scenario_compare(base, base.withColumn("yhat", F.col("yhat") * 1.1)).first()
    assert c.impact == pytest.approx(20) and c.impact_pct == pytest.approx(10)


def test_scoring_run(spark, series):
    hist = series([10 + i % 7 for i in range(60)], price=[1.0] * 60, on_promo=[i % 2 for i in range(60)])
    days = scoring.scoring_features(hist.select("date", "store_id", "item_id", "on_promo", "price")).join(hist.select("date", "sales"), "date")
    model = models.GbtForecaster(max_iter=2, inputs=scoring.FEATURES).fit(days)
    out = scoring_run(hist, model, dt.date(2023, 3, 2))
    p = out["predictions"]
    assert p.count() == 8 and p.where("yhat < 0 or yhat_lower < 0 or yhat_lower > yhat or yhat > yhat_upper").isEmpty()
    s = out["summary"].first()
    assert s.predictions_generated == 8 and s.new_rows == 8


def test_missing_fields_break_their_rules(spark):
    from shelfcast.operators import validate

    rows = spark.sql("select cast(null as double) as sales, cast(null as int) as on_promo, 1.0 as price union all select 1.0, 0, 1.0")
    assert sorted(len(r.errors) for r in validate.flag_invalid_rows(rows).collect()) == [0, 2]
    r = spark.sql("select date'2024-01-01' as start_date, cast(null as date) as end_date, cast(null as array<int>) as promo_plan, cast(null as array<double>) as price_plan")
    assert len(validate.validate_forecast_requests(r).first().errors) == 1
    r = spark.sql("select cast(null as double) as service_level, cast(null as int) as lead_time, 1.0 as holding_cost, cast(null as double) as stockout_cost")
    assert len(validate.validate_inventory_requests(r).first().errors) == 3


def test_histogram_has_all_bins(series):
    from shelfcast.operators import profile

    rows = profile.value_histogram(series([0, 0, 10]), "sales", 5).orderBy("bin").collect()
    assert [r.n for r in rows] == [2, 0, 0, 0, 1]
    rows = profile.value_histogram(series([0, 10]).union(series([5], store="S2")), "sales", 2, by=["store_id"]).orderBy("store_id", "bin").collect()
    assert [(r.store_id, r.n) for r in rows] == [("S1", 1), ("S1", 1), ("S2", 0), ("S2", 1)]
